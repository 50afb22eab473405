import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts at the edges: null, empty, white space, one word, no letters, ties, very long, astral and combining characters.
EDGE_TEXTS = [None, "", " \n\t", "word", "42 - 17", "the same text here again", "the same text here again", "été ça 😀 e\u0301", "x " * 20_000, "a" * 50_000, "one two three four five six seven eight nine ten eleven"]


@pytest.fixture
def edge_docs(spark):
    """Edge texts, nulls in every column, repeated rows, and extra columns that clash with names inside operators."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", None][i % 2], None if t is None else len(t)) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], rows[5], (None, "the same text here again", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    from pyspark.sql import functions as F

    for name in ("fp", "_text", "_row", "n_tokens", "component_id", "x", "mu", "_lang", "score", "listed", "copy", "shard", "size"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def saved(spark, tmp_path):
    """Writes a table so that a query can read it; gives the folder."""

    def save(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save
