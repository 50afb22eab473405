"""Query op6: base counts of all documents and the robust verdict on them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.quality import judged
from joinery.runtime import table

NAME = "op6_quality"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("_row.doc_id", *[F.col(f"_{c}").alias(c) for c in counts], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))
