"""Query op5: greedy longest-match token counts of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.wordpiece import token_counts
from joinery.runtime import table

NAME = "op5_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = token_counts(docs.select(F.struct("doc_id").alias("_row"), F.col("text").alias("_text")))
    return rows.select("_row.doc_id", "n_words", "n_tokens")
