"""Query op3: the language of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.crf import held_out, identify, train
from joinery.runtime import table

NAME = "op3_langid"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = identify(docs.select(F.struct("doc_id").alias("_row"), F.col("text").alias("_text")), train(docs.select("doc_id", "text", "lang")))
    return rows.select("_row.doc_id", F.coalesce(held_out(F.col("_row.doc_id")), F.lit(False)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
