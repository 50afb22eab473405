"""Query op4: byte-level BPE of all documents, and back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.bpe import digests
from joinery.runtime import table

NAME = "op4_bpe"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = digests(docs.select(F.struct("doc_id").alias("_row"), F.col("text").alias("_text")))
    return rows.select("_row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
