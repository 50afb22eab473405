"""Query op7: all documents in shards 0 to 39 of near-equal bytes, equal texts together."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.sharding import sharded
from joinery.runtime import table

NAME = "op7_shards"
SHARDS = 40


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
