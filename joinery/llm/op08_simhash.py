"""Query op8: SimHash near-duplicate groups of all documents."""

from pyspark.sql import DataFrame, SparkSession

from joinery.llm.simhash import hex16, near_duplicates
from joinery.runtime import table

NAME = "op8_simhash"
WIDTH, RADIUS = 3, 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"), WIDTH, RADIUS)
    return groups.select("doc_id", hex16(groups.fp).alias("fingerprint"), "component_id")
