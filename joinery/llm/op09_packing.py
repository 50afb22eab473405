"""Query op9: all documents packed into sequences of the permitted lengths."""

from pyspark.sql import DataFrame, SparkSession

from joinery.llm.packing import packed
from joinery.runtime import table

NAME = "op9_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
