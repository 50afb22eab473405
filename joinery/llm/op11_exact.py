"""Query op11: exact duplicates of all documents by content sort."""

from pyspark.sql import DataFrame, SparkSession

from joinery.llm.contentsort import content_groups
from joinery.runtime import table

NAME = "op11_content_sort"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content_groups(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("_row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM texts
"""
