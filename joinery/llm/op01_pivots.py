"""Query op1: the five best inner products of every fiftieth vector."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.pivots import scaled, top_k
from joinery.runtime import table

NAME = "op1_pivot_topk"
EVERY, K = 50, 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0), K)


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_count(embedding) = len(embedding)
), s AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 5
"""
