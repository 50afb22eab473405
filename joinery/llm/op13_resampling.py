"""Query op13: documents resampled towards the distribution of the benchmark's words."""

from pyspark.sql import DataFrame, SparkSession

from joinery.llm.resampling import resampled
from joinery.runtime import table

NAME = "op13_resampling"
SEED, PERCENT, LONGEST = 2024, 10, 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), SEED, PERCENT, LONGEST)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH crc_table AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), docs AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), target AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), words AS (SELECT rid, unnest(words) AS word FROM docs
), both_ AS (
    SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, 1 AS s, 0 AS t FROM words UNION ALL SELECT word, 0, 1 FROM target) GROUP BY word
), hashed AS (
    SELECT word, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(encode(word))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM both_, crc_table
), gain AS (
    SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
    FROM (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket)
), weight AS (
    SELECT rid, sum(gain) AS weight FROM words JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY rid
), scored AS (
    SELECT rid, doc_id, len(words) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
    FROM docs LEFT JOIN weight USING (rid)
), placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (rid)
"""
