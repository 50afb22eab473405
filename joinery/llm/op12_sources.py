"""Query op12: how the sources of each language differ in all documents."""

from pyspark.sql import DataFrame, SparkSession

from joinery.llm.divergence import audit
from joinery.runtime import table

NAME = "op12_divergence"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), words AS (SELECT rid, lang, source, unnest(words) AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10
), counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), groups AS (SELECT DISTINCT lang, source FROM docs
), dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
    SELECT *, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM dense
), q AS (
    SELECT lang, term, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q
    FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY 1, 2)
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""
