"""Re-Pair bounds and indices of rings, with their values worked out by recursion in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.evaluation import stats
from joinery.operators.grammar import repair_bounds
from joinery.operators.graphs import path_strings
from joinery.plans.options import GraphOptions, StringOptions
from joinery.plans.solve import assembly_of_graphs, assembly_of_strings
from joinery.queries.objects import NAMES_SQL, ORDERS_SQL, USERS_SQL, distinct_order_strings, names, path_graphs, user_strings
from joinery.runtime import table


def repair_sql(source: str, reverse: bool) -> str:
    """Re-Pair by recursion: each step joins the neighbours whose joined text saves most, the earliest ones on ties."""
    canon = lambda x: f"least({x}, reverse({x}))" if reverse else x
    return f"""
WITH RECURSIVE base AS (SELECT DISTINCT text FROM ({source}) WHERE length(text) > 0), s(id, t, known, rules, step) AS (
    SELECT text, string_split(text, ''), list_distinct(string_split(text, '')), 0, 0 FROM base
    UNION ALL
    SELECT id,
        list_transform(list_filter(range(1, len(t) + 1), lambda i: NOT list_contains(best.places, i - 1)), lambda i: CASE WHEN list_contains(best.places, i) THEN t[i] || t[i + 1] ELSE t[i] END),
        CASE WHEN list_contains(known, best.key) THEN known ELSE list_append(known, best.key) END,
        rules + CASE WHEN list_contains(known, best.key) THEN 0 ELSE 1 END, step + 1
    FROM (
        SELECT *, list_sort(list_transform(list_distinct(keys), lambda k: struct_pack(cost := CASE WHEN list_contains(known, k) THEN 0 ELSE 1 END - len(apart(keys, k)), at := list_position(keys, k), key := k, places := apart(keys, k))))[1] AS best
        FROM (SELECT *, list_transform(range(1, len(t)), lambda i: {canon("(t[i] || t[i + 1])")}) AS keys FROM s WHERE len(t) > 1)
    ) WHERE best.cost < 0
)
SELECT id AS text, CAST(arg_max(rules, step) + len(arg_max(t, step)) - 1 AS INTEGER) AS upper_bound, CAST(arg_max(rules, step) AS INTEGER) AS rule_count, CAST(len(arg_max(t, step)) AS INTEGER) AS remaining_fragments FROM s GROUP BY id
"""


def _apart(sql: str) -> str:
    """sql with apart(keys, k) spelled out: places of k from the left, none next to the one taken before it."""
    places = "list_reduce(list_transform(list_filter(range(1, len(keys) + 1), lambda i: keys[i] = k), lambda i: [i]), lambda a, x: CASE WHEN a[-1] = x[1] - 1 THEN a ELSE list_concat(a, x) END)"
    return sql.replace("apart(keys, k)", places)


def ring_sql(source: str) -> str:
    """Indices of rings whose bonds have a text's symbols as labels: the first move cuts the ring into paths, then by brute force."""
    canon = lambda x: f"least({x}, reverse({x}))"
    arc_a, arc_b = "substr(r, a, k)", "substr(r, b, k)"
    return f"""
WITH RECURSIVE base AS (SELECT DISTINCT text, length(text) AS n, text || text || text AS r FROM ({source}) WHERE length(text) > 2), s(id, frags, saved) AS (
    (SELECT text, list_sort(list_transform(list_filter([{arc_a}, substr(r, a + k, b - a - k), substr(r, b + k, a + n - b - k)], lambda x: length(x) > 1), lambda x: {canon("x")})), k - 1
    FROM base, unnest(range(2, n // 2 + 1)) t1(k), unnest(range(1, n + 1)) t2(a), unnest(range(a + k, a + n - k + 1)) t3(b)
    WHERE {canon(arc_a)} = {canon(arc_b)}
    UNION SELECT text, [], 0 FROM base)
    UNION
    SELECT id, list_sort(list_transform(list_filter(rest || [keep], lambda x: length(x) > 1), lambda x: {canon("x")})), saved + length(keep) - 1
    FROM (
        SELECT s.id, s.saved, substr(s.frags[i], a, k) AS keep,
            CASE WHEN i = j THEN list_concat(s.frags[1:i - 1], s.frags[i + 1:], [substr(s.frags[i], 1, a - 1), substr(s.frags[i], a + k, b - a - k), substr(s.frags[i], b + k)])
            ELSE list_concat(s.frags[1:i - 1], s.frags[i + 1:j - 1], s.frags[j + 1:], [substr(s.frags[i], 1, a - 1), substr(s.frags[i], a + k), substr(s.frags[j], 1, b - 1), substr(s.frags[j], b + k)]) END AS rest
        FROM s, unnest(range(1, len(s.frags) + 1)) t1(i), unnest(range(i, len(s.frags) + 1)) t2(j),
            unnest(range(2, least(length(s.frags[i]), length(s.frags[j])) + 1)) t3(k),
            unnest(range(1, length(s.frags[i]) - k + 2)) t4(a), unnest(range(1, length(s.frags[j]) - k + 2)) t5(b)
        WHERE (i < j OR b >= a + k) AND {canon("substr(s.frags[i], a, k)")} = {canon("substr(s.frags[j], b, k)")}
    )
)
SELECT id AS text, CAST(length(id) - 1 - max(saved) AS INTEGER) AS assembly_index FROM s GROUP BY id
"""


def ring_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring for each distinct order string of three symbols or more: equal atoms, a bond per symbol (A, N, R as 1, 2, 3)."""
    rows = distinct_order_strings(spark, sf_dir).where(F.length("text") > 2)
    codes = F.transform(F.split("text", ""), lambda c: F.instr(F.lit("ANR"), c))
    n = F.length("text")
    bond = lambda c, i: F.struct(F.when(i + 1 < n, i).otherwise(0).alias("src"), F.when(i + 1 < n, i + 1).otherwise(n - 1).alias("dst"), c.cast("int").alias("label"))
    return rows.select("text", F.array_repeat(F.lit("C"), n).alias("labels"), F.transform(codes, bond).alias("edges"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly_of_graphs(ring_graphs(spark, sf_dir), GraphOptions()).select("text", "assembly_index")


def _bounds(source, reverse: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = source(spark, sf_dir).select("text").where("text <> ''").distinct()
        solved = assembly_of_strings(texts, "text", StringOptions(algorithm="repair", accept_reversed=reverse))
        return solved.select("text", F.col("assembly_index").alias("upper_bound"), "rule_count", "remaining_fragments")

    return query


def _grammars(source, reverse: bool):
    """Re-Pair of all texts in rounds over the table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = source(spark, sf_dir).select("text").where("text <> ''").distinct().select(F.col("text").alias("id"), "text")
        return repair_bounds(texts, reverse).withColumnRenamed("id", "text")

    return query


def _path_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph Re-Pair on paths: what string Re-Pair with reversal gives for the bonds' symbols."""
    solved = assembly_of_graphs(path_graphs(spark, sf_dir), GraphOptions(algorithm="repair"))
    return solved.select(F.col("graph_id").alias("text"), F.col("assembly_index").alias("upper_bound"), "rule_count", "remaining_fragments")


def _path_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in rounds over all paths' strings."""
    strings = path_strings(path_graphs(spark, sf_dir)).select(F.col("graph_id").alias("id"), "text")
    return repair_bounds(strings, True).withColumnRenamed("id", "text")


def _repair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far Re-Pair bounds are from exact indices, and how often they are better than trivial ones."""
    texts = distinct_order_strings(spark, sf_dir).select("text")
    exact = assembly_of_strings(texts, "text").select("text", F.col("assembly_index").alias("exact"), F.col("trivial_bound").alias("trivial"))
    bound = assembly_of_strings(texts, "text", StringOptions(algorithm="repair")).select("text", F.col("assembly_index").alias("bound"))
    by = stats.bound_quality(exact.join(bound, "text").select(F.length("text").cast("bigint").alias("symbols"), "exact", "bound", "trivial"), ["symbols"])
    return by.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in by.dtypes])


def quality_sql() -> str:
    from joinery.queries.strings import index_sql

    return f"""
WITH e AS ({index_sql(ORDERS_SQL, False)}), r AS ({_apart(repair_sql(ORDERS_SQL, False))}), x AS (
    SELECT length(text) AS n, assembly_index AS e, upper_bound AS b, length(text) - 1 AS t FROM e JOIN r USING (text))
SELECT n AS symbols, count(*) AS n, count(*) FILTER (b < t) AS improved, count(*) FILTER (b = t) AS unchanged, count(*) FILTER (b > t) AS worse, count(*) FILTER (b = e) AS tight,
    round(avg(b - e), 6) AS mean_gap, round(quantile_cont(CAST(b - e AS DOUBLE), 0.5), 6) AS median_gap, CAST(max(b - e) AS INTEGER) AS largest_gap FROM x GROUP BY n
"""


_BOTH_SQL = f"SELECT text FROM ({ORDERS_SQL}) UNION SELECT text FROM ({NAMES_SQL})"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_order_strings(spark, sf_dir).select("text").unionByName(names(spark, sf_dir))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_strings(spark, sf_dir).select("text")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-Pair bounds of whole user strings and benchmark texts (too long for exact search)."""
    texts = user_strings(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    return assembly_of_strings(texts, "text", StringOptions(algorithm="repair")).select("text", "assembly_index", "trivial_bound", "rule_count", "remaining_fragments", "upper_bound_only")


def long_sql(source: str) -> str:
    """Re-Pair rows of each text of source, with what string_repair_long shows of them."""
    return f"""
WITH texts AS ({source}), r AS ({_apart(repair_sql(source, False))})
SELECT text, upper_bound AS assembly_index, CAST(length(text) - 1 AS INTEGER) AS trivial_bound, rule_count, remaining_fragments, true AS upper_bound_only FROM texts JOIN r USING (text)
"""


QUERIES = {
    "string_repair_long": (_long, long_sql(f"SELECT text FROM ({USERS_SQL}) UNION ALL SELECT text FROM benchmark")),
    "graph_ring_index": (_rings, ring_sql(ORDERS_SQL)),
    "graph_repair_bounds": (_path_bounds, _apart(repair_sql(ORDERS_SQL, True))),
    "graph_repair_paths": (_path_grammars, _apart(repair_sql(ORDERS_SQL, True))),
    "string_repair_bounds": (_grammars(_both, False), _apart(repair_sql(_BOTH_SQL, False))),
    "string_repair_bounds_reversed": (_grammars(_both, True), _apart(repair_sql(_BOTH_SQL, True))),
    "string_repair_searched": (_bounds(_both, False), _apart(repair_sql(_BOTH_SQL, False))),
    "string_repair_users": (_grammars(_users, False), _apart(repair_sql(USERS_SQL, False))),
    "bound_quality_repair": (_repair_quality, quality_sql()),
}
