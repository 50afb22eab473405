"""Queries on scalar functions, masks, ordering and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.functions import scalars as fn
from joinery.operators import graphs as graph_ops
from joinery.operators import masks
from joinery.operators import strings as string_ops
from joinery.operators.selection import first_disjoint, first_disjoint_in_rows
from joinery.queries.objects import DISTINCT_SQL, GRAPH_SQL, distinct_order_strings, order_graphs
from joinery.runtime import table

big = lambda c: c.cast("bigint")


def _arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of parts: n units is the size, k follows from the key."""
    part = table(spark, sf_dir, "part").select("p_partkey", big(F.col("p_size")).alias("n"), (F.col("p_partkey") % 7 + 2).alias("k"))
    n, k = F.col("n"), F.col("k")
    return part.select(
        "p_partkey",
        big(fn.ceil_log2(n)).alias("ceil_log2"),
        fn.packing_bound(n, k).alias("packing"),
        big(fn.eligible_packing_bound(n, k, F.floor(n / 2))).alias("eligible_packing"),
        fn.trivial_bound(n).alias("trivial"),
        fn.compensated(n, k).alias("compensated"),
        fn.bond_colour(n).alias("colour"),
        big(fn.worker_budget(n * n * 1000)).alias("workers"),
        fn.work_estimate(n, k).alias("work"),
        big(fn.shard_of(F.col("p_partkey"), 13)).alias("shard"),
    )


ARITHMETIC_SQL = """
WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, p_partkey % 7 + 2 AS k FROM part), q AS (SELECT *, (n // 2) // k AS g, (n * n * 1000 + 32767) // 32768 AS units FROM p)
SELECT p_partkey, CASE WHEN n > 1 THEN CAST(length(bin(n - 1)) AS BIGINT) ELSE 0 END AS ceil_log2, n - (n + k - 1) // k AS packing,
    n - g - ((n - g * k) + (k - 1) - 1) // (k - 1) AS eligible_packing, n - 1 AS trivial, n - greatest(k - 1, 0) AS compensated,
    CASE n WHEN 1 THEN 'single' WHEN 2 THEN 'double' WHEN 3 THEN 'triple' ELSE CAST(n AS VARCHAR) END AS colour,
    CASE WHEN n * n * 1000 < 32768 THEN 1 ELSE greatest(8, CAST(pow(2, CASE WHEN units > 1 THEN length(bin(units - 1)) ELSE 0 END) AS BIGINT)) END AS workers,
    n * greatest(k, 1) AS work, p_partkey % 13 AS shard
FROM q
"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 24 + 1).alias("n")).distinct()
    return sizes.select("n", big(fn.chain_length(F.col("n"))).alias("chain_length"))


CHAIN_SQL = """
WITH RECURSIVE chains(c) AS (SELECT [CAST(1 AS BIGINT)] UNION SELECT c || [x + y] FROM (SELECT c, unnest(c) AS x FROM chains), unnest(c) t(y) WHERE x + y > c[-1] AND x + y <= 24 AND len(c) < 7)
SELECT n, min(len(c) - 1) AS chain_length FROM (SELECT DISTINCT l_partkey % 24 + 1 AS n FROM lineitem) JOIN chains ON c[-1] = n GROUP BY n
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return distinct_order_strings(spark, sf_dir).select(
        "text",
        F.reverse(text).alias("reversed"),
        fn.canonical_text(text, True).alias("canonical"),
        fn.is_palindrome(text).alias("palindrome"),
        fn.symbols(text, F.lit(1), F.lit(2)).alias("part"),
        big(F.size(fn.code_points(text))).alias("symbols"),
        fn.content_digest(text.cast("binary")).alias("digest"),
        fn.strict_integer(F.concat(F.length(text).cast("string"), F.when(F.col("n") % 2 == 0, " ").otherwise(""))).alias("number"),
        fn.trim_spaces(F.concat(F.lit("  "), text, F.lit("\t "))).alias("trimmed"),
        fn.is_molfile(F.concat(text, F.when(F.col("n") % 3 == 0, ".MOL").when(F.col("n") % 3 == 1, ".sdf").otherwise(".mo"))).alias("molfile"),
        F.array_join(fn.state_key(fn.code_points(text)), "").alias("key"),
    )


TEXTS_SQL = f"""
SELECT text, reverse(text) AS reversed, least(text, reverse(text)) AS canonical, text = reverse(text) AS palindrome, substr(text, 2, 2) AS part, length(text) AS symbols, sha256(text) AS digest,
    CASE WHEN n % 2 = 0 THEN NULL ELSE length(text) END AS number, text || chr(9) AS trimmed, n % 3 < 2 AS molfile, text[1] || array_to_string(list_sort(string_split(text[2:], '')), '') AS key
FROM ({DISTINCT_SQL})
"""


def _utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, and the same with a byte that cannot stand there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    broken = docs.select("doc_id", F.concat("data", F.unhex(F.lit("C0AF"))).alias("data"))
    both = docs.withColumn("whole", F.lit(True)).unionByName(broken.withColumn("whole", F.lit(False)))
    return both.select("doc_id", "whole", fn.valid_utf8(F.col("data")).alias("valid"))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on the parts and suppliers (modulo 40) of each order as bit sets."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 40)).alias("a"), F.array_sort(F.collect_set(F.col("l_suppkey") % 40)).alias("b"))
    a, b = F.col("a"), F.col("b")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return sets.select(
        "id",
        text(fn.mask_union(a, b)).alias("either"),
        text(fn.mask_common(a, b)).alias("common"),
        text(fn.mask_minus(a, b)).alias("minus"),
        text(fn.mask_either(a, b)).alias("one_only"),
        fn.mask_contains(a, b).alias("contains"),
        fn.masks_disjoint(a, b).alias("disjoint"),
        big(F.size(a)).alias("members"),
        fn.next_member(a, F.lit(20)).alias("next_from_20"),
    )


MASKS_SQL = """
WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey % 40)) AS a, list_sort(list(DISTINCT l_suppkey % 40)) AS b FROM lineitem GROUP BY 1)
SELECT id, array_to_string(list_sort(list_distinct(a || b)), ',') AS either, array_to_string(list_sort(list_intersect(a, b)), ',') AS common,
    array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS minus,
    array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x)) || list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS one_only,
    list_has_all(a, b) AS contains, NOT list_has_any(a, b) AS disjoint, len(a) AS members, list_min(list_filter(a, lambda x: x >= 20)) AS next_from_20
FROM s
"""


def _occurrence(at) -> dict:
    """A run of two bonds with its labels' class; at gives the columns of the pair."""
    low, high = F.least(at("left_label"), at("right_label")), F.greatest(at("left_label"), at("right_label"))
    canon = F.concat_ws("-", low.cast("string"), high.cast("string"))
    return {"canon": canon, "ix": at("left_edge") * 100 + at("right_edge"), "mask": F.array(big(at("left_edge")), big(at("right_edge")))}


def _occurrence_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame | None]:
    """Runs of two bonds of the order graphs: of small graphs as rows (graph_id, occ) with their masks' words, of larger ones, if any, as a table."""
    small, large = graph_ops.parted(order_graphs(spark, sf_dir))
    each = lambda p: [c.alias(n) for n, c in _occurrence(lambda c: p[c]).items()]
    word = lambda p: masks.word(F.array(p["left_edge"], p["right_edge"])).alias("bits")
    rows = graph_ops.held(graph_ops.pairs_in_rows(small, "label"), occ=F.transform("pairs", lambda p: F.struct(*each(p), word(p))))
    return rows, None if large is None else _occurrence_table(large)


def _occurrence_table(graphs: DataFrame) -> DataFrame:
    """Runs of two bonds of graphs of any size."""
    pairs = graph_ops.incident_pairs(graph_ops.exploded(graphs)[1], "label")
    return pairs.select("graph_id", *[c.alias(n) for n, c in _occurrence(F.col).items()])


def _occurrences(spark, sf_dir) -> DataFrame:
    """All runs of _occurrence_rows() as a table."""
    rows, others = _occurrence_rows(spark, sf_dir)
    return graph_ops.joined_by(rows.select("graph_id", F.explode("occ").alias("o")).select("graph_id", "o.canon", "o.ix", "o.mask"), others, lambda o: o)


_OCC = f"""{GRAPH_SQL}, occ AS (SELECT DISTINCT a.graph_id, CAST(least(a.label, b.label) AS VARCHAR) || '-' || CAST(greatest(a.label, b.label) AS VARCHAR) AS canon, a.edge_ix * 100 + b.edge_ix AS ix, [a.edge_ix, b.edge_ix] AS mask
    FROM bonds a JOIN bonds b ON a.graph_id = b.graph_id AND a.edge_ix < b.edge_ix AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst)))"""


def _class_pairs(spark, sf_dir):
    rows, others = _occurrence_rows(spark, sf_dir)
    found = graph_ops.joined_by(graph_ops.class_pairs_in_rows(rows, meeting=False), others, graph_ops.disjoint_class_pairs)
    return found.select("graph_id", "canon", big(F.col("left")).alias("left_ix"), big(F.col("right")).alias("right_ix"))


CLASS_PAIRS_SQL = f"WITH {_OCC} SELECT a.graph_id, a.canon, a.ix AS left_ix, b.ix AS right_ix FROM occ a JOIN occ b ON a.graph_id = b.graph_id AND a.canon = b.canon AND a.ix < b.ix AND NOT list_has_any(a.mask, b.mask)"


def _class_unions(spark, sf_dir):
    rows, others = _occurrence_rows(spark, sf_dir)
    found = graph_ops.joined_by(graph_ops.unions_in_rows(rows), others, graph_ops.class_unions)
    return found.select("graph_id", "canon", F.array_join(F.transform("mask", lambda x: x.cast("string")), ",").alias("mask"))


CLASS_UNIONS_SQL = f"WITH {_OCC} SELECT graph_id, canon, array_to_string(list_sort(list_distinct(flatten(list(mask)))), ',') AS mask FROM occ GROUP BY 1, 2"


def _words(spark, sf_dir):
    """Parts of each customer's lines modulo 200 as packed sets: how many, the first, the first from 100 on."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 200).alias("member"))
    owned = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_custkey", F.array("member").alias("mask"))
    words = masks.packed(owned, ["o_custkey"])
    first, later = masks.next_member(words, ["o_custkey"], 0), masks.next_member(words, ["o_custkey"], 100)
    out = masks.sizes(words, ["o_custkey"]).join(first, "o_custkey").join(later.withColumnRenamed("next", "next_from_100"), "o_custkey", "left")
    return out.select("o_custkey", "members", F.col("next").alias("first_member"), "next_from_100")


WORDS_SQL = """SELECT o_custkey, count(DISTINCT l_partkey % 200) AS members, min(l_partkey % 200) AS first_member, min(l_partkey % 200) FILTER (l_partkey % 200 >= 100) AS next_from_100 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"""


def _overlaps(spark, sf_dir):
    rows, others = _occurrence_rows(spark, sf_dir)
    keys = ["graph_id", "canon"]
    found = graph_ops.joined_by(graph_ops.class_pairs_in_rows(rows, meeting=True), others, lambda o: masks.overlapping_pairs(masks.packed(o, [*keys, "ix"]), keys))
    return found.select("graph_id", "canon", F.col("left").alias("left_ix"), F.col("right").alias("right_ix"))


def _selected(spark, sf_dir):
    """Of each class of bond pairs of an order graph, the pairs a greedy choice takes, by their number, so that no bond is in two."""
    rows, others = _occurrence_rows(spark, sf_dir)
    pairs = lambda occ: occ.select(F.struct("graph_id", "canon").alias("id"), F.col("ix").alias("rank"), F.col("mask").alias("members"))
    in_rounds = lambda occ: first_disjoint(pairs(occ)).select("id.graph_id", "id.canon", F.col("rank").alias("ix"))
    found = graph_ops.joined_by(first_disjoint_in_rows(rows), others, in_rounds)
    return found.select("graph_id", "canon", big(F.col("ix")).alias("ix"))


SELECTED_SQL = f"""WITH {_OCC}, sorted AS (SELECT graph_id, canon, list_transform(list(mask ORDER BY ix), lambda m: [m]) AS pairs FROM occ GROUP BY 1, 2)
SELECT graph_id, canon, p[1] * 100 + p[2] AS ix FROM (SELECT graph_id, canon, unnest(list_reduce(pairs, lambda a, x: CASE WHEN list_has_any(flatten(a), x[1]) THEN a ELSE list_concat(a, x) END)) AS p FROM sorted)"""


def _first_seen(spark, sf_dir):
    rows, others = _occurrence_rows(spark, sf_dir)
    found = graph_ops.joined_by(graph_ops.first_seen_in_rows(rows, "ix"), others, lambda o: graph_ops.first_seen_ids(o, "ix"))
    return found.select("graph_id", "canon", big(F.col("class_id")).alias("class_id"))


FIRST_SEEN_SQL = f"WITH {_OCC} SELECT graph_id, canon, row_number() OVER (PARTITION BY graph_id ORDER BY min(ix)) - 1 AS class_id FROM occ GROUP BY graph_id, canon"


def _dominance(spark, sf_dir):
    """Orders' lines as states (part modulo 500 as key): those of later lines against those of first lines."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("key"), F.col("l_quantity").cast("int").alias("saved"), "l_linenumber")
    return graph_ops.undominated(lines.where("l_linenumber > 1"), lines.where("l_linenumber = 1"))


DOMINANCE_SQL = """
WITH l AS (SELECT l_partkey % 500 AS key, CAST(trunc(l_quantity) AS INTEGER) AS saved, l_linenumber AS n FROM lineitem)
SELECT a.key, a.saved FROM (SELECT key, max(saved) AS saved FROM l WHERE n > 1 GROUP BY key) a LEFT JOIN (SELECT key, max(saved) AS known FROM l WHERE n = 1 GROUP BY key) b USING (key) WHERE known IS NULL OR known < a.saved
"""


def _running(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id"), F.col("p_size").alias("size")).agg(F.max(F.col("p_partkey") % 101).alias("bound"))
    return string_ops.running_best(rows)


RUNNING_SQL = """SELECT id, size, bound, max(bound) OVER (PARTITION BY id ORDER BY size ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT p_brand AS id, p_size AS size, max(p_partkey % 101) AS bound FROM part GROUP BY 1, 2)"""


def _top(spark, sf_dir):
    """The three largest parts of each brand, longest first, then by key; and limits of the whole."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    return table(spark, sf_dir, "part").withColumn("place", rank).where("place <= 3").select("p_brand", "place", "p_partkey", "p_size")


TOP_SQL = "SELECT p_brand, place, p_partkey, p_size FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS place FROM part) WHERE place <= 3"


def _limited(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def _except(spark, sf_dir):
    """Customers without orders: fixtures that nothing refers to."""
    all_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("molecule"))
    from joinery.sources.manifests import unreferenced

    return unreferenced(all_, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("molecule")))


def _audit(spark, sf_dir):
    """Groups of documents of equal content, and whether their languages conflict."""
    from joinery.sources.manifests import content_audit

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), F.col("source").alias("expected"))
    return content_audit(docs).select("digest", "n", F.array_join("names", ",").alias("names"), "conflicting")


AUDIT_SQL = """SELECT sha256(text) AS digest, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS names, count(DISTINCT source) > 1 AS conflicting FROM documents GROUP BY 1 HAVING count(*) > 1"""

QUERIES = {
    "scalar_arithmetic": (_arithmetic, ARITHMETIC_SQL),
    "scalar_chain_length": (_chain, CHAIN_SQL),
    "scalar_texts": (_texts, TEXTS_SQL),
    "scalar_utf8": (_utf8, "SELECT doc_id, whole, whole AS valid FROM documents, (VALUES (true), (false)) t(whole)"),
    "mask_operations": (_masks, MASKS_SQL),
    "class_disjoint_pairs": (_class_pairs, CLASS_PAIRS_SQL),
    "class_unions": (_class_unions, CLASS_UNIONS_SQL),
    "mask_words": (_words, WORDS_SQL),
    "class_overlapping_pairs": (_overlaps, CLASS_PAIRS_SQL.replace("AND NOT list_has_any", "AND list_has_any")),
    "class_disjoint_selection": (_selected, SELECTED_SQL),
    "class_first_seen": (_first_seen, FIRST_SEEN_SQL),
    "state_dominance": (_dominance, DOMINANCE_SQL),
    "running_best": (_running, RUNNING_SQL),
    "top_largest": (_top, TOP_SQL),
    "limit_orders": (_limited, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "except_unreferenced": (_except, "SELECT c_custkey AS molecule FROM customer EXCEPT ALL SELECT DISTINCT o_custkey FROM orders"),
    "content_audit": (_audit, AUDIT_SQL),
}
