"""Queries on strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.kernels import string_repair, strings as kernel
from joinery.operators import ranks, strings as ops
from joinery.operators.frontier import assembly_frontier
from joinery.plans.options import StringOptions
from joinery.plans.solve import assembly_of_strings
from joinery.queries.objects import DISTINCT_SQL, NAMES_SQL, ORDERS_SQL, USERS_SQL, distinct_order_strings, names, order_strings, user_strings
from joinery.runtime import ship, table
from joinery.sources.files import records


def index_sql(source: str, reverse: bool) -> str:
    """Brute force by recursion over lists of fragments: all moves, distinct states, least index."""
    canon = lambda x: f"least({x}, reverse({x}))" if reverse else x
    return f"""
WITH RECURSIVE base AS (SELECT DISTINCT text FROM ({source})), s(id, frags, saved) AS (
    SELECT text, [text], 0 FROM base
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


def _indices(source, options: StringOptions):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return assembly_of_strings(source(spark, sf_dir).select("text").distinct(), "text", options).select("text", "assembly_index")

    return query


def _frontier(source, reverse: bool):
    """Indices from the frontier of all texts' states."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = source(spark, sf_dir).select("text").distinct().select(F.col("text").alias("id"), "text")
        return assembly_frontier(texts, reverse).select(F.col("id").alias("text"), "assembly_index")

    return query


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest index of the orders of each priority."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    solved = assembly_of_strings(order_strings(spark, sf_dir), "text").select("id", "text", "assembly_index")
    return solved.join(orders, "id").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("assembly_index"), 6).alias("mean_index"), F.max("assembly_index").alias("largest_index"), F.sum(F.length("text")).cast("bigint").alias("symbols"))


FLAGSHIP_SQL = f"""
WITH strings AS ({ORDERS_SQL}), solved AS ({index_sql(ORDERS_SQL, False)})
SELECT o_orderpriority, count(*) AS n, round(avg(assembly_index), 6) AS mean_index, max(assembly_index) AS largest_index, CAST(sum(length(text)) AS BIGINT) AS symbols
FROM strings JOIN solved USING (text) JOIN orders ON o_orderkey = id GROUP BY 1
"""


def _order_strings_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_order_strings(spark, sf_dir).select("text").unionByName(names(spark, sf_dir))


def _symbols(spark, sf_dir):
    return ops.symbol_counts(user_strings(spark, sf_dir))


def _profile(spark, sf_dir):
    return ops.symbol_profile(user_strings(spark, sf_dir)).select("id", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


_POS = f"pos AS (SELECT id, unnest(range(length(text))) AS pos, text FROM ({ORDERS_SQL})), sym AS (SELECT id, pos, substr(text, pos + 1, 1) AS symbol FROM pos)"
RUNS_SQL = f"""
WITH {_POS}, kept AS (SELECT *, count(*) OVER (PARTITION BY id, symbol) AS n FROM sym QUALIFY n >= 2),
isl AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM kept)
SELECT id, CAST(min(pos) AS INTEGER) AS "offset", CAST(count(*) AS INTEGER) AS length FROM isl GROUP BY id, g HAVING count(*) > 1
"""


def _occ(spark, sf_dir, reverse=False):
    return ops.occurrences(distinct_order_strings(spark, sf_dir).select("id", "text"), reverse)


def _occ_sql(reverse: bool = False) -> str:
    part = "substr(text, o + 1, k)"
    canon = f"least({part}, reverse({part}))" if reverse else part
    return f"""occ AS (SELECT id, CAST(o AS INTEGER) AS "offset", CAST(k AS INTEGER) AS length, {canon} AS canon FROM ({DISTINCT_SQL}),
    unnest(range(2, length(text) // 2 + 1)) t(k), unnest(range(0, length(text) - k + 1)) u(o))"""


def _classes(reverse):
    return lambda spark, sf_dir: ops.class_summary(_occ(spark, sf_dir, reverse)).withColumnRenamed("first", "first_offset").withColumnRenamed("last", "last_offset")


def _classes_sql(reverse):
    return f"""WITH {_occ_sql(reverse)} SELECT id, canon, length, count(*) AS n, min("offset") AS first_offset, max("offset") AS last_offset, max("offset") - min("offset") >= length AS valid FROM occ GROUP BY id, canon, length"""


def _pairs(spark, sf_dir):
    return ops.disjoint_pairs(_occ(spark, sf_dir))


PAIRS_SQL = f"""WITH {_occ_sql()} SELECT a.id, a.canon, a.length, a."offset" AS left_offset, b."offset" AS right_offset FROM occ a JOIN occ b ON a.id = b.id AND a.canon = b.canon AND a."offset" + a.length <= b."offset" """

PAIRABLE_SQL = f"""WITH {_occ_sql(True)} SELECT * FROM occ a WHERE EXISTS (SELECT 1 FROM occ b WHERE a.id = b.id AND a.canon = b.canon AND a.length = b.length AND abs(a."offset" - b."offset") >= a.length)"""


def _document_classes(reverse: bool):
    """How many classes of duplicates whole documents have at each size 2, 4, 8, ..., of how many places, the latest first place and the longest reach."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
        found = ranks.duplicate_classes(docs, reverse)
        counts = [F.count("*").alias("classes"), F.sum("n").alias("places"), F.sum(F.col("valid").cast("long")).alias("valid_classes"), F.max("first").alias("latest_first"), F.max(F.col("last") - F.col("first")).alias("longest_reach")]
        return found.groupBy(F.col("id").alias("doc_id"), "length").agg(*counts)

    return query


def document_classes_sql(reverse: bool, sizes: int = 16) -> str:
    """The same by spelling out the substrings of places that recur at half the size; 2^16 symbols are more than any table's text has twice."""
    canon = "least(s, reverse(s))" if reverse else "s"
    own = "OR s = reverse(s)" if reverse else ""
    level = lambda k, source: f"""l{k} AS (
    SELECT doc_id, o, {canon} AS s, count(*) OVER (PARTITION BY doc_id, {canon}) AS n
    FROM (SELECT doc_id, o, substr(text, o + 1, {2**k}) AS s FROM {source} JOIN documents USING (doc_id) WHERE length(text) >= o + {2**k}) QUALIFY n > 1 {own})"""  # noqa: E731
    levels = ", ".join([level(1, "(SELECT doc_id, unnest(range(length(text))) AS o FROM documents)"), *(level(k, f"l{k - 1}") for k in range(2, sizes + 1))])
    classes = " UNION ALL ".join(f"SELECT doc_id, {2**k} AS length, s, count(*) AS n, min(o) AS f, max(o) AS l FROM l{k} WHERE n > 1 GROUP BY 1, 2, 3" for k in range(1, sizes + 1))
    return f"""WITH {levels}, classes AS ({classes})
SELECT doc_id, length, count(*) AS classes, CAST(sum(n) AS BIGINT) AS places, count(*) FILTER (l - f >= length) AS valid_classes, max(f) AS latest_first, max(l - f) AS longest_reach FROM classes GROUP BY 1, 2"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals per order: from the line's part number modulo 60, as long as its quantity modulo 9 plus 1."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 60).cast("int").alias("offset"), (F.col("l_quantity").cast("int") % 9 + 1).alias("length"))


_LINES_SQL = "lines AS (SELECT l_orderkey AS id, CAST(l_partkey % 60 AS INTEGER) AS o, CAST(CAST(trunc(l_quantity) AS INTEGER) % 9 + 1 AS INTEGER) AS k FROM lineitem)"
_COVERED = f"{_LINES_SQL}, covered AS (SELECT DISTINCT id, unnest(range(o, o + k)) AS p FROM lines)"
UNION_SQL = f"""
WITH {_COVERED}, isl AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM covered)
SELECT id, CAST(min(p) AS INTEGER) AS "offset", CAST(count(*) AS INTEGER) AS length FROM isl GROUP BY id, g
"""


def _complement(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return ops.interval_complement(lines.select("id").distinct().select("id", F.lit(70).alias("length")), lines)


COMPLEMENT_SQL = f"""
WITH {_COVERED}, free AS (SELECT id, p FROM (SELECT DISTINCT id FROM lines), unnest(range(0, 70)) t(p) EXCEPT SELECT id, p FROM covered),
isl AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM free)
SELECT id, CAST(min(p) AS INTEGER) AS "offset", CAST(count(*) AS INTEGER) AS length FROM isl GROUP BY id, g
"""


def _containing(spark, sf_dir):
    strings = distinct_order_strings(spark, sf_dir).select("id", "text")
    return ops.containing(ops.repeated_runs(strings), ops.occurrences(strings))


CONTAINING_SQL = f"""
WITH {_occ_sql()}, sym AS (SELECT id, p, substr(text, p + 1, 1) AS symbol FROM ({DISTINCT_SQL}), unnest(range(length(text))) t(p)),
kept AS (SELECT *, count(*) OVER (PARTITION BY id, symbol) AS n FROM sym QUALIFY n >= 2),
isl AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM kept),
runs AS (SELECT id, CAST(min(p) AS INTEGER) AS ro, CAST(count(*) AS INTEGER) AS rn FROM isl GROUP BY id, g HAVING count(*) > 1)
SELECT o.id, o."offset", o.length, ro AS part_offset, rn AS part_length FROM occ o LEFT JOIN runs r ON r.id = o.id AND ro <= "offset" AND ro + rn >= "offset" + length
"""


def _next(spark, sf_dir):
    occ = _occ(spark, sf_dir)
    asked = ops.class_summary(occ).select("id", "canon", F.lit(1).alias("start"), F.length("id").alias("stop"))
    return ops.next_occurrence(occ, asked)


NEXT_SQL = f"""WITH {_occ_sql()} SELECT id, canon, 1 AS start, CAST(length(id) AS INTEGER) AS stop, min("offset") FILTER ("offset" >= 1) AS "offset" FROM occ GROUP BY id, canon"""


def _floors(spark, sf_dir):
    return ops.chain_floor(distinct_order_strings(spark, sf_dir).select("id", "text"))


FLOOR_SQL = f"""
WITH RECURSIVE strings AS ({DISTINCT_SQL}), top AS (SELECT max(length(text)) AS m FROM strings),
chains(c) AS (SELECT [CAST(1 AS BIGINT)] UNION SELECT c || [x + y] FROM (SELECT c, unnest(c) AS x FROM chains), unnest(c) t(y), top WHERE x + y > c[-1] AND x + y <= m AND len(c) < 7),
l AS (SELECT c[-1] AS n, min(len(c) - 1) AS steps FROM chains GROUP BY 1),
sym AS (SELECT id, symbol, count(*) AS n FROM (SELECT id, unnest(string_split(text, '')) AS symbol FROM strings) WHERE symbol <> '' GROUP BY 1, 2)
SELECT s.id, CAST(t.steps AS INTEGER) AS scalar_floor, CAST(greatest(t.steps, s.by_symbol, s.kinds - CASE WHEN s.most = 1 THEN 1 ELSE 0 END) AS INTEGER) AS vector_floor
FROM (SELECT id, sum(sym.n) AS total, count(*) AS kinds, max(sym.n) AS most, max(l.steps) AS by_symbol FROM sym JOIN l USING (n) GROUP BY id) s JOIN l t ON t.n = s.total
"""


def _checked(spark: SparkSession, sf_dir: str, check) -> DataFrame:
    """text and the boolean columns that check(text) gives."""
    ship(spark)
    rows = distinct_order_strings(spark, sf_dir).select("text")
    names_ = list(check("ABAB"))
    schema = ", ".join(["text string", *(f"{n} boolean" for n in names_)])

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.concat([batch, pd.DataFrame([check(t) for t in batch["text"]], columns=names_, index=batch.index)], axis=1)

    return rows.mapInPandas(run, schema)


def check_repair(text: str) -> dict:
    grammar, exact = string_repair.repair(text), kernel.solve(text).index
    turned = string_repair.repair(text, True)
    return {
        "replays": string_repair.replay(grammar.certificate()) == grammar.bound and string_repair.replay(turned.certificate()) == turned.bound,
        "not_below_exact": grammar.bound >= exact,
        "not_above_trivial": grammar.bound <= len(text) - 1,
        "witness_costs_the_same": kernel.replay(text, grammar.witness()) == grammar.bound,
    }


def check_pathway(text: str) -> dict:
    plain, turned = kernel.solve(text), kernel.solve(text, True)
    left = kernel.pathway(text, plain.steps)["remnant"][0]
    return {
        "replays": kernel.replay(text, plain.steps) == plain.index and kernel.replay(text, turned.steps, True) == turned.index,
        "reversal_not_worse": turned.index <= plain.index,
        "whole_reversed_is_equal": kernel.solve(text[::-1]).index == plain.index,
        "remnant_matches_text": all(text[p : p + len(f)] == f for f, p in zip(left["Fragments"], left["Positions"], strict=True)),
    }


def _all_true(check) -> str:
    return f"SELECT text, {', '.join(f'true AS {n}' for n in check('ABAB'))} FROM ({DISTINCT_SQL})"


def _first_digram(spark, sf_dir):
    return ops.best_digram(distinct_order_strings(spark, sf_dir).select("id", "text")).select("id", "canon", "saving", F.col("first").alias("first_offset"))


DIGRAM_SQL = f"""
WITH d AS (SELECT id, p, substr(text, p + 1, 2) AS canon FROM ({DISTINCT_SQL}), unnest(range(length(text) - 1)) t(p)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY id, canon ORDER BY p) AS g FROM d),
runs AS (SELECT id, canon, (count(*) + 1) // 2 AS n, min(p) AS f FROM r GROUP BY id, canon, g),
grp AS (SELECT id, canon, CAST(sum(n) - 1 AS BIGINT) AS saving, CAST(min(f) AS INTEGER) AS first_offset FROM runs GROUP BY id, canon HAVING sum(n) > 1)
SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY id ORDER BY saving DESC, first_offset) = 1
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of texts as files; every second line end is made CR LF."""
    docs = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")).cast("binary")
    return records(docs.select("doc_id", content.alias("content"))).select("doc_id", F.col("line_ix").cast("bigint").alias("line_ix"), F.md5(F.col("text").cast("binary")).alias("digest"))


RECORDS_SQL = r"""
SELECT doc_id, i - 1 AS line_ix, md5(CASE WHEN doc_id % 2 = 1 AND i < len(p) AND ends_with(p[i], chr(13)) THEN left(p[i], length(p[i]) - 1) ELSE p[i] END) AS digest
FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS p FROM documents), unnest(range(1, len(p) + 1)) t(i)
"""


def _leftmost(spark, sf_dir):
    at = order_strings(spark, sf_dir).select("id", F.posexplode(F.split("text", "")).alias("pos", "symbol"))
    return ops.leftmost_apart(at.select(F.concat_ws(" ", "id", "symbol").alias("id"), "pos"))


LEFTMOST_SQL = f"""
WITH {_POS}, r AS (SELECT concat_ws(' ', id, symbol) AS id, pos, pos - row_number() OVER (PARTITION BY id, symbol ORDER BY pos) AS g FROM sym)
SELECT id, CAST(pos AS INTEGER) AS pos FROM r QUALIFY row_number() OVER (PARTITION BY id, g ORDER BY pos) % 2 = 1
"""

def _blocks(spark, sf_dir):
    occ = _occ(spark, sf_dir).withColumn("part", F.floor(F.col("offset") / 4).cast("int"))
    return ops.pair_blocks(occ)


BLOCKS_SQL = f"""WITH {_occ_sql()}, p AS (SELECT id, canon, "offset" AS o, length AS k, CAST("offset" // 4 AS INTEGER) AS part FROM occ)
SELECT a.id, a.canon, a.part AS left_part, b.part AS right_part, count(*) AS pairs FROM p a JOIN p b ON a.id = b.id AND a.canon = b.canon AND (a.part < b.part OR (a.part = b.part AND a.o + a.k <= b.o)) GROUP BY 1, 2, 3, 4"""


def _repair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-Pair bounds of whole documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assembly_of_strings(docs, "text", StringOptions(algorithm="repair")).select("doc_id", "assembly_index", "trivial_bound", "rule_count", "remaining_fragments")


QUERIES = {
    "string_pair_blocks": (_blocks, BLOCKS_SQL),
    "string_repair_documents": (_repair_documents, None),
    "flagship_index_by_priority": (_flagship, FLAGSHIP_SQL),
    "string_index_orders": (_frontier(distinct_order_strings, False), index_sql(ORDERS_SQL, False)),
    "string_index_orders_reversed": (_frontier(distinct_order_strings, True), index_sql(ORDERS_SQL, True)),
    "string_index_names": (_frontier(names, False), index_sql(NAMES_SQL, False)),
    "string_index_searched": (_indices(_order_strings_and_names, StringOptions()), index_sql(f"SELECT text FROM ({ORDERS_SQL}) UNION SELECT text FROM ({NAMES_SQL})", False)),
    "string_index_zero_budget": (
        lambda s, d: assembly_of_strings(distinct_order_strings(s, d), "text", StringOptions(cpu_budget_ns=0)).select("text", "assembly_index", "runtime_limit_reached"),
        f"SELECT text, CAST(length(text) - 1 AS INTEGER) AS assembly_index, length(text) > 1 AS runtime_limit_reached FROM ({DISTINCT_SQL})",
    ),
    "string_symbol_counts": (_symbols, f"SELECT id, symbol, count(*) AS n FROM (SELECT id, unnest(string_split(text, '')) AS symbol FROM ({USERS_SQL})) WHERE symbol <> '' GROUP BY 1, 2"),
    "string_symbol_profile": (_profile, f"SELECT id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS counts FROM (SELECT id, symbol, count(*) AS n FROM (SELECT id, unnest(string_split(text, '')) AS symbol FROM ({USERS_SQL})) WHERE symbol <> '' GROUP BY 1, 2) GROUP BY id"),
    "string_repeated_runs": (lambda s, d: ops.repeated_runs(order_strings(s, d)), RUNS_SQL),
    "string_classes": (_classes(False), _classes_sql(False)),
    "string_classes_reversed": (_classes(True), _classes_sql(True)),
    "string_duplicate_classes": (_document_classes(False), document_classes_sql(False)),
    "string_duplicate_classes_reversed": (_document_classes(True), document_classes_sql(True)),
    "string_disjoint_pairs": (_pairs, PAIRS_SQL),
    "string_pairable": (lambda s, d: ops.pairable(_occ(s, d, True)), PAIRABLE_SQL),
    "interval_union": (lambda s, d: ops.interval_union(_lines(s, d)), UNION_SQL),
    "interval_covered": (lambda s, d: ops.covered_length(_lines(s, d)), f"WITH {_COVERED} SELECT id, count(*) AS covered FROM covered GROUP BY id"),
    "interval_complement": (_complement, COMPLEMENT_SQL),
    "interval_containing": (_containing, CONTAINING_SQL),
    "occurrence_next": (_next, NEXT_SQL),
    "string_chain_floor": (_floors, FLOOR_SQL),
    "string_repair_checks": (lambda s, d: _checked(s, d, check_repair), _all_true(check_repair)),
    "string_pathway_checks": (lambda s, d: _checked(s, d, check_pathway), _all_true(check_pathway)),
    "string_first_digram": (_first_digram, DIGRAM_SQL),
    "string_records": (_records, RECORDS_SQL),
    "string_leftmost": (_leftmost, LEFTMOST_SQL),
}
