"""How the sources of a language differ in their words: a triangular divergence of smoothed integer probabilities.

Words of few documents are left out. Words that occur equally often in each source of their language have one sparse vector
of counts; each pair of sources is evaluated once for a distinct vector and multiplied by the number of its words. A pair
in which a vector has neither source adds the same for every such vector, and one with a single source adds what depends on
that source's count alone, so only pairs of sources that a vector really has are spelled out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.runtime import materialise, ship, spread

#: Bytes of a term, A-Z lowered; all others end one. Bytes of 128 and more belong to letters beyond ASCII.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that a task holds before it hands on its counts.
HELD = 200_000
#: Groups up to which their table is broadcast (about 100 bytes each), and over how many keys it is spread beyond that.
BROADCAST_GROUPS, SALTS = 100_000, 64
SCALE = 1_000_000_000


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), counted in the task as far as memory is bounded."""
    total: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> pa.RecordBatch:
        held = [(lang, source, all_, docs) for (lang, source), (all_, docs) in total.items()]
        langs = pa.array([lang for lang, _, all_, _ in held for _ in all_], pa.string())
        sources = pa.array([source for _, source, all_, _ in held for _ in all_], pa.string())
        terms = pa.array([term for *_, all_, _ in held for term in all_], pa.binary()).cast(pa.string())
        n = pa.array([n for *_, all_, _ in held for n in all_.values()], pa.int64())
        in_docs = pa.array([docs[term] for *_, all_, docs in held for term in all_], pa.int64())
        total.clear()
        return pa.RecordBatch.from_arrays([langs, sources, terms, n, in_docs], ["lang", "source", "term", "n", "docs"])

    new = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            words = texts[i].as_py().translate(TERM_BYTES).split()
            all_, docs = total.setdefault((lang, source), (Counter(), Counter()))
            before = len(all_)
            all_.update(words)
            docs.update(set(words))
            new += len(all_) - before
            if new >= HELD:
                yield handed_on()
                new = 0
    yield handed_on()


def probability(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / whole), exact at any size."""
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return share + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); probabilities are at most SCALE + 1, so that all fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, entries (source, n): terms in at least so many documents of their language."""
    ship(docs.sparkSession)
    parts = spread(docs).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    one = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = one.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries"))
    return each.where(F.col("docs") >= least_docs).select("lang", "term", "entries")


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, terms (V), whole (N + 2 V), lang_whole, p0 (of an absent term): a row for each group that occurs."""
    entry = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(entry, ["lang", "source"], "left").join(size, "lang", "left")
    terms, n = F.coalesce("terms", F.lit(0)), F.coalesce("n", F.lit(0))
    groups = groups.select("lang", "source", terms.alias("terms"), (n + 2 * terms).alias("whole"), n.alias("n"))
    lang = F.sum("n").over(Window.partitionBy("lang")) + 2 * F.col("terms")
    return groups.select("lang", "source", "terms", "whole", lang.alias("lang_whole"), F.when(F.col("terms") > 0, probability(F.lit(0), F.col("whole"))).alias("p0"))


def with_groups(rows: DataFrame, groups: DataFrame, many: int) -> DataFrame:
    """rows (lang, source, ...) and the columns of their group; beyond a size of groups, by a join in which a hot group has many keys."""
    if many <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "_salt"]).drop("_salt")


def rated_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, source, n, p, p0, q: each term that a group has, its probability there and in the language."""
    total = F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    entry = kept.select("lang", "term", total.alias("total"), F.explode("entries").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    joined = with_groups(entry, groups, groups.count())
    return joined.select("lang", "term", "source", "n", probability(F.col("n"), F.col("whole")).alias("p"), "p0", probability(F.col("total"), F.col("lang_whole")).alias("q"))


def vectors(rated: DataFrame) -> DataFrame:
    """lang, entries (source, n, p, p0), m: each distinct sparse vector of counts and how many terms have it."""
    each = rated.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("entries"))
    return each.groupBy("lang", "entries").agg(F.count("*").alias("m"))


def pair_sums(vector: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each two groups of a language, both ways round, summed over all its terms."""
    two = F.flatten(F.transform("entries", lambda x, i: F.transform(F.slice("entries", i + 2, F.size("entries")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    both = vector.select("lang", "m", F.explode(two).alias("t")).select("lang", "m", "t.x", "t.y")
    # against what the two single sources add already
    more = divergence(F.col("x.p"), F.col("y.p")) - divergence(F.col("x.p"), F.col("y.p0")) - divergence(F.col("x.p0"), F.col("y.p")) + divergence(F.col("x.p0"), F.col("y.p0"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(F.col("m") * more).alias("value"))
    one = vector.select("lang", "m", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("a"), F.col("e.p").alias("p"), F.col("e.p0").alias("p0")).agg(F.sum("m").alias("m"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    single = one.join(other, "lang").where("a <> b")
    gain = F.col("m") * (divergence(F.col("p"), F.col("b0")) - divergence(F.col("p0"), F.col("b0")))
    single = single.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), gain.alias("value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    left, right = groups.alias("g"), groups.alias("h")
    none = left.join(right, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") < F.col("h.source")))
    base = F.when(F.col("g.terms") > 0, F.col("g.terms") * divergence(F.col("g.p0"), F.col("h.p0"))).otherwise(0)
    none = none.select("g.lang", F.col("g.source").alias("a"), F.col("h.source").alias("b"), base.alias("value"))
    sums = none.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("e"), "value").select("lang", F.col("e.s").alias("source"), F.col("e.t").alias("item"), "value")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its other sources (all) and its most telling terms (`top`).

    docs has lang, source and text; nulls count as empty ones, a repeated row is one more document, texts are read whole. A
    language without kept terms has pairs of value 0; a single source has no pairs; an empty table gives no row. Other columns
    are not looked at. Ties in value go by item in byte order.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialise(kept_terms(docs, least_docs), "kept")
    groups = materialise(source_groups(docs.select("lang", "source"), kept), "groups")
    rated = materialise(rated_terms(kept, groups), "rated")
    pairs = pair_sums(materialise(vectors(rated), "vectors"), groups)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    terms = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))
