"""Exact assembly indices of all strings of a table at once: a frontier of states, kept as a table; no Python in the plans.

A state is an object's id, its remaining parts (canonical texts, sorted), the longest part a move may still take, and the joins
saved so far. A move takes two equal, non-overlapping parts of k symbols out and puts one back; it saves k - 1. Any construction
can be read by falling k, so later moves are no longer than earlier ones. A round makes one move from each state of the
frontier: of equal keys the best one stays, keys visited with as much saved are dropped, so are states that cannot beat
their object's best one, and objects that meet the floor of their symbol counts are done. States are dealt by id and
parts, so one object's states are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions.scalars import canonical_text, packing_bound
from joinery.kernels.chains import chain_length
from joinery.operators.strings import chain_floor, repeated_runs
from joinery.runtime import forget, materialise

#: Keys over which one object's states meet its best index.
SALTS = 32
KEY = ["id", "parts", "longest"]


def savings_bound(parts: Column, longest: Column, most: int) -> Column:
    """Most joins that parts of 2..longest symbols (at most `most`) still save on all parts together."""
    steps = F.array(*[F.lit(chain_length(k)) for k in range(2, max(2, most) + 1)])
    whole = lambda k: F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + packing_bound(F.length(p), k))
    by = F.transform(F.sequence(F.lit(2), longest), lambda k: whole(k) - F.get(steps, k - 2))
    return F.when(longest >= 2, F.greatest(F.array_max(by), F.lit(0))).otherwise(0)


def moved(states: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """id, parts, longest, saved after each move of each state."""
    canon = lambda x: canonical_text(x, accept_reversed)
    sized = states.where("longest >= 2").select("id", "parts", "saved", F.explode(F.sequence(F.lit(2), F.col("longest"))).alias("k"))
    k = F.col("k")
    long = F.transform("parts", lambda p, i: F.when(F.length(p) >= k, F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda a: F.struct(canon(F.substring(p, a, k)).alias("c"), i.alias("i"), a.alias("a")))))
    placed = sized.withColumn("places", F.flatten(F.filter(long, lambda x: x.isNotNull())))
    # places go by part and offset, so the second of a pair comes after the first
    after = lambda x, n: F.filter(F.slice("places", n + 2, F.size("places")), lambda y: (y["c"] == x["c"]) & ((y["i"] > x["i"]) | (y["a"] >= x["a"] + k)))
    pairs = F.flatten(F.transform("places", lambda x, n: F.transform(after(x, n), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    each = placed.where(F.size("places") > 1).select("id", "parts", "saved", "k", F.explode(pairs).alias("m"))
    i, j, a, b = F.col("m.x.i"), F.col("m.y.i"), F.col("m.x.a"), F.col("m.y.a")
    p, q = F.get("parts", i), F.get("parts", j)
    rest = F.filter("parts", lambda x, n: (n != i) & (n != j))
    ahead, end = lambda t, at: F.substring(t, F.lit(1), at - 1), lambda t, at: F.substring(t, at + k, F.length(t))
    between = F.substring(p, a + k, b - a - k)
    around = F.when(i == j, F.array(ahead(p, a), between, end(p, b))).otherwise(F.array(ahead(p, a), end(p, a), ahead(q, b), end(q, b)))
    left = F.transform(F.filter(around, lambda x: F.length(x) > 1), canon)
    return each.select("id", F.array_sort(F.concat(rest, left, F.array(F.col("m.x.c")))).alias("parts"), k.alias("longest"), (F.col("saved") + k - 1).alias("saved"))


def best_of_keys(states: DataFrame) -> DataFrame:
    return states.groupBy(*KEY).agg(F.max("saved").alias("saved"))


def bests(objects: DataFrame, states: DataFrame) -> DataFrame:
    """objects (id, symbols, floor, best) with the most that their states save."""
    found = states.groupBy("id").agg(F.max("saved").alias("_found"))
    return objects.join(found, "id", "left").select("id", "symbols", "floor", F.greatest("best", F.coalesce("_found", F.lit(0))).alias("best"))


def worth(states: DataFrame, objects: DataFrame, most: int) -> DataFrame:
    """States that can still save more than their object's best one; none of objects that meet their floor."""
    open_ = objects.where(F.col("symbols") - 1 - F.col("best") > F.col("floor")).select("id", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = states.withColumn("_salt", F.pmod(F.xxhash64("parts"), F.lit(SALTS)).cast("int"))
    met = salted.join(open_, ["id", "_salt"])
    return met.where(F.col("saved") + savings_bound(F.col("parts"), F.col("longest"), most) > F.col("best")).select(*KEY, "saved")


def unvisited(states: DataFrame, stored: DataFrame) -> DataFrame:
    """States whose key is not stored with as much saved."""
    known = stored.groupBy(*KEY).agg(F.max("saved").alias("_known"))
    return states.join(known, KEY, "left").where(F.col("_known").isNull() | (F.col("_known") < F.col("saved"))).drop("_known")


def assembly_frontier(strings: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """id, assembly_index of strings (id, text): -1 if empty, 0 for one symbol, null for a null text; ids are unique.

    As many rounds as a construction has moves at most. Each round's states and best indices are written to the shared folder; the driver
    sees only whether a round has any states.
    """
    strings = materialise(strings.select("id", "text"), "strings")
    runs = repeated_runs(strings.where("text IS NOT NULL"))
    part = canonical_text(F.substring("text", F.col("offset") + 1, F.col("length")), accept_reversed)
    # two equal parts lie in the runs together
    longest = F.least(F.max("length"), F.floor(F.sum("length") / 2)).cast("int")
    start = strings.join(runs, "id").groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"), longest.alias("longest"))
    front = stored = materialise(start.withColumn("saved", F.lit(0).cast("long")), "front")
    floors = chain_floor(strings.where("text <> ''")).select("id", F.col("vector_floor").alias("floor"))
    objects = materialise(strings.join(floors, "id", "left").select("id", F.length("text").alias("symbols"), F.coalesce("floor", F.lit(0)).alias("floor"), F.lit(0).cast("long").alias("best")), "objects")
    most = front.agg(F.max("longest")).first()[0] or 0
    while True:
        found = materialise(unvisited(best_of_keys(moved(front, accept_reversed)), stored), "found")
        if found.isEmpty():
            return objects.select("id", (F.col("symbols") - 1 - F.col("best")).cast("int").alias("assembly_index"))
        before, objects = objects, materialise(bests(objects, found), "objects")
        front = materialise(worth(found, objects, most), "front")
        forget(before, found)
        stored = stored.unionByName(front)
