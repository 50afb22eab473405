"""Greedy choices over all objects of a table at once; no Python in the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinery.operators.graphs import held, let
from joinery.runtime import forget, materialise


def first_disjoint_in_rows(rows: DataFrame) -> DataFrame:
    """graph_id, canon, ix: first_disjoint() of each class of graphs that are rows (graph_id, occ: structs of canon, ix, the rank, and bits, a word of members)."""
    placed = F.array_sort(F.transform("occ", lambda o: F.struct(o["canon"].alias("canon"), o["ix"].alias("ix"), o["bits"].alias("bits"))))
    taken = F.filter("occ", lambda o: F.lit(False))
    none = F.struct(F.lit(None).cast("string").alias("canon"), F.lit(0).cast("long").alias("used"), taken.alias("taken"))

    def taking(state, o):
        # a class begins with no member used
        used = F.when(state["canon"] == o["canon"], state["used"]).otherwise(F.lit(0).cast("long"))
        next_ = lambda used, taken: F.struct(o["canon"].alias("canon"), used.alias("used"), taken.alias("taken"))
        return let(used, lambda u: F.when(u.bitwiseAND(o["bits"]) == 0, next_(u.bitwiseOR(o["bits"]), F.array_append(state["taken"], o))).otherwise(next_(u, state["taken"])))

    chosen = F.aggregate("occ", none, taking, lambda state: state["taken"])
    rows = held(held(rows, occ=placed), taken=chosen)
    return rows.select("graph_id", F.explode("taken").alias("o")).select("graph_id", "o.canon", "o.ix")


def first_disjoint(pairs: DataFrame) -> DataFrame:
    """Of pairs (id, rank, members), the lexicographically first maximal set in which no two of an id share a member.

    The same as going through an id's pairs by rank and taking each that meets no taken one, in rounds: a pair that is the least
    left at each of its members is taken, and what meets a taken one is dropped. Ranks are unique in an id; members is an array; pairs
    without members are all taken. Rows are dealt by (id, member), never by id alone. Each round is written to the shared folder.
    Its joins are all by sorted keys: a round's files are far smaller than their rows, so by their size Spark would gather them on the driver for a broadcast.
    """
    merged = lambda df: df.hint("merge")
    pairs = materialise(pairs.select("id", "rank", "members"), "pairs")
    alone = F.size("members") == 0
    out, left = pairs.where(alone), pairs.where(~alone)
    while True:
        at = left.select("id", "rank", F.explode("members").alias("member")).distinct()
        least = at.groupBy("id", "member").agg(F.min("rank").alias("least"))
        wins = at.join(merged(least), ["id", "member"]).groupBy("id", "rank").agg(F.min((F.col("rank") == F.col("least")).cast("int")).alias("wins"))
        taken = materialise(left.join(merged(wins.where("wins = 1").select("id", "rank")), ["id", "rank"]).select("id", "rank", "members"), "taken")
        if taken.isEmpty():
            return out
        out = out.unionByName(taken)
        used = taken.select("id", F.explode("members").alias("member")).distinct()
        met = at.join(merged(used), ["id", "member"], "left_semi").select("id", "rank").distinct()
        before, left = left, materialise(left.join(merged(met), ["id", "rank"], "left_anti"), "pairs")
        forget(before)
