"""Relational operators on strings: a row per string, occurrence or interval; no Python in the plans.

Strings come as (id, text), intervals as (id, offset, length) in scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.functions.scalars import canonical_text, chain_length, code_points


def symbol_counts(strings: DataFrame) -> DataFrame:
    """id, symbol, n: how often each symbol occurs."""
    return strings.select("id", F.explode(code_points(F.col("text"))).alias("symbol")).groupBy("id", "symbol").agg(F.count("*").alias("n"))


def symbol_profile(strings: DataFrame) -> DataFrame:
    """id and the ascending array of its symbols' counts."""
    return symbol_counts(strings).groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("counts"))


def repeated_runs(strings: DataFrame) -> DataFrame:
    """id, offset, length: runs of two or more positions whose symbols occur at least twice in the string."""
    at = strings.select("id", F.posexplode(code_points(F.col("text"))).alias("pos", "symbol"))
    kept = at.withColumn("n", F.count("*").over(Window.partitionBy("id", "symbol"))).where("n >= 2")
    island = kept.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    runs = island.groupBy("id", "island").agg(F.min("pos").alias("offset"), F.count("*").cast("int").alias("length"))
    return runs.where("length > 1").select("id", "offset", "length")


def occurrences(strings: DataFrame, accept_reversed: bool = False, longest: int | None = None) -> DataFrame:
    """id, offset, length, canon of each substring of two or more symbols.

    A part that recurs without overlap has at most half of its string, so longer ones are never built.
    """
    n = F.length("text")
    top = F.floor(n / 2).cast("int") if longest is None else F.least(F.floor(n / 2).cast("int"), F.lit(longest))
    sized = strings.select("id", "text", F.explode(F.when(top >= 2, F.sequence(F.lit(2), top))).alias("length"))
    placed = sized.select("id", "text", "length", F.explode(F.sequence(F.lit(0), F.length("text") - F.col("length"))).alias("offset"))
    return placed.select("id", "offset", "length", canonical_text(F.substring("text", F.col("offset") + 1, F.col("length")), accept_reversed).alias("canon"))


def class_summary(occ: DataFrame) -> DataFrame:
    """id, canon, length, n, first, last, valid: one row per class; valid if some pair does not overlap."""
    out = occ.groupBy("id", "canon", "length").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    return out.withColumn("valid", F.col("last") - F.col("first") >= F.col("length"))


def pairable(occ: DataFrame) -> DataFrame:
    """Occurrences that some other one of their class does not overlap: the first or last of the class is far enough."""
    w = Window.partitionBy("id", "canon", "length")
    far = (F.max("offset").over(w) - F.col("offset") >= F.col("length")) | (F.col("offset") - F.min("offset").over(w) >= F.col("length"))
    return occ.withColumn("_far", far).where("_far").drop("_far")


def disjoint_pairs(occ: DataFrame) -> DataFrame:
    """id, canon, length, left_offset, right_offset of each pair of a class that does not overlap."""
    a, b = pairable(occ).alias("a"), pairable(occ).alias("b")
    same = (F.col("a.id") == F.col("b.id")) & (F.col("a.canon") == F.col("b.canon")) & (F.col("a.length") == F.col("b.length"))
    pairs = a.join(b, same & (F.col("a.offset") + F.col("a.length") <= F.col("b.offset")))
    return pairs.select("a.id", "a.canon", "a.length", F.col("a.offset").alias("left_offset"), F.col("b.offset").alias("right_offset"))


def interval_union(intervals: DataFrame) -> DataFrame:
    """id, offset, length: touching and overlapping intervals merged."""
    end = F.col("offset") + F.col("length")
    before = Window.partitionBy("id").orderBy("offset", "length").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce((F.col("offset") > F.max(end).over(before)).cast("int"), F.lit(1))
    marked = intervals.withColumns({"_end": end, "_starts": starts})
    numbered = marked.withColumn("_island", F.sum("_starts").over(Window.partitionBy("id").orderBy("offset", "length").rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("id", "_island").agg(F.min("offset").alias("offset"), F.max("_end").alias("_end"))
    return out.select("id", "offset", (F.col("_end") - F.col("offset")).alias("length"))


def covered_length(intervals: DataFrame) -> DataFrame:
    """id and the number of positions that its intervals cover."""
    return interval_union(intervals).groupBy("id").agg(F.sum("length").cast("bigint").alias("covered"))


def interval_complement(wholes: DataFrame, intervals: DataFrame) -> DataFrame:
    """id, offset, length: what `intervals` leave of the wholes (id, length), which start at 0.

    A gap is where an interval begins after all before it have ended, so one sort by id and offset finds all.
    """
    wall = lambda at: F.struct(at.cast("int").alias("offset"), F.lit(0).alias("length"))
    ends = wholes.select("id", F.explode(F.array(wall(F.lit(0)), wall(F.col("length")))).alias("e")).select("id", "e.offset", "e.length")
    before = Window.partitionBy("id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    walls = intervals.select("id", "offset", "length").unionByName(ends)
    reached = walls.select("id", "offset", F.max(F.col("offset") + F.col("length")).over(before).alias("_reached"))
    return reached.where(F.col("offset") > F.col("_reached")).select("id", F.col("_reached").alias("offset"), (F.col("offset") - F.col("_reached")).alias("length"))


def dyadic_cells(offset: Column, length: Column, levels: int) -> Column:
    """The fewest cells [c 2^l, (c + 1) 2^l) that make up the positions offset to offset + length, that one included: level and cell, two a level at most."""
    end = offset + length + 1

    def of_level(level: Column) -> Column:
        low = F.ceil(offset / F.pow(F.lit(2), level)).cast("long")
        high = F.floor(end / F.pow(F.lit(2), level)).cast("long")
        left = F.when((low < high) & (low % 2 == 1), low)
        right = F.when((low < high) & (high % 2 == 1), high - 1)
        return F.transform(F.filter(F.array(left, right), lambda c: c.isNotNull()), lambda c: F.struct(level.alias("level"), c.alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))


def containing(parts: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches (id, offset, length) with the part that holds each; part columns are null where none does.

    A part is cut into dyadic cells, at most two of a size; a match's first position lies in one cell of each size, and in just one
    of a part that holds it. So the join is on (id, level, cell): an id with many parts and matches is spread over its cells, and
    candidates are only the parts that hold a match's first position. Offsets are not negative.
    """
    levels = (parts.agg(F.max("length")).first()[0] or 0) + 1
    levels = int(levels).bit_length()
    p = parts.select("id", F.col("offset").alias("part_offset"), F.col("length").alias("part_length"))
    p = p.withColumn("_c", F.explode(dyadic_cells(F.col("part_offset"), F.col("part_length"), levels))).select("id", "part_offset", "part_length", "_c.level", "_c.cell")
    m = matches.select("id", "offset", "length")
    asked = m.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("cell", F.floor(F.col("offset") / F.pow(F.lit(2), F.col("level"))).cast("long"))
    inside = F.col("part_offset") + F.col("part_length") >= F.col("offset") + F.col("length")
    found = asked.join(p, ["id", "level", "cell"]).where(inside).select("id", "offset", "length", "part_offset", "part_length")
    none = m.join(found, ["id", "offset", "length"], "left_anti")
    return found.unionByName(none.withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in ("part_offset", "part_length")}))


def next_occurrence(occ: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (id, canon, start, stop): the first occurrence at or after start that ends by stop; null if none.

    As-of by union and a running window, so no pair of rows is built.
    """
    ask = asked.select("id", "canon", F.col("start").alias("at"), "stop", F.lit(None).cast("int").alias("offset"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("length"))
    have = occ.select("id", "canon", F.col("offset").alias("at"), F.lit(None).cast("int").alias("stop"), "offset", F.lit(0).alias("kind"), "length")
    w = Window.partitionBy("id", "canon").orderBy("at", F.col("kind").desc()).rowsBetween(0, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("kind") == 0, F.struct("offset", "length")), ignorenulls=True).over(w)
    found = ask.unionByName(have).withColumn("_next", nxt).where("kind = 1")
    fits = F.col("_next.offset") + F.col("_next.length") <= F.col("stop")
    return found.select("id", "canon", F.col("at").alias("start"), "stop", F.when(fits, F.col("_next.offset")).alias("offset"))


def chain_floor(strings: DataFrame) -> DataFrame:
    """id, scalar_floor, vector_floor: joins that each string needs at least."""
    n = symbol_counts(strings).groupBy("id").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("n").alias("most"), F.max(chain_length(F.col("n"))).alias("by_symbol"))
    support = F.col("kinds") - F.when(F.col("most") == 1, 1).otherwise(0)
    scalar = chain_length(F.col("total"))
    return n.select("id", scalar.cast("int").alias("scalar_floor"), F.greatest(scalar, F.col("by_symbol"), support).cast("int").alias("vector_floor"))


def running_best(bounds: DataFrame) -> DataFrame:
    """(id, size, bound) with the largest bound over sizes up to each."""
    w = Window.partitionBy("id").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    return bounds.withColumn("running", F.max("bound").over(w))


def leftmost_apart(places: DataFrame) -> DataFrame:
    """Of (id, pos) in consecutive runs, those that a leftmost choice without neighbours takes: every other of a run."""
    numbered = places.withColumn("_run", F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    ordinal = F.row_number().over(Window.partitionBy("id", "_run").orderBy("pos"))
    return numbered.withColumn("_n", ordinal).where("_n % 2 = 1").select("id", "pos")


def best_digram(strings: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """id, canon, saving, first: the neighbours that a first round of Re-Pair joins (greatest saving, then earliest)."""
    symbols = strings.select("id", "text", F.explode(F.when(F.length("text") > 1, F.sequence(F.lit(0), F.length("text") - 2))).alias("pos"))
    pairs = symbols.select("id", canonical_text(F.substring("text", F.col("pos") + 1, F.lit(2)), accept_reversed).alias("canon"), "pos")
    w = Window.partitionBy("id", "canon")
    run = F.col("pos") - F.row_number().over(w.orderBy("pos"))
    runs = pairs.withColumn("_run", run).groupBy("id", "canon", "_run").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    groups = runs.groupBy("id", "canon").agg((F.sum(F.ceil(F.col("n") / 2)) - 1).alias("saving"), F.min("first").alias("first")).where("saving > 0")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("saving"), "first"))
    return groups.withColumn("_rank", rank).where("_rank = 1").select("id", "canon", F.col("saving").cast("bigint").alias("saving"), "first")


def pair_blocks(occ: DataFrame) -> DataFrame:
    """id, canon, left_part, right_part, pairs: how many pairs of a class lie between two parts (in one part: disjoint ones).

    occ: id, canon, part, offset, length. A bound on a block drops all its pairs before any is built.
    """
    per = occ.groupBy("id", "canon", "part").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))
    a, b = per.alias("a"), per.alias("b")
    blocks = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.canon") == F.col("b.canon")) & (F.col("a.part") <= F.col("b.part")))
    apart = lambda x: F.size(F.filter("a.places", lambda y: y["offset"] + y["length"] <= x["offset"]))
    inside = F.aggregate("a.places", F.lit(0), lambda n, x: n + apart(x))
    pairs = F.when(F.col("a.part") == F.col("b.part"), inside).otherwise(F.size("a.places") * F.size("b.places"))
    return blocks.select("a.id", "a.canon", F.col("a.part").alias("left_part"), F.col("b.part").alias("right_part"), pairs.cast("bigint").alias("pairs")).where("pairs > 0")
