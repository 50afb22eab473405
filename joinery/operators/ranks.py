"""Duplicate substrings of texts of any length by prefix doubling.

The class of a substring of 2^(k+1) symbols is the pair of classes of its halves, named anew by the least place of the pair, so
no substring is ever spelled out. Only places whose class recurs go on to the next size, and the rounds end when none
does. `duplicate_classes` doubles texts of up to IN_ROW symbols where their rows are, so that no place is shuffled or written. Longer
ones go in rounds over the table without Python: rows are dealt by (id, place) and (id, class), so a long text is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinery.functions.scalars import code_points
from joinery.kernels.repeats import recurring
from joinery.runtime import forget, materialise, ship, spread

#: Symbols of a text that is doubled in its row (about 200 bytes each while it is worked on).
IN_ROW = 1 << 20
#: Classes of a batch that a task gives on.
GIVEN = 200_000


def _named(pairs: DataFrame, accept_reversed: bool) -> DataFrame:
    """(id, pos, turned, a, b) to id, pos, name, back, n: equal pairs (a, b) of an id have one name, the least place of any.

    `name` is the class of the text as it stands, `back` that of the text read from its end; without reversal both are one. n is how
    often the class (the lesser of both) occurs. Left out are places whose class occurs once, unless it is its own reversal:
    such a place can be the middle of a longer text and of its reversal.
    """
    place = F.col("pos") * 2 + F.col("turned")
    names = pairs.groupBy("id", "a", "b").agg(F.min(place).alias("name"), F.sum((F.col("turned") == 0).cast("long")).alias("n"))
    if not accept_reversed:
        return pairs.join(names.where("n > 1"), ["id", "a", "b"]).select("id", "pos", "name", F.col("name").alias("back"), "n")
    named = pairs.join(names.drop("n"), ["id", "a", "b"])
    both = named.groupBy("id", "pos").agg(F.max(F.when(F.col("turned") == 0, F.col("name"))).alias("name"), F.max(F.when(F.col("turned") == 1, F.col("name"))).alias("back"))
    both = both.withColumn("class", F.least("name", "back"))
    often = both.groupBy("id", "class").agg(F.count("*").alias("n"), F.max((F.col("name") == F.col("back")).cast("int")).alias("own")).where("n > 1 OR own = 1").select("id", "class", "n")
    return both.join(often, ["id", "class"]).select("id", "pos", "name", "back", "n")


def _pairs(left: DataFrame, right: DataFrame, gap: Column | int, accept_reversed: bool) -> DataFrame:
    """Classes of the parts at pos (of left) and pos + gap (of right), as the text stands and turned."""
    other = right.select("id", (F.col("pos") - gap).alias("pos"), F.col("name").alias("_name"), F.col("back").alias("_back"))
    met = left.join(other, ["id", "pos"])
    stands = F.struct(F.lit(0).alias("turned"), F.col("name").alias("a"), F.col("_name").alias("b"))
    turned = F.struct(F.lit(1).alias("turned"), F.col("_back").alias("a"), F.col("back").alias("b"))
    each = F.explode(F.array(stands, turned) if accept_reversed else F.array(stands))
    return met.select("id", "pos", each.alias("e")).select("id", "pos", "e.turned", "e.a", "e.b")


def doubled(strings: DataFrame, accept_reversed: bool = False) -> Iterator[tuple[int, DataFrame]]:
    """(size, rows) for sizes 2, 4, 8, ...: id, pos, name, back, n of every substring of that size that recurs (n > 1) in its text.

    With accept_reversed a substring also recurs where its reversal stands. strings is (id, text); null and empty texts give no
    rows, ids are unique. Each size is written to the shared folder.
    """
    symbols = F.transform(code_points(F.col("text")), lambda c: F.ascii(c).cast("long"))
    codes = strings.select("id", symbols.alias("codes"))
    at = codes.select("id", F.posexplode(F.transform("codes", lambda c, i: F.struct(c.alias("a"), F.get("codes", i + 1).alias("b")))).alias("pos", "e"))
    at = at.where("e.b IS NOT NULL").select("id", F.col("pos").cast("long").alias("pos"), "e.a", "e.b")
    turned = F.struct(F.lit(1).alias("turned"), F.col("b").alias("a"), F.col("a").alias("b"))
    stands = F.struct(F.lit(0).alias("turned"), F.col("a"), F.col("b"))
    each = F.explode(F.array(stands, turned) if accept_reversed else F.array(stands))
    rows, size = at.select("id", "pos", each.alias("e")).select("id", "pos", "e.turned", "e.a", "e.b"), 2
    while True:
        level = materialise(_named(rows, accept_reversed), "ranks")
        if level.isEmpty():
            return
        yield size, level
        rows, size = _pairs(level, level, size, accept_reversed), size * 2


def of_size(level: DataFrame, size: int, length: int, accept_reversed: bool = False) -> DataFrame:
    """id, pos, name, back, n of substrings of `length` symbols that recur (n > 1), from the level of `size`: two overlapping parts, size <= length <= 2 size."""
    return _named(_pairs(level, level, length - size, accept_reversed), accept_reversed)


def summary(level: DataFrame, length: int) -> DataFrame:
    """id, length, class, n, first, last, valid: a row per class, as strings.class_summary gives."""
    out = level.where("n > 1").groupBy("id", F.least("name", "back").alias("class")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return out.select("id", F.lit(length).alias("length"), "class", "n", "first", "last", (F.col("last") - F.col("first") >= length).alias("valid"))


def _in_rows(strings: DataFrame, accept_reversed: bool) -> DataFrame:
    """summary() of all sizes, from each text's own row."""
    ship(strings.sparkSession)
    schema = T.StructType([strings.schema["id"], *T.StructType.fromDDL("length int, class long, n long, first long, last long, valid boolean").fields])
    names = schema.fieldNames()

    def given(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        at, size, n, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
        columns = [ids.take(pa.array(at)), pa.array(size), pa.array(2 * first), pa.array(n), pa.array(first), pa.array(last), pa.array(last - first >= size)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, rows = batch.column("id"), [], 0
            for i, text in enumerate(batch.column("text")):
                for size, n, first, last in recurring(text.as_py(), accept_reversed):
                    found.append((np.full(len(n), i), np.full(len(n), size, np.int32), n, first, last))
                    rows += len(n)
                if rows >= GIVEN:
                    yield given(ids, found)
                    found, rows = [], 0
            if found:
                yield given(ids, found)

    return spread(strings.select("id", "text")).mapInArrow(run, schema)


def duplicate_classes(strings: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """summary() of all sizes 2, 4, 8, ... at which a text of the table has duplicates."""
    n = F.length("text")
    out, before = _in_rows(strings.where(n <= IN_ROW), accept_reversed), None
    for size, level in doubled(strings.where(n > IN_ROW), accept_reversed):
        if before is not None:
            forget(before)
        out, before = out.unionByName(materialise(summary(level, size), "classes")), level
    if before is not None:
        forget(before)
    return out


def longest_duplicates(strings: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """id, length: the longest substring of each text that recurs, overlaps allowed; 0 where no two neighbouring symbols do.

    All texts search by halving between their largest size with duplicates and twice that; a substring of any such length is two
    overlapping parts of that size.
    """
    sizes = strings.select("id", F.lit(0).alias("size"))
    base, largest = None, 1
    for size, level in doubled(strings, accept_reversed):
        here = level.where("n > 1").select("id").distinct().withColumn("_now", F.lit(size))
        before, sizes = sizes, materialise(sizes.join(here, "id", "left").select("id", F.coalesce("_now", "size").alias("size")), "sizes")
        forget(before)
        own = level.withColumn("size", F.lit(size))
        base, largest = own if base is None else base.unionByName(own), size
    best = sizes.withColumn("length", F.col("size"))
    if base is None:
        return best.select("id", "length")
    base = materialise(base.join(sizes, ["id", "size"], "left_semi"), "longest")
    while largest > 1:
        largest //= 2
        gap = best.where(F.col("size") > largest).select("id", (F.col("length") + largest - F.col("size")).alias("gap"))
        right = base.join(gap, "id").select("id", (F.col("pos") - F.col("gap")).alias("pos"), "name", "back")
        won = _named(_pairs(base, right, 0, accept_reversed), accept_reversed).where("n > 1").select("id").distinct().withColumn("_won", F.lit(largest))
        best = materialise(best.join(won, "id", "left").select("id", "size", (F.col("length") + F.coalesce("_won", F.lit(0))).alias("length")), "longest")
    return best.select("id", "length")
