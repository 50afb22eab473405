"""Minimax contiguous partition of a corpus into shards.

Rows with equal texts share a hash, so a hash cell (CELLS of them, ordered by hash) is an atomic group that no cut
divides. The driver gets the bytes of each cell, a list of bounded length whatever the corpus, and binary-searches
the smallest capacity for which filling shards greedily in cell order needs no more shards than there are. Cuts are
then made within that capacity: among the places that leave the rest feasible, each goes where the shard comes
closest to an equal share of what is left, so a group larger than a share does not leave later shards empty.

Slots number the rows of a shard from 0 without gaps. Rows are numbered in parts of a shard; the parts' sizes,
summed up in order, give each part's first slot. Repeated rows are counted before the shuffle and spread out after
the numbering, so neither copies nor a hot key meet in one task.

Defined results: a null text has no bytes and is in one group with the empty text; repeated rows get a slot each;
an empty table gives an empty result; null doc_ids are allowed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.runtime import materialise

#: A power of two; the list of cell sizes on the driver has at most so many entries.
CELLS = 1 << 16
ROW_BYTES = 16
#: Rows of a part, unless there would be more than MAX_PARTS parts.
PART_ROWS, MAX_PARTS = 1024, 100_000


def greedy_ends(prefix: np.ndarray, capacity: int, start: int = 0) -> list[int]:
    """Ends (exclusive) of the groups when each shard takes as many as fit; prefix[i]: size of the first i groups."""
    ends, last = [], len(prefix) - 1
    while start < last:
        start = int(np.searchsorted(prefix, prefix[start] + capacity, "right")) - 1
        ends.append(start)
    return ends


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity for which `shards` contiguous runs hold all groups."""
    prefix = np.r_[0, np.cumsum(sizes)]
    low, high = int(max(sizes.max(initial=0), -(-prefix[-1] // shards))), int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if len(greedy_ends(prefix, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def partition(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Start of each shard after the first: minimax cuts, as even as the least capacity allows."""
    if not len(sizes):
        return np.zeros(shards - 1, np.int64)
    prefix = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    capacity, last = least_capacity(sizes, shards), len(sizes)
    latest = greedy_ends(prefix, capacity)
    latest += [last] * (shards - len(latest))
    turned = prefix[-1] - prefix[::-1]
    back = greedy_ends(turned, capacity)
    earliest = [last - e for e in back + [last] * (shards - len(back))][::-1][1:] + [last]
    cuts, start = [], 0
    for i in range(shards - 1):
        fits = int(np.searchsorted(prefix, prefix[start] + capacity, "right")) - 1
        low, high = max(earliest[i], start), min(latest[i], fits)
        goal = prefix[start] + (prefix[-1] - prefix[start]) / (shards - i)
        at = int(np.searchsorted(prefix, goal))
        if at > start + 1 and goal - prefix[at - 1] <= prefix[min(at, last)] - goal:
            at -= 1
        start = min(max(at, low), high)
        cuts.append(start)
    return np.array(cuts, np.int64)


def cell_of(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - CELLS.bit_length() + 1)


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """rows with `slot`, gapless from 0 in each `shard`."""
    columns = rows.columns
    parts = max(1, min(MAX_PARTS, total // PART_ROWS))
    part = F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int").alias("_part")
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_copies")).select(*columns, "_copies", part)
    before = F.sum("_copies").over(Window.partitionBy("shard", "_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0))
    inside = counted.withColumn("_before", before - F.col("_copies"))
    sizes = rows.select("shard", part).groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    first = sizes.select("shard", "_part", (up_to - F.col("_n")).alias("_first"))
    placed = inside.join(first, ["shard", "_part"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    return placed.select(*columns, (F.col("_first") + F.col("_before")).alias("_slot"), each.alias("_i")).select(*columns, (F.col("_slot") + F.col("_i")).alias("slot"))


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; texts are read once, all else works on a narrow table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell_of(text).alias("cell"))
    narrow = materialise(narrow, "sizes")
    cells = narrow.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("cell").toPandas()
    cuts = partition(cells["bytes"].to_numpy(np.int64), shards)
    starts = [int(cells["cell"].iloc[c]) if c < len(cells) else CELLS for c in cuts]
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("cell") >= start).cast("int")
    rows = narrow.select("doc_id", "size", "text_crc32", shard.alias("shard"))
    return numbered(rows, int(cells["n"].sum()))
