"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt by hash into pools of about POOL_DOCS, and each pool is packed by itself; a pool wastes at most
a part of one bin more than the whole would. In a pool, documents longer than the largest length give full
sequences and a remainder. Remainders are placed longest first, each into the open bin with the least room that
still holds it. When none does, a bin is opened; which length to open is decided jointly: for every permitted
length as the one preferred for opening, the pool is packed and priced, with every bin at last downsized to the
smallest length that holds its contents, and the cheapest plan stands (ties: the shorter preferred length). Among the
lengths that hold a document, an opening takes the one with the least price per token not above the preferred one.

Defined results: a document without tokens (null, empty) takes no bin and has one row with null bin columns;
repeated rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinery.llm.wordpiece import token_counts
from joinery.runtime import materialise, ship

LENGTHS = (512, 1024, 2048, 4096, 8192)
POOL_DOCS = 4096


def price(length: int) -> float:
    """Cost of one sequence: a fixed part, its tokens, and attention that grows with the square."""
    return 64 + length + length * length / (1 << 17)


def best_fit(sizes: Sequence[int], lengths: Sequence[int], prefer: int, cost: Callable[[int], float] = price) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (given in falling order), and each bin's length after downsizing."""
    opened: dict[int, int] = {}
    room: dict[int, list[int]] = {}
    free, used = 0, []
    bins, offsets = [], []
    for size in sizes:
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            length = opened.get(size)
            if length is None:
                hold = [x for x in lengths if x >= size]
                length = opened[size] = min([x for x in hold if x <= prefer] or hold[:1], key=lambda x: (cost(x) / x, -x))
            at, left = len(used), length
            used.append(0)
        bins.append(at)
        offsets.append(used[at])
        used[at] += size
        left -= size
        if left:
            if not room.setdefault(left, []):
                free |= 1 << left
            room[left].append(at)
    return bins, offsets, [next(x for x in lengths if x >= u) for u in used]


def plan(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = price) -> tuple[list[int], list[int], list[int]]:
    """The cheapest best_fit over all preferred lengths."""
    found = [best_fit(sizes, lengths, p, cost) for p in lengths]
    return min(found, key=lambda f: sum(map(cost, f[2])))


def _packed(lengths: tuple[int, ...]):
    longest = lengths[-1]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "copy"], ascending=[False, True, True], kind="stable")
        tokens = rows["n_tokens"].to_numpy(np.int64)
        whole, rest = tokens // longest, tokens % longest
        pieces = whole + ((rest > 0) | (tokens == 0))
        doc = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < whole[doc], longest, rest[doc])
        full, empty = size == longest, size == 0
        bins, length, offset = np.zeros(len(doc), np.int64), np.full(len(doc), longest), np.zeros(len(doc), np.int64)
        order = np.flatnonzero(~full & ~empty)
        order = order[np.argsort(-size[order], kind="stable")]
        at, start, closed = plan(size[order].tolist(), lengths)
        bins[order], offset[order] = at, start
        length[order] = np.array(closed, np.int64)[at] if len(at) else 0
        bins[full] = len(closed) + np.arange(full.sum())
        out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[doc], "piece": piece, "start": piece * longest, "n_tokens": size, "pool": int(key[0]), "bin": bins, "bin_length": length, "bin_offset": offset})
        for column in ("pool", "bin", "bin_length", "bin_offset"):
            out[column] = out[column].astype("Int64").mask(empty)
        return out

    return run


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, n_tokens, pool, bin (within the pool), bin_length, bin_offset."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    counted = token_counts(docs.select(F.struct("doc_id").alias("_row"), F.col("text").cast("string").alias("_text")))
    sizes = materialise(counted.select("_row.doc_id", "n_tokens").groupBy("doc_id", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    each = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    pools = max(1, -(-total // POOL_DOCS))
    dealt = each.withColumn("pool", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(pools)))
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("piece long, start long, n_tokens long, pool long, bin long, bin_length long, bin_offset long").fields])
    return dealt.groupBy("pool").applyInPandas(_packed(tuple(sorted(lengths))), schema)
