"""SimHash near-duplicate groups by a Gray-order hierarchical index.

Each text gets a 64-bit SimHash. Equal fingerprints are merged first, so a group of copies of any size is
one row. Fingerprints within the radius of each other agree on at least one of radius + 1 bit blocks; the
first bits of each block, as many as give buckets of about BUCKET_ROWS, name a bucket, so both ends of every
link meet in one. Buckets of more than PIECE_ROWS are cut into pieces by hash, and each two pieces meet once.
In each meeting the fingerprints are sorted by Gray rank and put under a tree whose nodes hold the bits that
all members share and that no ancestor holds; a search adds up the differing bits on the way down and drops
a whole group once the sum passes the radius. A group whose members cannot differ from the query by more
than the radius is linked by one member, so dense groups do not yield all their pairs. Components come from
alternating large-star and small-star rounds on DataFrames.

Defined results: a null text counts as empty and has fingerprint zero; repeated rows stay repeated; a null
doc_id keeps its row and never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.llm.rows import packed, unpacked
from joinery.runtime import materialise, ship, spread

SEED = 42
FANOUT = 8
#: Fingerprints of a bucket on average, up to twice as many, and the most in a piece of one.
BUCKET_ROWS, PIECE_ROWS = 4096, 16_384
#: Wide runs up to this many rows are compared position by position.
SHORT_RUN = 16
#: Queries that descend the tree together.
QUERY_BLOCK = 512
_STEP = 255 * 256
#: Wide fingerprints, for similarity: bits, the least similarity of shingle sets, and the recall wanted at it.
WIDE_BITS, SIMILARITY, RECALL = 512, 0.8, 0.95
#: Bits of a table's key while there are up to 2 ** KEY_ROWS fingerprints; one more for each doubling.
KEY_BITS, KEY_ROWS = 14, 22
#: Keys of a text: BANDS of them, each over the least values of BAND_ROWS permutations of its shingles.
BANDS, BAND_ROWS = 24, 3
#: Rows of a piece of a bucket of texts with equal keys; each two pieces of a larger bucket meet once.
MEETING_ROWS = 4096
#: Dropped rows that are broadcast to filter the texts; more are joined by key.
BROADCAST_DROPPED = 1 << 19
#: Runs of equal keys up to this length are compared pair by pair, longer ones by groups around leaders; the links join the same rows.
EXACT_RUN = 2048
#: Wide fingerprints that differ in up to the mean and this many standard deviations are candidates, decided by the shingles.
CANDIDATE_SD = 3.5
#: Those of up to the mean and so many are linked without a look at the sets, so that a group of thousands of copies is not compared pair by
#: pair: texts below the wanted similarity are hardly ever so near.
LINKED_SD = -2.0
#: Distinct texts and shingles of a block of candidates, at most about; each two blocks of a group of candidates meet in one task.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Texts whose sets are made together.
SET_ROWS = 500
#: Candidates that are broadcast to find their texts; more are joined by key.
BROADCAST_ROWS = 1 << 16
#: Pairs of rows whose bits are compared at a time.
PAIRS_TOGETHER = 1 << 17


def _shingles(words: list[bytes], width: int) -> list[bytes]:
    """The space-joined runs of `width` words, or the whole sequence if it is shorter."""
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    if n == 1:
        return [line]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [line[s : e - 1] for s, e in zip([0, *ends[: n - 1]], ends[width - 1 :], strict=True)]


def _majority(digests: list[bytes], bits: int) -> bytes:
    """The bits that are set in over half of the digests."""
    counts = np.zeros(bits, np.int64)
    step = _STEP * 64 // bits
    for at in range(0, len(digests), step):
        part = np.unpackbits(np.frombuffer(b"".join(digests[at : at + step]), np.uint8)).reshape(-1, bits)
        whole = len(part) // 255 * 255
        if whole:
            counts += part[:whole].reshape(-1, 255, bits).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += part[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(digests)).tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text's word shingles, each counted as often as it occurs."""
    words = words_of(text)
    if not words:
        return 0
    return int.from_bytes(_majority([xxhash.xxh64_digest(x, SEED) for x in _shingles(words, width)], 64), "big")


def wide_fingerprint(text: str | None, width: int = 5) -> bytes:
    """SimHash of WIDE_BITS bits, whose differing bits measure the similarity of two texts' shingles."""
    words = words_of(text)
    if not words:
        return bytes(WIDE_BITS // 8)
    return _majority([blake2b(x, digest_size=WIDE_BITS // 8).digest() for x in _shingles(words, width)], WIDE_BITS)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    rank = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Tree over distinct fingerprints in Gray order; level 0 groups fingerprints, each next level groups nodes."""

    def __init__(self, values: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order].astype(np.uint64)
        self.fanout = fanout
        shared_and, shared_or = self.values, self.values
        levels = []
        while len(shared_and) > 1 or not levels:
            at = np.arange(0, len(shared_and), fanout)
            shared_and, shared_or = np.bitwise_and.reduceat(shared_and, at), np.bitwise_or.reduceat(shared_or, at)
            levels.append((~(shared_and ^ shared_or), shared_and))
        #: From the root down: bits that a node shares and its parent does not, their pattern, count of free bits.
        self.levels = []
        above = np.zeros(1, np.uint64)
        for mask, pattern in reversed(levels):
            own = mask & ~np.repeat(above, fanout)[: len(mask)] if self.levels else mask
            self.levels.append((own, pattern & own, 64 - np.bitwise_count(mask).astype(np.int64)))
            above = mask
        self.leaf_mask = ~np.repeat(above, fanout)[: len(self.values)]
        #: Fingerprints that searches compared one by one; all others were dropped or linked as parts of a group.
        self.compared = 0

    def _children(self, query, node, spent, size):
        child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
        keep = child < size
        return np.repeat(query, self.fanout)[keep], child[keep], np.repeat(spent, self.fanout)[keep]

    def search(self, queries: np.ndarray, radius: int, before: np.ndarray | None = None, group: bool = False):
        """Pairs (query number, position in Gray order) within the radius.

        before: look only at positions below this one, for each query. group: one member stands for a whole
        node when all its members must be within the radius of the query and of each other.
        """
        found_q, found_v = [], []
        query, node, spent = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth, (own, pattern, free) in enumerate(self.levels):
            if depth:
                query, node, spent = self._children(query, node, spent, len(own))
            span = self.fanout ** (len(self.levels) - depth)
            spent = spent + np.bitwise_count((queries[query] ^ pattern[node]) & own[node])
            keep = spent <= radius
            if before is not None:
                keep &= node * span < before[query]
            query, node, spent = query[keep], node[keep], spent[keep]
            if group:
                whole = spent + free[node] <= radius
                found_q.append(query[whole])
                found_v.append(node[whole] * span)
                query, node, spent = query[~whole], node[~whole], spent[~whole]
        query, leaf, spent = self._children(query, node, spent, len(self.values))
        self.compared += len(leaf)
        spent = spent + np.bitwise_count((queries[query] ^ self.values[leaf]) & self.leaf_mask[leaf])
        keep = spent <= radius
        if before is not None:
            keep &= leaf < before[query]
        found_q.append(query[keep])
        found_v.append(leaf[keep])
        return np.concatenate(found_q), np.concatenate(found_v)

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that join all fingerprints within the radius: each to the smallest number of its component."""
        n = len(self.values)
        label = np.arange(n)
        for depth, (_, _, free) in enumerate(self.levels):  # groups that are linked throughout
            span = self.fanout ** (len(self.levels) - depth)
            whole = np.flatnonzero(free <= radius)
            member = (whole[:, None] * span + np.arange(span)).ravel()
            first = np.repeat(whole * span, span)
            keep = member < n
            label = merge(label, member[keep], first[keep])
        for at in range(0, n, QUERY_BLOCK):
            ask = np.arange(at, min(n, at + QUERY_BLOCK))
            query, leaf = self.search(self.values[ask], radius, before=ask, group=True)
            label = merge(label, ask[query], leaf)
        return self.order, self.order[label]


def merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (each pointing to a smaller or equal position) after joining left[i] with right[i]."""
    while True:
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            break
        left, right = left[differ], right[differ]
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def _fingerprints(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width) for t in batch.column("_text").to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def _linked(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy().view(np.uint64)
        a, b = GrayIndex(values).links(radius)
        values = rows["fp"].to_numpy()
        return pd.DataFrame({"u": values[a[a != b]], "v": values[b[a != b]]})

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", F.col("text").cast("string").alias("_text"))).mapInArrow(_fingerprints(width), f"doc_id {kind}, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """Bit masks such that two words within the radius agree on at least one of them: up to `bits` bits of each of radius + 1 blocks."""
    blocks = radius + 1
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return list(dict.fromkeys(((1 << min(bits, b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` that connect everything within the radius."""
    bits = max(0, (distinct.count() // BUCKET_ROWS).bit_length() - 1)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, bits)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    large = materialise(keyed.groupBy("t", "key").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces")).where("pieces > 1"), "large")
    pieces = keyed.join(large, ["t", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    met = pieces.withColumn("b", piece).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return met.groupBy("t", "key", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j")).applyInPandas(_linked(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (u, v) reaches, by alternating star rounds."""
    edges = materialise(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        # the least neighbours are written before they are joined: both sides of the joins are then scans, whose
        # shuffles can be split where a hub has most of the rows, or one side is broadcast by its size on disk
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialise(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        state = now


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that its links reach, itself included) of each row."""
    prints = materialise(fingerprints(docs, width), "fingerprints")
    of = grouped_by_fingerprint(prints, radius)
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def differing_share(similarity: float) -> float:
    """Share of bits in which the SimHashes of two equally long texts of this shingle similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_differing(similarity: float = SIMILARITY, deviations: float = 1.5) -> int:
    """Differing bits of wide fingerprints that still count as similar: the mean and one and a half standard deviations."""
    p = differing_share(similarity)
    return int(WIDE_BITS * p + deviations * math.sqrt(WIDE_BITS * p * (1 - p)))


def tables(count: int, similarity: float = SIMILARITY, recall: float = RECALL, deviations: float = 1.5) -> list[np.ndarray]:
    """The bits of each table's key: as many tables as find a pair with most_differing() bits at this recall.

    For callers that hold wide fingerprints without their shingles; similar_groups has the shingles and takes band_keys().
    """
    bits = KEY_BITS + max(0, math.ceil(math.log2(max(1, count))) - KEY_ROWS)
    same = (1 - most_differing(similarity, deviations) / WIDE_BITS) ** bits
    n = math.ceil(math.log(1 - recall) / math.log(1 - same))
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.permutation(WIDE_BITS)[:bits]) for _ in range(n)]


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def _meet(left: np.ndarray, right: np.ndarray, most: int) -> tuple[int, int] | None:
    """Positions of some row of left and some row of right that differ in up to `most` bits."""
    step = max(1, PAIRS_TOGETHER // max(1, len(right)))
    for at in range(0, len(left), step):
        for by in range(0, len(right), PAIRS_TOGETHER):
            near = np.argwhere(differing(left[at : at + step, None], right[None, by : by + PAIRS_TOGETHER]) <= most)
            if len(near):
                return at + int(near[0, 0]), by + int(near[0, 1])
    return None


def long_run(wide: np.ndarray, most: int) -> np.ndarray:
    """Labels as of merge() that join all rows within `most` bits, without all pairs where rows are dense.

    A row near a leader joins its group, any other becomes a leader. Two groups can only have near rows if their
    leaders differ in no more than `most` and both radii; then the rows that the triangle inequality does not rule
    out are compared, until a pair is near. Groups that are joined already are not compared.
    """
    label, left, leaders, groups, radii = np.arange(len(wide)), np.arange(len(wide)), [], [], []
    while len(left):
        far = differing(wide[left], wide[left[0]])
        near = far <= most
        leaders.append(left[0])
        groups.append(left[near])
        radii.append(far[near].max())
        label[left[near]] = left[0]
        left = left[~near]
    leaders, radii = np.array(leaders, np.int64), np.array(radii, np.int64)
    owner = np.arange(len(leaders))
    for g in range(len(leaders) - 1):
        apart = differing(wide[leaders[g + 1 :]], wide[leaders[g]])
        for h in (g + 1 + np.flatnonzero(apart <= most + radii[g] + radii[g + 1 :])).tolist():
            if owner[g] == owner[h]:
                continue
            mine = groups[g][differing(wide[groups[g]], wide[leaders[h]]) <= most + radii[h]]
            other = groups[h][differing(wide[groups[h]], wide[leaders[g]]) <= most + radii[g]]
            if _meet(wide[mine], wide[other], most):
                owner = merge(owner, np.array([g]), np.array([h]))
    place = np.zeros(len(wide), np.int64)
    place[leaders] = np.arange(len(leaders))
    return leaders[owner[place[label]]]


def near_runs(key: np.ndarray, wide: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, node) between rows of equal keys that differ in up to `most` bits; wide: rows of 64-bit words.

    A run's links are reduced to one per row; they join all rows within `most` bits, however long the run is.
    """
    order = np.argsort(key, kind="stable")
    key, wide, node = key[order], wide[order], node[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    run = np.repeat(np.arange(len(starts)), sizes)
    label = np.arange(len(key))
    short = sizes[run] <= SHORT_RUN if len(run) else np.zeros(0, bool)
    for lag in range(1, min(SHORT_RUN, len(key))):
        at = np.flatnonzero((run[lag:] == run[:-lag]) & short[lag:])
        near = at[differing(wide[at + lag], wide[at]) <= most]
        label = merge(label, near + lag, near)
    for start, size in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
        mine = wide[start : start + size]
        if size <= EXACT_RUN:
            for i in range(size - 1):
                near = np.flatnonzero(differing(mine[i + 1 :], mine[i]) <= most)
                if len(near):
                    label = merge(label, start + i + 1 + near, np.full(len(near), start + i))
        else:
            label[start : start + size] = start + long_run(mine, most)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return node[linked], node[label[linked]]


def _near(most: int, candidates: int):
    """Streams rows sorted by run; a task holds the rows of one batch and of one run."""

    def links(key, wide, node) -> Iterator[pa.RecordBatch]:
        for limit in (most, candidates):
            u, v = near_runs(key, wide, node, limit)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), limit == most))], ["u", "v", "near"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros((0, WIDE_BITS // 64), np.uint64), np.zeros(0, np.int64)]
        for batch in batches:
            new = [batch.column("run").to_numpy(), np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64), batch.column("node").to_numpy()]
            held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:
                yield from links(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if len(held[0]):
            yield from links(*held)

    return run


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes: equal for both of two sets in each band with their similarity to the power BAND_ROWS.

    All of 24 keys of 3 permutations differ for a share of 1e-7 of pairs at 0.8, and of 0.3 % at 0.6, whatever the corpus.
    """
    rng = np.random.default_rng(SEED)
    flip, odd = rng.integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 8192):
        part = shingles[at : at + 8192]
        for i in range(len(least)):
            mixed = (part ^ flip[i]) * (odd[i] | np.uint64(1))
            least[i] = min(least[i], (mixed ^ (mixed >> np.uint64(31))).min())
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct word shingles of a text as rising 64-bit hashes; none for a text without words."""
    words = words_of(text)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in _shingles(words, width)), np.uint64)) if words else np.zeros(0, np.uint64)


def similar_links(group: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (group, group) that join all groups with sets whose intersection is this share of their union, or more."""
    names, first = np.unique(group, return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    first, sizes = first[order], sizes[order]
    _, token = np.unique(np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in order]]), return_inverse=True)
    ends = np.r_[0, np.cumsum(sizes)]
    held = np.zeros(len(token) + 1, bool)
    label = np.arange(len(names))
    for i in range(len(order) - 1):
        last = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-9, "right"))
        if last <= i + 1 or (label[first[i + 1 : last]] == label[first[i]]).all():
            continue
        held[token[ends[i] : ends[i + 1]]] = True
        shared = np.add.reduceat(held[token[ends[i + 1] : ends[last]]], ends[i + 1 : last] - ends[i + 1], dtype=np.int64)
        held[token[ends[i] : ends[i + 1]]] = False
        near = i + 1 + np.flatnonzero(shared >= similarity * (sizes[i] + sizes[i + 1 : last] - shared) - 1e-9)
        label = merge(label, first[near], np.full(len(near), first[i]))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return names[linked], names[label[linked]]


def _similar(similarity: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = similar_links(rows["group"].to_numpy(), [np.frombuffer(s, np.uint64) for s in rows["shingles"]], similarity)
        return pd.DataFrame({"u": u, "v": v})

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SET_ROWS) for b in batches for at in range(0, b.num_rows, SET_ROWS)):
            sets = pa.array([shingle_set(t, width).tobytes() for t in batch.column("_text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("group"), batch.column("hash"), batch.column("blocks"), sets], ["cell", "group", "hash", "blocks", "shingles"])

    return run


def _both(width: int, wide: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            prints = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
            wides, names, sizes, keys = [], [], [], []
            for text in texts:
                words = words_of(text)
                digests = [blake2b(x, digest_size=WIDE_BITS // 8).digest() for x in _shingles(words, wide)] if words else []
                wides.append(_majority(digests, WIDE_BITS) if words else bytes(WIDE_BITS // 8))
                distinct = b"".join(sorted({d[:8] for d in digests}))
                names.append(xxhash.xxh64_intdigest(distinct, SEED))
                sizes.append(len(distinct) // 8)
                keys.append(band_keys(np.frombuffer(distinct, np.uint64)) if words else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(prints.view(np.int64)), pa.array(wides, pa.binary()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))],
                ["doc_id", "hash", "fp", "wide", "set", "size", "keys"],
            )

    return run


def grouped_by_fingerprint(prints: DataFrame, radius: int) -> DataFrame:
    """fp and component_id of each distinct fp of prints (doc_id, fp)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(grouped.join(named, "root").select("fp", "component_id"), "groups")


def verified(texts: DataFrame, units: DataFrame, cells: DataFrame, wide: int, similarity: float) -> DataFrame:
    """Links (u, v) between groups of one cell that have texts whose shingle sets are similar.

    texts: doc_id, hash, _text. units: a row for each distinct shingle set, with group, size and row (doc_id and hash of one
    such text). cells: group and cell. Large cells are cut into blocks, and each two blocks meet once.
    """
    mine = materialise(units.join(cells, "group"), "candidates")
    shape = mine.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    asked = mine.join(shape, "cell").select("cell", "group", "blocks", F.col("row.doc_id").alias("doc_id"), F.col("row.hash").alias("hash"))
    asked = F.broadcast(asked) if mine.count() <= BROADCAST_ROWS else asked
    held = asked.join(texts, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash", "group"])
    sets = held.select("cell", "group", "hash", "blocks", "_text").mapInArrow(_sets(wide), "cell long, group long, hash long, blocks int, shingles binary")
    block = F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")
    met = sets.withColumn("b", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.groupBy("cell", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j")).applyInPandas(_similar(similarity), "u long, v long")


def similar_groups(docs: DataFrame, width: int = 3, radius: int = 2, wide: int = 5, similarity: float = SIMILARITY, estimate: bool = True) -> DataFrame:
    """doc_id (long), hash (of the text) and group (a number) of each row: the links of near_duplicates, and links between texts whose
    sets of shingles of `wide` words are similar.

    The latter are decided by the sets. Candidates share one of BANDS keys and have wide fingerprints of up to CANDIDATE_SD
    differing bits. First only keys travel; wide fingerprints follow for those keys that two texts share. estimate:
    fingerprints of LINKED_SD are linked without a look at the sets.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text")).withColumn("hash", F.xxhash64("_text"))
    prints = materialise(spread(texts).mapInArrow(_both(width, wide), "doc_id long, hash long, fp long, wide binary, set long, size long, keys array<long>"), "fingerprints")
    distinct = materialise(prints.select("fp").distinct(), "distinct")
    of = distinct.join(components(links(distinct, radius)), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("of"))
    different = prints.groupBy("fp", "wide", "set", "size").agg(F.min(F.struct("doc_id", "hash")).alias("row"), F.first("keys").alias("keys"))
    placed = materialise(different.join(of, "fp").withColumn("id", F.monotonically_increasing_id()), "placed")
    nodes = placed.groupBy("wide").agg(F.min("of").alias("node"))
    keyed = materialise(placed.select("id", F.explode("keys").alias("key")), "keys")
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    cut = keyed.join(shared, "key").withColumn("pieces", F.ceil(F.col("n") / MEETING_ROWS).cast("int"))
    met = cut.withColumn("b", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    meeting = met.select("id", F.when(F.col("pieces") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("b", "k"), F.greatest("b", "k"))).alias("run"))
    rows = meeting.join(placed.select("id", "wide", F.col("of").alias("node")), "id").select("run", "wide", "node")
    pairs = rows.repartition("run").sortWithinPartitions("run").mapInArrow(_near(most_differing(similarity, LINKED_SD), most_differing(similarity, CANDIDATE_SD)), "u long, v long, near boolean")
    same = placed.join(nodes, "wide").where("of <> node").select(F.col("of").alias("u"), F.col("node").alias("v"), F.lit(True).alias("near"))
    found = materialise(pairs.unionByName(same).where("u <> v").distinct(), "found")
    roots = materialise(components(found.where(F.col("near") & F.lit(estimate)).select("u", "v")), "roots")
    group = lambda rows, name: rows.join(roots.withColumnRenamed("node", name), name, "left").withColumn(name, F.coalesce("root", name)).drop("root")
    across = group(group(found.select("u", "v"), "u"), "v")
    cells = components(across).select(F.explode(F.array("node", "root")).alias("group"), F.col("root").alias("cell")).distinct()
    units = group(placed.withColumn("group", F.col("of")), "group").groupBy("group", "wide", "set", "size").agg(F.min("row").alias("row"))
    joined = materialise(components(verified(texts, units, cells, wide, similarity)), "joined")
    known = group(placed.select("fp", F.col("of").alias("group")).distinct(), "group").join(joined, F.col("group") == F.col("node"), "left").select("fp", F.coalesce("root", "group").alias("group"))
    return prints.join(known, "fp", "left").select("doc_id", "hash", "group")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that stay: for each group of similar_groups the row with the smallest doc_id, once if it is repeated.

    The decisions are narrow tables; texts are filtered by the ids of the rows that go.

    Rows of one doc_id and different texts are different rows. Rows without a doc_id cannot be named and stay.
    """
    mine = packed(docs.where("doc_id is not null")).withColumns({"_doc": F.col("_row.doc_id").cast("long"), "_hash": F.xxhash64(F.col("_row.text").cast("string"))})
    groups = similar_groups(docs.where("doc_id is not null"), width, radius).withColumnsRenamed({"doc_id": "_doc", "hash": "_hash"})
    ids = materialise(groups.groupBy("group", "_doc", "_hash").agg(F.count("*").alias("n")), "ids")
    stays = ids.groupBy("group").agg(F.min(F.struct("_doc", "_hash")).alias("row"))
    first = (F.col("row._doc") == F.col("_doc")) & (F.col("row._hash") == F.col("_hash"))
    dealt = ids.join(stays, "group").select("_doc", "_hash", "n", first.alias("first"))
    dropped = materialise(dealt.where("not first").select("_doc", "_hash"), "dropped")
    repeated = materialise(dealt.where("first and n > 1").select("_doc", "_hash"), "repeated")
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_DROPPED else t
    kept = mine.join(small(dropped), ["_doc", "_hash"], "left_anti")
    if not repeated.isEmpty():  # only rows that are repeated are compared with each other
        twice = small(repeated)
        kept = kept.join(twice, ["_doc", "_hash"], "left_anti").unionByName(kept.join(twice, ["_doc", "_hash"], "left_semi").dropDuplicates(["_doc", "_hash"]))
    return kept.select(*unpacked(kept)).unionByName(docs.where("doc_id is null"))


def hex16(value: Column) -> Column:
    """A long's bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
