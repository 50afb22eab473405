"""Exact top-k inner products by pivot-table elimination.

Every vector gets one more entry that brings its length to the largest length M; a query gets zero there. Then the
inner product falls as the Euclidean distance grows: d^2 = |q|^2 + M^2 - 2 q.x, and distances obey the triangle
inequality. The table holds each candidate's distances to PIVOTS pivots, worked out once; the largest of
|d(q, p) - d(x, p)| over the pivots is a lower bound of the distance, so an upper bound of the score.

Candidates are dealt by their nearest pivot. Such a cell keeps the interval of its rows' distances to each pivot, which
bounds the scores of all its rows at once, and is cut by hash into blocks of bounded size. A query first searches one
block of its own nearest pivot's cell; its k-th score there is the threshold that whole cells must reach to be looked at,
and only into those is it dealt. In each block a query takes the candidates in stages of falling bounds; after each
stage all candidates with a bound below its k-th score or threshold are eliminated, and it stops exactly when none is left.
A query's best of all blocks are merged with a partial top-k before the shuffle.

Pivots are picked from a sample of SAMPLE rows, each farthest from those before; they decide the speed, not the result.
What reaches the driver are the pivots, and counts and intervals by cell and pivot.

Defined results: rows without an id, and vectors that are null or hold null or non-finite entries, take no part; shorter
vectors count as filled up with zeros; of repeated rows each is answered, and each is a candidate of its own; rows of the
same id as the query are not its candidates; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.runtime import materialise, ship

PIVOTS, SAMPLE = 64, 4096
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 32_768
#: Candidates that a query takes at a time, of the largest bounds; then it takes all that are left.
STAGES = (64, 1024)
#: Queries whose bounds are held at a time.
_TOGETHER = 128
#: Below this, sums of products in doubles are exact.
_EXACT = float(1 << 53)


def pick(sample: np.ndarray, largest: float, count: int = PIVOTS) -> np.ndarray:
    """Pivots (with their added entry): each the sample row farthest from those before."""
    if not len(sample):
        return np.zeros((0, sample.shape[1] + 1))
    points = np.c_[sample, np.sqrt(np.maximum(0, largest - (sample**2).sum(axis=1)))]
    picked, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(points)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[picked[-1]]) ** 2).sum(axis=1))
    return points[picked]


def distances(vectors: np.ndarray, added: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(axis=1) + added**2
    dot = vectors @ pivots[:, :-1].T + added[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(0, square[:, None] + (pivots**2).sum(axis=1) - 2 * dot))


def search(ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_table: np.ndarray, largest: float, k: int, least: np.ndarray | None = None):
    """(query number, candidate number, score) of the best k of each query among these candidates; ids must rise.

    least: scores that a query's candidates must reach. Also the number of scores worked out.
    """
    found, looked = [], 0
    least = np.full(len(queries), -np.inf) if least is None else least
    exact = largest < _EXACT
    # by pivot, in singles: their rounding is a small part of the slack
    table, query_table = np.ascontiguousarray(table.T, np.float32), query_table.astype(np.float32)
    for at in range(0, len(queries), _TOGETHER):
        some = slice(at, at + _TOGETHER)
        bound = np.zeros((len(queries[some]), len(ids)), np.float32)
        off = np.empty_like(bound)
        for p in range(len(table)):
            np.subtract(query_table[some, p, None], table[p], out=off)
            np.maximum(bound, np.abs(off, out=off), out=bound)
        bound = scores_at((queries[some] ** 2).sum(axis=1)[:, None], bound.astype(float), largest)
        for i in range(len(bound)):
            q, mine, floor = queries[at + i], bound[i], least[at + i]
            best_id, best_score = np.zeros(0, np.int64), np.zeros(0)
            left = np.arange(len(mine))
            for size in (*STAGES, len(mine)):
                if len(best_score) >= k:
                    floor = max(floor, best_score[k - 1])
                left = left[mine[left] >= floor]  # exact: no bound below the k-th score so far can hold a better one
                if not len(left):
                    break
                if size < len(left):
                    order = np.argpartition(-mine[left], size)
                    now, left = left[order[:size]], left[order[size:]]
                else:
                    now, left = left, left[:0]
                looked += len(now)
                now = now[ids[now] != query_ids[at + i]]
                if not exact:
                    score = np.array([float(sum(int(a) * int(b) for a, b in zip(vectors[n], q, strict=True))) for n in now])
                else:  # most rows: one product over the block as it lies, without copying them out
                    score = (vectors @ q)[now] if 2 * len(now) > len(vectors) else vectors[now] @ q
                beats = score >= floor
                best_id, best_score = np.r_[best_id, now[beats]], np.r_[best_score, score[beats]]
                keep = np.lexsort((best_id, -best_score))[:k]
                best_id, best_score = best_id[keep], best_score[keep]
            found.append((np.full(len(best_id), at + i), best_id, best_score))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    return (*map(np.concatenate, zip(*found, strict=True)), looked)


def scores_at(square: np.ndarray, distance: np.ndarray, largest: float) -> np.ndarray:
    """Upper bound of the score at a lower bound of the distance, for queries of these squared lengths; slack covers rounding."""
    return np.floor((square + largest - distance**2) / 2 + 2e-6 * (square + largest) + 1e-3)


def reached(query_table: np.ndarray, square: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray, largest: float) -> np.ndarray:
    """Which cells (of intervals low to high by cell and pivot; low above high: empty) can hold a score of `least` for each query."""
    out = np.zeros((len(query_table), len(low)), bool)
    for c in np.flatnonzero((low <= high).all(axis=1)):
        gap = np.maximum(0, np.maximum(low[c] - query_table, query_table - high[c])).max(axis=1)
        out[:, c] = scores_at(square, gap, largest) >= least
    return out


def _tabled(pivots: np.ndarray, dim: int, largest: float, added: bool):
    """Rows with their table entries and their cell; added: with the entry that brings a candidate to the largest length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), dim)
            more = np.sqrt(np.maximum(0, largest - (vectors**2).sum(axis=1))) if added else np.zeros(len(vectors))
            table = distances(vectors, more, pivots)
            binary = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (vectors, table)]
            cell = pa.array(table.argmin(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("copies"), batch.column("_key"), *binary, cell], ["vec_id", "copies", "_key", "v", "t", "cell"])

    return run


def _bounded(count: int):
    """For each cell and pivot the interval of distances and the number of rows, of one task's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full((count, count), np.inf), np.full((count, count), -np.inf), np.zeros(count, np.int64)
        for batch in batches:
            table, cell = _stack(batch.column("t").to_pandas(), count), batch.column("cell").to_numpy()
            np.minimum.at(low, cell, table)
            np.maximum.at(high, cell, table)
            n += np.bincount(cell, minlength=count)
        c, p = (x.ravel() for x in np.indices((count, count)))
        here = n[c] > 0
        columns = (c.astype(np.int32), p.astype(np.int32), low.ravel(), high.ravel(), n[c])
        yield pa.RecordBatch.from_arrays([pa.array(x[here]) for x in columns], ["cell", "pivot", "low", "high", "n"])

    return run


def _wanted(low: np.ndarray, high: np.ndarray, dim: int, largest: float):
    """Queries with the cells that their threshold does not eliminate."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, table = (_stack(batch.column(c).to_pandas(), n) for c, n in (("v", dim), ("t", low.shape[1])))
            which = reached(table, (vectors**2).sum(axis=1), batch.column("least").to_numpy(), low, high, largest)
            cells = pa.array([np.flatnonzero(x).astype(np.int32) for x in which], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _QUERY), cells], [*_QUERY, "cells"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, column.value_lengths().to_numpy(zero_copy_only=False)])
    if len(column) and len(flat) == dim * len(column) and (np.diff(ends) == dim).all():
        return flat.reshape(-1, dim).astype(float)
    for i in range(len(column)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), width)


_QUERY = ("vec_id", "copies", "_key", "v", "t", "b", "least")
_FOUND = "query_id long, _query long, copies long, vec_id long, score long, times long"


def _met(width: int, dim: int, largest: float, k: int):
    """The best k of each query that meets a block, of the scores that reach its threshold; a query without any has one row of nulls."""

    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        queries, query_table = _stack(asked["v"], dim), _stack(asked["t"], width)
        ids, query_ids = rows["vec_id"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64)
        q, x, score, _ = search(ids, _stack(rows["v"], dim), _stack(rows["t"], width), query_ids, queries, query_table, largest, k, asked["least"].to_numpy(float))
        lone = np.setdiff1d(np.arange(len(asked)), q)
        every = np.r_[q, lone].astype(int)
        out = pd.DataFrame({"query_id": query_ids[every], "_query": asked["_key"].to_numpy()[every], "copies": asked["copies"].to_numpy()[every]})
        for name, values in (("vec_id", ids[x]), ("score", score.astype(np.int64)), ("times", rows["copies"].to_numpy(np.int64)[x])):
            out[name] = pd.array(np.r_[values, np.zeros(len(lone), np.int64)], "Int64")
            out.loc[len(q) :, name] = pd.NA
        return out

    return run


def _blocks(table: DataFrame, first: list[int], parts: list[int]) -> DataFrame:
    """table with its rows' block b: a part of their cell."""
    at = lambda x: F.element_at(F.array(*map(F.lit, x)), F.col("cell") + 1)
    return table.withColumn("b", (at(first) + F.pmod("_key", at(parts))).cast("int"))


def _searched(rows: DataFrame, asked: DataFrame, groups: list[int], searcher) -> DataFrame:
    """Blocks of candidates meet blocks of queries; groups: blocks of queries that each cell meets, none: its rows stay out."""
    number = F.element_at(F.array(*map(F.lit, groups)), F.col("cell") + 1)
    dealt = rows.select("vec_id", "copies", "v", "t", "b", F.explode(F.sequence(F.lit(1), F.when(number > 0, number), F.lit(1))).alias("a"))
    ones = asked.withColumn("a", F.pmod(F.xxhash64("_key"), number).cast("int") + 1).select(*_QUERY, "a")
    return dealt.groupBy("b", "a").cogroup(ones.groupBy("b", "a")).applyInPandas(searcher, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    Both tables: vec_id long, v array<long>.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    # copies are counted before rows are dealt: no row that repeats makes a block hot
    keyed = [materialise(t.where(usable).groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("_key", F.xxhash64("vec_id", "v")), n) for t, n in ((vectors, "vectors"), (queries, "queries"))]
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = [t.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first() for t in keyed]
    largest, dim = max(float(s[1] or 0) for s in stats), max(int(s[2] or 0) for s in stats)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not stats[0][0] or not stats[1][0]:
        return empty
    sample = keyed[0].orderBy(F.xxhash64("_key"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    pivots = pick(_matrix(sample, dim), largest)
    width = len(pivots)
    kind = "vec_id long, copies long, _key long, v binary, t binary, cell int"
    rows = materialise(keyed[0].mapInArrow(_tabled(pivots, dim, largest, True), kind), "table")

    low, high, n = np.full((width, width), np.inf), np.full((width, width), -np.inf), [0] * width
    bounded = rows.select("t", "cell").mapInArrow(_bounded(width), "cell int, pivot int, low double, high double, n long")
    for r in bounded.groupBy("cell", "pivot").agg(F.min("low"), F.max("high"), F.sum("n")).collect():  # at most PIVOTS squared
        low[r[0], r[1]], high[r[0], r[1]], n[r[0]] = r[2], r[3], r[4]
    parts = [max(1, -(-x // BLOCK_ROWS)) for x in n]
    first = [sum(parts[:c]) for c in range(width)]
    dealt = _blocks(rows, first, parts)

    # each query in one block of its own cell; a cell without candidates gives no threshold
    asked = materialise(_blocks(keyed[1].mapInArrow(_tabled(pivots, dim, largest, False), kind), first, parts), "asked")
    here = dict(asked.groupBy("cell").count().collect())
    groups = [-(-here.get(c, 0) // (parts[c] * BLOCK_QUERIES)) for c in range(width)]
    searcher = _met(width, dim, largest, k)
    near = materialise(_searched(dealt, asked.withColumn("least", F.lit(-np.inf)), groups, searcher), "near")
    kth = near.where("vec_id IS NOT NULL").groupBy("_query", "query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s"))
    known = asked.join(kth.select("_query", F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s")).alias("s")).withColumnRenamed("_query", "_key"), ["_key", "vec_id"], "left")
    known = known.withColumn("least", F.coalesce("s", F.lit(-np.inf)))

    # then in all other blocks of the cells that can still hold a better score
    wants = materialise(known.select(*_QUERY).mapInArrow(_wanted(low, high, dim, largest), "vec_id long, copies long, _key long, v binary, t binary, b int, least double, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells"), "wants")
    here = dict(wants.groupBy("cell").count().collect())
    groups = [-(-here.get(c, 0) // BLOCK_QUERIES) for c in range(width)]
    at = lambda x: F.element_at(F.array(*map(F.lit, x)), F.col("cell") + 1)
    block = F.explode(F.sequence(at(first), at(first) + at(parts) - 1))
    others = wants.withColumn("_b", block).where(F.col("_b") != F.col("b")).drop("b").withColumnRenamed("_b", "b")
    far = _searched(dealt, others, groups, searcher)

    found = near.unionByName(far).where("vec_id IS NOT NULL")
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    best = F.row_number().over(Window.partitionBy("query_id", "_query").orderBy(F.desc("score"), "vec_id"))
    ranked = each.withColumn("rank", best).where(F.col("rank") <= k)
    answered = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return answered.select("query_id", "rank", "vec_id", "score")


def scaled(rows: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and v: each entry x as floor(factor * x); null for vectors that take no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select("vec_id", F.when(~bad, F.transform("embedding", lambda x: F.floor(x.cast("double") * factor))).alias("v"))
