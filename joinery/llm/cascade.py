"""URL verdicts by longest matching rule, then by a Bloom filter cascade.

The cascade holds a list of keys exactly, as far as the corpus's own keys (the universe) go. Level 1 encodes the
listed keys; the unlisted keys that it wrongly accepts are encoded by level 2, the listed keys that this accepts by
level 3, and so on until a level accepts none. A key's membership is the parity of the first level that rejects it.
The universe is an aggregate over the union of both sides' keys, so nothing is joined with the list, neither here nor
when rows are tested, and for every key of the universe the answer is exact.

Keys are spread over shards by hash, each with a cascade of its own, so that no filter grows with the corpus. Rows are
tested in passes: each takes as many shards' cascades as stay under BROADCAST_BYTES to the rows of those shards, which
are not shuffled. A pass is written before the next one's cascades reach the driver.

Defined results: a null url, or one without "://", has an empty host and path; an empty host is a key like any
other; repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.runtime import materialise, ship

#: Keys of a shard, on average.
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; empty if there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, as host + path, and its verdict; null if none fits."""
    found = verdict = F.lit(None).cast("string")
    for decides, at, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        found, verdict = F.when(fits, at + start).otherwise(found), F.when(fits, decides).otherwise(verdict)
    return found, verdict


def _hashes(keys: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass"), level) for k in keys), ">u8").reshape(-1, 2)
    return digests[:, 0].astype(np.uint64), digests[:, 1].astype(np.uint64) | np.uint64(1)


class Bloom:
    def __init__(self, keys: list[str], rate: float, level: int):
        self.level = level
        self.rounds = max(1, round(-np.log2(rate)))
        bits = max(64, int(np.ceil(len(keys) * -np.log(rate) / np.log(2) ** 2)))
        self.bits = np.zeros(bits, bool)
        for at in self._places(keys):
            self.bits[at] = True

    def _places(self, keys: list[str]):
        first, step = _hashes(keys, self.level)
        for i in range(self.rounds):
            yield (first + np.uint64(i) * step) % np.uint64(len(self.bits))

    def __contains__(self, key: str) -> bool:
        return bool(self.test([key])[0])

    def test(self, keys: list[str]) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= self.bits[at]
        return out

    def pack(self) -> bytes:
        return b"".join((len(self.bits).to_bytes(8, "little"), self.rounds.to_bytes(8, "little"), np.packbits(self.bits).tobytes()))


class Cascade:
    """Filters at alternate levels over listed and unlisted keys."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def build(cls, listed: list[str], unlisted: list[str]) -> Cascade:
        levels: list[Bloom] = []
        hold, against = listed, unlisted
        while hold:
            # the first level lets about sqrt(1/2) x as many keys pass as are listed; later levels halve
            rate = 0.5 if levels else min(0.5, max(1e-6, 0.7071 * len(listed) / max(1, len(unlisted))))
            levels.append(Bloom(hold, rate, len(levels)))
            passed = [k for k, yes in zip(against, levels[-1].test(against), strict=True) if yes] if against else []
            hold, against = passed, hold
        return cls(levels)

    def test(self, keys: list[str]) -> np.ndarray:
        """True for the keys that are listed, exactly so for all keys that the cascade was built over."""
        out, open_ = np.full(len(keys), len(self.levels) % 2 == 1), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            if not len(open_):
                break
            yes = level.test([keys[j] for j in open_])
            out[open_[~yes]] = i % 2 == 1
            open_ = open_[yes]
        return out

    def pack(self) -> bytes:
        packed = [x.pack() for x in self.levels]
        return b"".join(len(x).to_bytes(8, "little") + x for x in packed)

    @classmethod
    def unpack(cls, data: bytes) -> Cascade:
        levels, at = [], 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            body = data[at + 8 : at + 8 + size]
            bloom = Bloom.__new__(Bloom)
            bloom.level, bloom.rounds = len(levels), int.from_bytes(body[8:16], "little")
            bloom.bits = np.unpackbits(np.frombuffer(body[16:], np.uint8), count=int.from_bytes(body[:8], "little")).astype(bool)
            levels.append(bloom)
            at += 8 + size
        return cls(levels)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key")
    made = Cascade.build(rows["key"][rows["listed"]].tolist(), rows["key"][~rows["listed"]].tolist())
    return pd.DataFrame({"shard": [int(key[0])], "cascade": [made.pack()]})


def cascades(keys: DataFrame, shards: int) -> DataFrame:
    """shard and its packed cascade. keys: distinct `key` and whether it is `listed`; this is the whole universe."""
    ship(keys.sparkSession)
    return keys.select("key", "listed", shard_of(F.col("key"), shards).alias("shard")).groupBy("shard").applyInPandas(_build, "shard int, cascade binary")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _tested(packed: dict[int, bytes], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = lru_cache(maxsize=64)(lambda shard: Cascade.unpack(packed[shard]))
        for batch in batches:
            key = batch.column("_key").dictionary_encode()
            keys, index = key.dictionary.to_pylist(), key.indices.to_numpy()
            shards = np.zeros(len(keys), np.int64)
            shards[index] = batch.column("_shard").to_numpy()
            listed = np.zeros(len(keys), bool)
            for s in np.unique(shards):
                at = np.flatnonzero(shards == s)
                listed[at] = cascade(int(s)).test([keys[i] for i in at])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(listed[index])], [*names, "listed"])

    return run


def passes(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Shards (given with their bytes) in runs of up to `most` bytes; a larger shard is a run of its own."""
    runs: list[list[int]] = []
    held = most + 1
    for shard, size in sorted(sizes):
        if held + size > most:
            runs.append([])
            held = 0
        runs[-1].append(shard)
        held += size
    return runs


def with_membership(rows: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """rows with `listed`: whether their key is among `listed` (column key), by cascades over the keys of rows."""
    ship(rows.sparkSession)
    mine = rows.select(key.alias("key"), F.lit(True).alias("mine"), F.lit(False).alias("listed"))
    both = mine.unionByName(listed.select("key", F.lit(False).alias("mine"), F.lit(True).alias("listed")))
    universe = both.groupBy("key").agg(F.max("mine").alias("mine"), F.max("listed").alias("listed")).where("mine").drop("mine")
    universe = materialise(universe, "universe")
    shards = max(1, -(-universe.count() // SHARD_KEYS))
    filters = materialise(cascades(universe, shards), "cascades")
    sizes = [(r["shard"], r["bytes"]) for r in filters.select("shard", F.octet_length("cascade").alias("bytes")).collect()]
    names = rows.columns
    keyed = rows.select(*names, key.alias("_key"), shard_of(key, shards).alias("_shard"))
    schema = type(rows.schema)([*rows.schema.fields]).add("listed", "boolean")

    def tested(run: list[int]) -> DataFrame:
        packed = {r["shard"]: bytes(r["cascade"]) for r in filters.where(F.col("shard").isin(run)).collect()}
        return keyed.where(F.col("_shard").isin(run)).mapInArrow(_tested(packed, names), schema)

    runs = passes(sizes, BROADCAST_BYTES)
    if len(runs) < 2:
        return tested(runs[0]) if runs else rows.withColumn("listed", F.lit(False)).limit(0)
    done = [materialise(tested(run), "tested") for run in runs]
    return reduce(DataFrame.unionByName, done)
