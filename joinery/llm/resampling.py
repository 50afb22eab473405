"""Importance resampling towards a target distribution, by hashed n-grams.

Each task keeps a dictionary from distinct words to integers, starts it anew when it is full, and represents an n-gram as a
tuple of these. Of each distinct tuple the bytes are put together and hashed once, and counts are joined back by the tuples'
numbers. A dictionary over all tasks would have to be joined to every word of the corpus; what the tasks have in common are
the buckets, a fixed number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from joinery.llm.rows import SLICE_CHARS, added
from joinery.runtime import materialise, ship, spread

#: Bytes of a word, A-Z lowered; all others end one. Bytes of 128 and more belong to letters beyond ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a task's dictionary.
REMEMBERED = 500_000


class Dictionary(dict):
    """Word -> number; a missing word gets the next one."""

    def __init__(self) -> None:
        self.new = count()

    def __missing__(self, word: bytes) -> int:
        self[word] = number = next(self.new)
        return number


class Hasher:
    """The buckets of all n-grams of texts; distinct tuples are hashed once as long as the dictionary lasts."""

    def __init__(self, longest: int, buckets: int) -> None:
        self.longest, self.buckets = longest, buckets
        self.words, self.of_word = Dictionary(), np.zeros(0, np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > REMEMBERED:
            self.words, self.of_word = Dictionary(), np.zeros(0, np.int64)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def hashed(self, gram: bytes) -> int:
        return zlib.crc32(gram) % self.buckets

    def grams(self, words: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: the position of the first word and the bucket of each n-gram of the texts, which have so many words each."""
        ids = self.ids(words)
        known = len(self.of_word)
        if len(self.words) > known:
            new = list(self.words)[known:]
            self.of_word = np.r_[self.of_word, np.fromiter(map(self.hashed, new), np.int64, len(new))]
        at = np.arange(len(ids))
        yield at, self.of_word[ids]
        left = np.repeat(np.cumsum(sizes), sizes) - at  # words from here to the end of the text
        codes = ids
        for n in range(2, self.longest + 1):
            inside = np.flatnonzero(left[at] >= n)
            at = at[inside]
            # the tuple is the number of its first n - 1 words and the last one's; numbered anew, codes stay below the number of words
            pair = codes[inside] * len(self.words) + ids[at + n - 1]
            _, first, codes = np.unique(pair, return_index=True, return_inverse=True)
            of_tuple = np.fromiter((self.hashed(b" ".join(words[i : i + n])) for i in at[first].tolist()), np.int64, len(first))
            yield at, of_tuple[codes]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Rows of about SLICE_CHARS together, their words one after the other, and how many each has."""
    for batch in batches:
        texts = batch.column("_text").cast(pa.binary())
        start, words, sizes, held = 0, [], [], 0
        for i in range(len(texts)):
            text = texts[i].as_py() or b""
            new = text.translate(WORD_BYTES).split()
            words += new
            sizes.append(len(new))
            held += len(text)
            if held >= SLICE_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), words, np.array(sizes, np.int64)
                start, words, sizes, held = i + 1, [], [], 0


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of the column _text fall in each bucket; a task sends one row a bucket at most."""
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(longest, buckets), np.zeros(buckets, np.int64)
        for _, words, sizes in _slices(batches):
            for _, found in hasher.grams(words, sizes):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in spread(rows).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of each bucket's smoothed shares, target over source, in doubles."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """rows without _text, with n_words, n_features and weight (the sum of its features' gains)."""
    ship(rows.sparkSession)
    keep = [f for f in rows.schema.fields if f.name != "_text"]
    names = [f.name for f in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(longest, len(gain))
        for batch, words, sizes in _slices(batches):
            text = np.repeat(np.arange(len(sizes)), sizes)
            features, weight = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for at, found in hasher.grams(words, sizes):
                features += np.bincount(text[at], minlength=len(sizes))
                np.add.at(weight, text[at], gain[found])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sizes), pa.array(features), pa.array(weight)], [*names, "n_words", "n_features", "weight"])

    return spread(rows).mapInArrow(run, T.StructType([*keep, *added("n_words long, n_features long, weight long").fields]))


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256('seed:key')."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], drawn: Callable[[int], int], takes_part: Column) -> DataFrame:
    """rows with rank: 1, 2, 3 ... in `order` for the first drawn(n) of the n rows that take part, else null.

    Sampled splitters deal the rows in order, each range is sorted, and the ranges' sizes (a row a partition) say where each begins.
    """
    part = rows.withColumn("_in", F.coalesce(takes_part, F.lit(False)))
    dealt = part.repartitionByRange(F.desc("_in"), *order).sortWithinPartitions(F.desc("_in"), *order)
    # the number's upper bits are the partition, its lower 33 bits the row's place there
    dealt = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    range_, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(range_.alias("_range")).agg(F.count("*").alias("n"), F.sum(F.col("_in").cast("long")).alias("taking"))
    up_to = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    most = drawn(int(sizes.agg(F.sum("taking")).first()[0] or 0))
    first = sizes.select("_range", (up_to - F.col("n")).alias("_first"))
    rank = F.col("_first") + place + 1
    return dealt.withColumn("_range", range_).join(F.broadcast(first), "_range").withColumn("rank", F.when(F.col("_in") & (rank <= most), rank)).drop("_in", "_at", "_range", "_first")


def resampled(docs: DataFrame, target: DataFrame, seed: int, percent: int, longest: int = 2, buckets: int = 10_000, least_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs.

    docs has doc_id and text, target has text. A row's score is its weight and a Gumbel draw fixed by seed and doc_id; of the rows
    of at least `least_words` words the floor(percent / 100) with the highest scores have a rank, ties by smaller doc_id, nulls last.
    A null text has no words, weight 0 and no rank; texts are read whole; a null doc_id draws like an empty one; repeated rows
    each take part; an empty target or table is one without features. Other columns are not looked at.
    """
    text = F.col("text").cast("string").alias("_text")
    rows = docs.select("doc_id", text)
    gain = gains(bucket_counts(rows.select("_text"), longest, buckets), bucket_counts(target.select(text), longest, buckets))
    # written once, since splitters are sampled in a pass of their own
    scored = materialise(weighed(rows, gain, longest), "weights")
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return ranked(scored, order, lambda n: percent * n // 100, F.col("n_words") >= least_words)
