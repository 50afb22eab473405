"""Sets of bonds as packed words: a row per set and word of 64 members that has any; no Python in the plans.

A set's words are dealt like any rows, so unions, counts and tests of sets of any size are aggregates and joins by word number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def packed(sets: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """keys, word, bits of sets (keys, mask: an array of members from 0); repeated members count once, empty and null sets have no words."""
    each = sets.select(*keys, F.explode(mask).alias("member"))
    word = F.floor(F.col("member") / WORD).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("member", F.lit(WORD)).cast("int"))
    return each.groupBy(*keys, word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def word(members: Column) -> Column:
    """An array of members below WORD as one word."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    return F.aggregate(members, F.lit(0).cast("long"), lambda bits, i: bits.bitwiseOR(bit(i)))


def united(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, bits: the union of the sets of each key."""
    return words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def members(bits: Column, word: Column) -> Column:
    """The members of a word, ascending."""
    here = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("getbit", bits, i) == 1)
    return F.transform(here, lambda i: word * WORD + i)


def unpacked(words: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """keys and the ascending array of members; a set without members has no row."""
    parts = F.array_sort(F.collect_list(F.struct("word", members(F.col("bits"), F.col("word")).alias("m"))))
    return words.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["m"])).alias(mask))


def first_bit(bits: Column) -> Column:
    """Number of the lowest bit that is set; null if none is."""
    digits = F.bin(bits)
    return F.when(bits != 0, F.length(digits) - F.length(F.rtrim(digits, F.lit("0"))))


def sizes(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, members: how many members each set has."""
    return words.groupBy(*keys).agg(F.sum(F.bit_count("bits").cast("long")).alias("members"))


def next_member(words: DataFrame, keys: list[str], position: int) -> DataFrame:
    """keys, next: the least member at or after a position; sets without one have no row."""
    at, offset = divmod(position, WORD)
    above = F.when(F.col("word") == at, F.col("bits").bitwiseAND(F.lit(-(1 << offset)).cast("long"))).otherwise(F.col("bits"))
    return words.where(F.col("word") >= at).select(*keys, (F.col("word") * WORD + first_bit(above)).alias("next")).where("next IS NOT NULL").groupBy(*keys).agg(F.min("next").alias("next"))


def overlapping_pairs(words: DataFrame, keys: list[str], ix: str = "ix") -> DataFrame:
    """keys, left, right: each two sets of a key, by their number, that share a member."""
    a, b = words.alias("a"), words.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "word"]]
    met = a.join(b, [*same, F.col(f"a.{ix}") < F.col(f"b.{ix}"), F.col("a.bits").bitwiseAND(F.col("b.bits")) != 0])
    return met.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{ix}").alias("left"), F.col(f"b.{ix}").alias("right")).distinct()
