"""Scalar functions as Column expressions; all run in the JVM unless noted."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from joinery.kernels import chains

LARGEST_WORK_PER_WORKER = 32768


def code_points(text: Column) -> Column:
    """The symbols of a string, one per Unicode scalar."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def canonical_text(text: Column, accept_reversed: bool = False) -> Column:
    """The lesser of a string and its reversal, in code point order; without accept_reversed the string itself."""
    return F.least(text, F.reverse(text)) if accept_reversed else text


def is_palindrome(text: Column) -> Column:
    return text == F.reverse(text)


def symbols(text: Column, offset: Column, length: Column) -> Column:
    """Substring by zero-based scalar offset."""
    return F.substring(text, offset + 1, length)


def ceil_log2(n: Column) -> Column:
    """Exact in integers: the number of binary digits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def chain_length(n: Column) -> Column:
    """Shortest addition chain for n, exact to chains.EXACT_UP_TO, then ceil(log2 n)."""
    table = F.array(*[F.lit(chains.chain_length(i)) for i in range(1, chains.EXACT_UP_TO + 1)])
    return F.when(n <= chains.EXACT_UP_TO, F.get(table, (n - 1).cast("int"))).otherwise(ceil_log2(n))


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("bigint")


def packing_bound(n: Column, k: Column) -> Column:
    """Most joins that parts of up to k units save on n units."""
    return n - ceil_div(n, k)


def eligible_packing_bound(n: Column, k: Column, eligible: Column) -> Column:
    """As packing_bound, where only `eligible` units can lie in parts of k units."""
    large = F.floor(eligible / k)
    return n - large - ceil_div(n - large * k, k - 1)


def trivial_bound(n: Column, components: Column | None = None) -> Column:
    """Joins without any reuse; between components they are left out if these are given."""
    return n - (F.lit(1) if components is None else components)


def compensated(index: Column, components: Column) -> Column:
    return index - F.greatest(components - 1, F.lit(0))


def bond_class(a: Column, b: Column, label: Column) -> Column:
    """Unordered endpoint labels and the bond's label."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), label.alias("label"))


def bond_colour(label: Column) -> Column:
    """single, double, triple, the number from 4 on; an error below 1."""
    named = F.when(label == 1, "single").when(label == 2, "double").when(label == 3, "triple")
    return named.when(label >= 4, label.cast("string")).otherwise(F.raise_error(F.lit("bond labels are positive")).cast("string"))


def strict_integer(text: Column) -> Column:
    """A whole field as an integer (one leading sign); null if anything else is in it or it does not fit."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def trim_spaces(text: Column) -> Column:
    """Without leading and trailing U+0020; other white space stays."""
    return F.trim(text)


def is_molfile(path: Column) -> Column:
    return F.lower(F.right(path, F.lit(4))).isin(".mol", ".sdf")


def valid_utf8(data: Column) -> Column:
    """Strict UTF-8: no overlong forms, surrogates or values over U+10FFFF."""
    return F.is_valid_utf8(data.cast("string"))


def fingerprint(*columns: Column) -> Column:
    """Hash for bucketing; never an identity."""
    return F.xxhash64(*columns)


def content_digest(data: Column) -> Column:
    return F.sha2(data, 256)


def work_estimate(root_jobs: Column, nodes: Column) -> Column:
    """Work units of a search, saturating at the largest long."""
    wide = root_jobs.cast("decimal(38,0)") * F.greatest(nodes, F.lit(1)).cast("decimal(38,0)")
    return F.least(wide, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")


def worker_budget(work: Column, ranks: Column | None = None) -> Column:
    """Workers per rank: one below LARGEST_WORK_PER_WORKER, else teams of 8, 16, 32, ... by work."""
    units = ceil_div(work, F.lit(LARGEST_WORK_PER_WORKER))
    team = F.greatest(F.lit(8), F.pow(F.lit(2), ceil_log2(units)).cast("bigint"))
    total = F.when(work < LARGEST_WORK_PER_WORKER, F.lit(1)).otherwise(team)
    return F.greatest(F.lit(1), F.floor(total / (F.lit(1) if ranks is None else ranks))).cast("int")


def shard_of(ordinal: Column, shards: int) -> Column:
    """Round-robin shard of a zero-based ordinal."""
    return F.pmod(ordinal, F.lit(shards)).cast("int")


def state_key(parts: Column) -> Column:
    """Key of a search state: the first (kept) part stays in place, the others are sorted."""
    return F.concat(F.slice(parts, 1, 1), F.array_sort(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))))


def ascii_json(value: Column) -> Column:
    """JSON with all non-ASCII characters as \\uXXXX escapes (surrogate pairs beyond U+FFFF); an Arrow function."""
    @F.pandas_udf("string")
    def escaped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=True, separators=(",", ":")), na_action="ignore")

    return escaped(F.to_json(value))


# masks: edge sets as sorted arrays of edge numbers


def mask_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def mask_common(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def mask_minus(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def mask_either(a: Column, b: Column) -> Column:
    """In one of both, not in both."""
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def mask_contains(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def masks_disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def next_member(mask: Column, position: Column) -> Column:
    """The least member at or after a position; null if there is none."""
    return F.array_min(F.filter(mask, lambda x: x >= position))
