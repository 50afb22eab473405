"""Summaries, paired ratios, gates and scaling of run samples.

Samples are rows (suite, case, role, round, wall_seconds, clock_ticks, workers); roles are baseline and candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, minimum, median, mean, mad (median absolute deviation), p95; percentiles interpolate linearly."""
    first = samples.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.percentile(value, 0.95).alias("p95"))
    off = samples.join(first.select(*keys, "median"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return first.join(off, keys).select(*keys, "n", "minimum", "median", "mean", "mad", "p95")


def round_totals(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Total of all cases per role and round."""
    return samples.groupBy(*keys, "role", "round").agg(F.sum(value).alias("total"))


def paired_ratios(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, round, ratio: baseline over candidate of the same round (over 1: the candidate is faster)."""
    by = samples.groupBy(*keys, "round").agg(F.sum(F.when(F.col("role") == "baseline", F.col(value))).alias("b"), F.sum(F.when(F.col("role") == "candidate", F.col(value))).alias("c"))
    return by.where("b is not null and c > 0").select(*keys, "round", (F.col("b") / F.col("c")).alias("ratio"))


def geometric_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.exp(F.avg(F.ln(value))).alias("geomean"))


def speed_gate(samples: DataFrame, threshold: float = 1.0) -> DataFrame:
    """suite, case, measure, median_ratio, passes: every case by clock, every suite (case null) by clock and wall."""
    cases = paired_ratios(samples, ["suite", "case"], "clock_ticks").groupBy("suite", "case").agg(F.percentile("ratio", 0.5).alias("median_ratio")).withColumn("measure", F.lit("clock"))
    out = cases
    for measure, value in (("clock", "clock_ticks"), ("wall", "wall_seconds")):
        suites = paired_ratios(samples, ["suite"], value).groupBy("suite").agg(F.percentile("ratio", 0.5).alias("median_ratio"))
        out = out.unionByName(suites.withColumns({"case": F.lit(None).cast("string"), "measure": F.lit(measure)}))
    return out.select("suite", "case", "measure", "median_ratio", (F.col("median_ratio") > threshold).alias("passes"))


def scaling(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, workers, median, speedup (over one worker), efficiency, regressed (speedup not over 1)."""
    by = samples.groupBy(*keys, "workers").agg(F.percentile(value, 0.5).alias("median"))
    one = by.where("workers = 1").select(*keys, F.col("median").alias("_one"))
    ratio = F.col("_one") / F.col("median")
    out = by.join(one, keys).withColumns({"speedup": ratio, "efficiency": ratio / F.col("workers")})
    return out.select(*keys, "workers", "median", "speedup", "efficiency", ((F.col("workers") > 1) & (F.col("speedup") <= 1)).alias("regressed"))


def bound_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps of bounds (columns exact, bound, trivial): improved, unchanged, worse counts, mean, median and largest gap."""
    gap = F.col("bound") - F.col("exact")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("bound") < F.col("trivial")).alias("improved"),
        F.count_if(F.col("bound") == F.col("trivial")).alias("unchanged"),
        F.count_if(F.col("bound") > F.col("trivial")).alias("worse"),
        F.count_if(gap == 0).alias("tight"),
        F.avg(gap).alias("mean_gap"),
        F.percentile(gap, 0.5).alias("median_gap"),
        F.max(gap).alias("largest_gap"),
    )


def hit_rate(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses); null if there were none."""
    return F.try_divide(hits, hits + misses)


def cross_report(summaries: DataFrame, keys: list[str], roles: list[str], value: str = "median") -> DataFrame:
    """One row per key with a column per role."""
    return summaries.groupBy(*keys).pivot("role", roles).agg(F.first(value))


def censored_speed(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Bound against exact run times (columns exact_seconds, bound_seconds, timed_out): a timeout gives a lower bound of the ratio only."""
    ratio = F.col("exact_seconds") / F.col("bound_seconds")
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("timed_out").alias("timeouts"), F.percentile(F.when(~F.col("timed_out"), ratio), 0.5).alias("median_ratio"), F.min(F.when(F.col("timed_out"), ratio)).alias("least_timeout_ratio"))


def rotated(cases: DataFrame, round_: Column) -> DataFrame:
    """Order of cases (ix from 0) in a round: each round starts one case later."""
    n = F.count("*").over(Window.partitionBy("round"))
    return cases.withColumn("round", round_).withColumn("place", F.pmod(F.col("ix") - F.col("round"), n))


def profile_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same measure of two configurations side by side, with their ratio."""
    a, b = left.select(*keys, F.col(value).alias("before")), right.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys).withColumn("ratio", F.col("before") / F.col("after"))
