"""Queries on run samples; the samples are read off the events table: a user is a case, values are times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.evaluation import stats
from joinery.plans.options import StringOptions
from joinery.plans.solve import assembly_of_strings
from joinery.queries.objects import ORDERS_SQL, distinct_order_strings
from joinery.queries.strings import _all_true, _checked, index_sql
from joinery.runtime import materialise, table
from joinery.sources import reports

SAMPLES_SQL = """samples AS (SELECT event_type AS suite, CAST(user_id % 12 AS VARCHAR) AS "case", CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS role, CAST((event_id // 2) % 9 AS INTEGER) AS round,
    value + 1 AS wall_seconds, CAST(floor(value * 1000) AS BIGINT) + 1 AS clock_ticks, CAST(pow(2, event_id % 4) AS INTEGER) AS workers FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("suite"),
        (F.col("user_id") % 12).cast("string").alias("case"),
        F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("candidate").alias("role"),
        (F.floor(F.col("event_id") / 2) % 9).cast("int").alias("round"),
        (F.col("value") + 1).alias("wall_seconds"),
        (F.floor(F.col("value") * 1000) + 1).cast("bigint").alias("clock_ticks"),
        F.pow(F.lit(2), F.col("event_id") % 4).cast("int").alias("workers"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _summary(spark, sf_dir):
    return _rounded(stats.summary(samples(spark, sf_dir), ["suite", "case", "role"], "wall_seconds"))


SUMMARY_SQL = f"""
WITH {SAMPLES_SQL}, m AS (SELECT *, quantile_cont(wall_seconds, 0.5) OVER (PARTITION BY suite, "case", role) AS med FROM samples)
SELECT suite, "case", role, count(*) AS n, round(min(wall_seconds), 6) AS minimum, round(any_value(med), 6) AS median, round(avg(wall_seconds), 6) AS mean, round(quantile_cont(abs(wall_seconds - med), 0.5), 6) AS mad, round(quantile_cont(wall_seconds, 0.95), 6) AS p95
FROM m GROUP BY 1, 2, 3
"""


def _totals(spark, sf_dir):
    return _rounded(stats.round_totals(samples(spark, sf_dir), ["suite"], "wall_seconds"))


def _ratios(spark, sf_dir):
    return _rounded(stats.paired_ratios(samples(spark, sf_dir), ["suite", "case"], "clock_ticks"))


def _ratio_sql(keys: str, value: str) -> str:
    return f"SELECT {keys}, round, CAST(sum({value}) FILTER (role = 'baseline') AS DOUBLE) / sum({value}) FILTER (role = 'candidate') AS ratio FROM samples GROUP BY {keys}, round HAVING sum({value}) FILTER (role = 'baseline') IS NOT NULL AND sum({value}) FILTER (role = 'candidate') > 0"


RATIOS_SQL = f"WITH {SAMPLES_SQL} SELECT suite, \"case\", round, round(ratio, 6) AS ratio FROM ({_ratio_sql('suite, \"case\"', 'clock_ticks')})"


def _geomean(spark, sf_dir):
    return _rounded(stats.geometric_mean(stats.paired_ratios(samples(spark, sf_dir), ["suite", "case"], "clock_ticks"), ["suite"], "ratio"))


GEOMEAN_SQL = f"WITH {SAMPLES_SQL} SELECT suite, round(exp(avg(ln(ratio))), 6) AS geomean FROM ({_ratio_sql('suite, \"case\"', 'clock_ticks')}) GROUP BY suite"


def _gate(spark, sf_dir):
    return _rounded(stats.speed_gate(samples(spark, sf_dir)))


GATE_SQL = f"""
WITH {SAMPLES_SQL}, r AS (
    SELECT suite, "case", 'clock' AS measure, ratio FROM ({_ratio_sql('suite, "case"', 'clock_ticks')})
    UNION ALL SELECT suite, NULL, 'clock', ratio FROM ({_ratio_sql('suite', 'clock_ticks')})
    UNION ALL SELECT suite, NULL, 'wall', ratio FROM ({_ratio_sql('suite', 'wall_seconds')}))
SELECT suite, "case", measure, round(quantile_cont(ratio, 0.5), 6) AS median_ratio, quantile_cont(ratio, 0.5) > 1 AS passes FROM r GROUP BY 1, 2, 3
"""


def _scaling(spark, sf_dir):
    return _rounded(stats.scaling(samples(spark, sf_dir), ["suite"], "wall_seconds"))


SCALING_SQL = f"""
WITH {SAMPLES_SQL}, b AS (SELECT suite, workers, quantile_cont(wall_seconds, 0.5) AS median FROM samples GROUP BY 1, 2)
SELECT suite, b.workers, round(b.median, 6) AS median, round(o.median / b.median, 6) AS speedup, round(o.median / b.median / b.workers, 6) AS efficiency, b.workers > 1 AND o.median / b.median <= 1 AS regressed
FROM b JOIN (SELECT suite, median FROM b WHERE workers = 1) o USING (suite)
"""


def _cross(spark, sf_dir):
    by = stats.summary(samples(spark, sf_dir), ["suite", "case", "role"], "wall_seconds")
    return _rounded(stats.cross_report(by, ["suite", "case"], ["baseline", "candidate"]))


CROSS_SQL = f"""WITH {SAMPLES_SQL} SELECT suite, "case", round(quantile_cont(wall_seconds, 0.5) FILTER (role = 'baseline'), 6) AS baseline, round(quantile_cont(wall_seconds, 0.5) FILTER (role = 'candidate'), 6) AS candidate FROM samples GROUP BY 1, 2"""


def _censored(spark, sf_dir):
    runs = samples(spark, sf_dir).select("suite", F.col("wall_seconds").alias("exact_seconds"), (F.lit(1.0) + F.col("round")).alias("bound_seconds"), (F.col("workers") == 8).alias("timed_out"))
    return _rounded(stats.censored_speed(runs, ["suite"]))


CENSORED_SQL = f"""WITH {SAMPLES_SQL} SELECT suite, count(*) AS n, count(*) FILTER (workers = 8) AS timeouts, round(quantile_cont(wall_seconds / (1.0::DOUBLE + round), 0.5) FILTER (workers <> 8), 6) AS median_ratio, round(min(wall_seconds / (1.0::DOUBLE + round)) FILTER (workers = 8), 6) AS least_timeout_ratio FROM samples GROUP BY 1"""


def _rotated(spark, sf_dir):
    cases = samples(spark, sf_dir).select(F.col("case").cast("int").alias("ix"), "round").distinct()
    return stats.rotated(cases, F.col("round")).select("ix", "round", F.col("place").cast("bigint").alias("place"))


ROTATED_SQL = f"""WITH {SAMPLES_SQL}, c AS (SELECT DISTINCT CAST("case" AS INTEGER) AS ix, round FROM samples), n AS (SELECT *, count(*) OVER (PARTITION BY round) AS n FROM c) SELECT ix, round, CAST(((ix - round) % n + n) % n AS BIGINT) AS place FROM n"""


def _profiles(spark, sf_dir):
    by = stats.summary(samples(spark, sf_dir), ["suite", "role"], "wall_seconds")
    return _rounded(stats.profile_join(by.where("role = 'baseline'"), by.where("role = 'candidate'"), ["suite"], "median"))


PROFILES_SQL = f"""WITH {SAMPLES_SQL}, m AS (SELECT suite, quantile_cont(wall_seconds, 0.5) FILTER (role = 'baseline') AS b, quantile_cont(wall_seconds, 0.5) FILTER (role = 'candidate') AS c FROM samples GROUP BY 1) SELECT suite, round(b, 6) AS before, round(c, 6) AS after, round(b / c, 6) AS ratio FROM m"""


def _hits(spark, sf_dir):
    by = samples(spark, sf_dir).groupBy("suite").agg(F.count_if(F.col("role") == "baseline").alias("hits"), F.count_if(F.col("role") == "candidate").alias("misses"))
    return _rounded(by.select("suite", stats.hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate")))


def _quality(spark, sf_dir):
    rows = distinct_order_strings(spark, sf_dir).select("text")
    exact = assembly_of_strings(rows, "text").select("text", F.col("assembly_index").alias("exact"), F.col("trivial_bound").alias("trivial"))
    halves = exact.select(F.length("text").cast("bigint").alias("symbols"), "exact", F.col("trivial").alias("bound"), "trivial")
    return _rounded(stats.bound_quality(halves, ["symbols"]))


QUALITY_SQL = f"""
WITH x AS (SELECT length(text) AS n, assembly_index AS e, length(text) - 1 AS t FROM ({index_sql(ORDERS_SQL, False)}))
SELECT n AS symbols, count(*) AS n, CAST(0 AS BIGINT) AS improved, count(*) AS unchanged, CAST(0 AS BIGINT) AS worse, count(*) FILTER (t = e) AS tight, round(avg(t - e), 6) AS mean_gap, round(quantile_cont(CAST(t - e AS DOUBLE), 0.5), 6) AS median_gap, CAST(max(t - e) AS INTEGER) AS largest_gap FROM x GROUP BY n
"""


def _telemetry(spark, sf_dir):
    """Counters over all distinct order strings."""
    from joinery.sources.sinks import metrics

    solved = assembly_of_strings(distinct_order_strings(spark, sf_dir), "text", StringOptions())
    return metrics(solved).select("objects", "succeeded", "runtime_limited", "enumeration_limited", "bounds_only")


def ablation(text: str) -> dict:
    """Whether the index stays the same with each bound alone and with none; bounds only save work."""
    from joinery.kernels.strings import BOUNDS, solve

    full = solve(text).index
    return {f"same_with_{b}": solve(text, bounds=(b,)).index == full for b in BOUNDS} | {"same_with_none": solve(text, bounds=()).index == full}


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, value: a report for each type of event; its cases are users modulo 12, samples the largest value of a round."""
    rows = samples(spark, sf_dir).groupBy("suite", "case", "role", (F.col("round") + 1).alias("round")).agg(F.max("wall_seconds").alias("wall_seconds"), F.sum("clock_ticks").alias("clock_ticks"))
    return reports.documents(rows.withColumn("workers", F.when(F.col("role") == "baseline", 1).otherwise(4))).select(F.concat(F.lit("plain "), "suite").alias("path"), "value")


def _report_summary(spark, sf_dir):
    """Summaries of what is read back from reports."""
    read = reports.samples(reports.case_roles(reports.parsed(_reports(spark, sf_dir))))
    by = stats.summary(read, ["suite", "case", "role", "workers"], "wall_seconds")
    ticks = read.groupBy("suite", "case", "role").agg(F.sum("clock_ticks").alias("ticks"))
    return _rounded(by.join(ticks, ["suite", "case", "role"]))


_REPORTED = f"""{SAMPLES_SQL}, cells AS (SELECT suite, "case", role, round + 1 AS round, max(wall_seconds) AS wall_seconds, sum(clock_ticks) AS clock_ticks FROM samples GROUP BY ALL),
counted AS (SELECT *, count(*) OVER (PARTITION BY suite, "case", role) AS n, row_number() OVER (PARTITION BY suite, "case", role ORDER BY round) AS place FROM cells),
rated AS (SELECT *, max(n) OVER (PARTITION BY suite) AS runs FROM counted),
good AS (SELECT * FROM rated QUALIFY bool_and(n = runs AND place = round) OVER (PARTITION BY suite, "case"))"""
REPORT_SUMMARY_SQL = f"""
WITH {_REPORTED}, m AS (SELECT *, quantile_cont(wall_seconds, 0.5) OVER (PARTITION BY suite, "case", role) AS med FROM good)
SELECT suite, "case", role, CASE role WHEN 'baseline' THEN 1 ELSE 4 END AS workers, count(*) AS n, round(min(wall_seconds), 6) AS minimum, round(any_value(med), 6) AS median, round(avg(wall_seconds), 6) AS mean, round(quantile_cont(abs(wall_seconds - med), 0.5), 6) AS mad, round(quantile_cont(wall_seconds, 0.95), 6) AS p95, CAST(sum(clock_ticks) AS BIGINT) AS ticks
FROM m GROUP BY suite, "case", role
"""


def _report_errors(spark, sf_dir):
    """Reports with faults beside good ones: all faults are rows, and what is good is counted."""
    plain = _reports(spark, sf_dir)
    value = F.col("value")
    faulty = {
        "array": F.concat(F.lit("["), value, F.lit("]")),
        "cut": F.left(value, F.floor(F.length(value) / 2).cast("int")),
        "version": F.replace(value, F.lit('"schema_version":2,'), F.lit('"schema_version":2.0,')),
        "wall": F.replace(value, F.lit('"wall_seconds":'), F.lit('"wall_seconds":-')),
        "workers": F.replace(value, F.lit('"OMP_NUM_THREADS":"4"'), F.lit('"OMP_NUM_THREADS":"04"')),
    }
    files = plain
    for name, broken in faulty.items():
        files = files.unionByName(plain.select(F.replace("path", F.lit("plain"), F.lit(name)).alias("path"), broken.alias("value")))
    files = materialise(files, "reports")
    read = reports.parsed(files)
    found = reports.errors(read, reports.case_roles(read))
    return found.groupBy("path", "role", "error").agg(F.count("*").alias("n"))


REPORT_ERRORS_SQL = f"""
WITH {_REPORTED}, suites AS (SELECT DISTINCT suite FROM rated), roles AS (SELECT suite, "case", role, bool_and(n = runs) AS all_there, bool_and(place = round) AS in_order FROM rated GROUP BY 1, 2, 3),
own AS (SELECT suite, "case", role, CASE WHEN NOT all_there THEN 'wrong number of samples' WHEN NOT in_order THEN 'invalid round order' END AS error FROM roles),
found AS (
    SELECT v || ' ' || suite AS path, NULL AS role, e AS error, 1 AS n FROM suites, (VALUES ('array', 'no object'), ('cut', 'no JSON document'), ('version', 'schema_version is not 2')) t(v, e)
    UNION ALL SELECT 'plain ' || suite, role, error, 1 FROM own WHERE error IS NOT NULL
    UNION ALL SELECT 'wall ' || suite, role, coalesce(error, 'invalid wall sample'), 1 FROM own
    UNION ALL SELECT 'workers ' || suite, role, CASE WHEN error IS NULL AND role = 'candidate' THEN 'invalid number of workers' ELSE error END, 1 FROM own WHERE error IS NOT NULL OR role = 'candidate')
SELECT path, role, error, CAST(sum(n) AS BIGINT) AS n FROM found GROUP BY 1, 2, 3
"""

QUERIES = {
    "report_summary": (_report_summary, REPORT_SUMMARY_SQL),
    "report_errors": (_report_errors, REPORT_ERRORS_SQL),
    "bound_ablation": (lambda s, d: _checked(s, d, ablation), _all_true(ablation)),
    "samples_summary": (_summary, SUMMARY_SQL),
    "samples_round_totals": (_totals, f"WITH {SAMPLES_SQL} SELECT suite, role, round, round(sum(wall_seconds), 6) AS total FROM samples GROUP BY 1, 2, 3"),
    "samples_paired_ratios": (_ratios, RATIOS_SQL),
    "samples_geomean": (_geomean, GEOMEAN_SQL),
    "samples_gate": (_gate, GATE_SQL),
    "samples_scaling": (_scaling, SCALING_SQL),
    "samples_cross_report": (_cross, CROSS_SQL),
    "samples_censored": (_censored, CENSORED_SQL),
    "samples_rotation": (_rotated, ROTATED_SQL),
    "samples_profiles": (_profiles, PROFILES_SQL),
    "samples_hit_rate": (_hits, f"WITH {SAMPLES_SQL} SELECT suite, round(count(*) FILTER (role = 'baseline') / count(*), 6) AS hit_rate FROM samples GROUP BY 1"),
    "bound_quality": (_quality, QUALITY_SQL),
    "solver_metrics": (_telemetry, f"SELECT count(DISTINCT text) AS objects, count(DISTINCT text) AS succeeded, CAST(0 AS BIGINT) AS runtime_limited, CAST(0 AS BIGINT) AS enumeration_limited, CAST(0 AS BIGINT) AS bounds_only FROM ({ORDERS_SQL})"),
}
