"""Reports of timed runs: nested JSON files to typed samples, with error rows beside good ones; no Python in the plans.

A report is one JSON object: schema_version, suite, runs, how each role was started, and cases with each role's measurements in
round order. What cannot be read becomes an error row that names the report, case and role; all else goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the report format.
VERSION = 2
ROLES = ("baseline", "candidate")
SUITE_NAME = "__suite__"
RANK_FLAG = r"^(-n|-np|--n|--np|--ntasks)$"
RANK_JOINED = r"^-(?:n|np)([0-9]+)$|^--(?:n|np|ntasks)=([0-9]+)$"
_STARTED = "struct<launcher: array<string>, arguments: array<string>, environment: map<string, string>>"
_MEASURED = "struct<measurements: array<struct<round: bigint, wall_seconds: double, clock_ticks: bigint, assembly_index: bigint>>>"
REPORT = f"schema_version bigint, suite string, runs bigint, execution struct<{', '.join(f'{r}: {_STARTED}' for r in ROLES)}>, cases array<string>"
CASE = f"name string, input string, expected_assembly_index bigint, expectation string, workload string, {', '.join(f'{r} {_MEASURED}' for r in ROLES)}, _corrupt_record string"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """path, value: whole report files; Spark's readers give no row for a file of no bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("value"))


def _first(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds; null if none does."""
    out = F.when(F.coalesce(checks[0][0], F.lit(True)), checks[0][1])
    for wrong, name in checks[1:]:
        out = out.when(F.coalesce(wrong, F.lit(True)), name)
    return out


def _positive(text: Column) -> Column:
    return F.when(text.rlike(r"^[1-9][0-9]{0,8}\z"), text.try_cast("bigint"))


def workers(started: Column) -> Column:
    """Threads of the environment (at most its limit) times the ranks of the launcher; null if either is given and not a positive number, or ranks twice."""
    environment, launcher = started["environment"], F.coalesce(started["launcher"], F.array().cast("array<string>"))
    threads, limit = environment["OMP_NUM_THREADS"], environment["OMP_THREAD_LIMIT"]
    threads = F.when(threads.isNull(), F.lit(1).cast("bigint")).otherwise(_positive(threads))
    threads = F.when(limit.isNull(), threads).otherwise(F.when(_positive(limit).isNotNull() & threads.isNotNull(), F.least(threads, _positive(limit))))
    joined = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, RANK_JOINED, 1), F.lit("")), F.nullif(F.regexp_extract(x, RANK_JOINED, 2), F.lit("")))
    asked = F.transform(launcher, lambda x, i: F.when(x.rlike(RANK_FLAG), F.coalesce(F.get(launcher, i + 1), F.lit(""))).otherwise(joined(x)))
    asked = F.filter(asked, lambda x: x.isNotNull())
    ranks = F.when(F.size(asked) == 0, F.lit(1).cast("bigint")).when(F.size(asked) == 1, _positive(F.get(asked, F.lit(0))))
    return threads * ranks


def parsed(files: DataFrame) -> DataFrame:
    """path, report, error of files (path, value); report is null where error is not."""
    document = F.try_parse_json("value")
    kind = F.schema_of_variant(document)
    report = F.from_json("value", REPORT, {"mode": "PERMISSIVE"})
    rows = files.select("path", kind.alias("kind"), report.alias("report"))
    r = F.col("report")
    error = _first(
        (F.col("kind").isNull(), "no JSON document"),
        (~F.startswith("kind", F.lit("OBJECT")), "no object"),
        (r["schema_version"] != VERSION, f"schema_version is not {VERSION}"),
        (r["suite"] == "", "no suite"),
        (r["runs"] < 1, "invalid number of runs"),
        (F.size(r["cases"]) < 1, "no cases"),
    )
    return rows.select("path", error.alias("error"), r.alias("_r")).select("path", F.when(F.col("error").isNull(), F.col("_r")).alias("report"), "error")


def case_roles(reports: DataFrame) -> DataFrame:
    """path, suite, runs, case, role, expected, workers, measurements, error: a row for each role of each case of good reports.

    A case without baseline has a row for the candidate only. Cases of one name in a report are all in error.
    """
    good = reports.where("error IS NULL").select("path", "report.suite", "report.runs", "report.execution", F.posexplode("report.cases").alias("at", "text"))
    case = good.withColumn("c", F.from_json("text", CASE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    named = case.groupBy("path", F.col("c.name").alias("name")).agg(F.count("*").alias("same"))
    case = case.withColumn("name", F.col("c.name")).join(named, ["path", "name"], "left")
    role = lambda r: F.struct(F.lit(r).alias("role"), F.col(f"c.{r}.measurements").alias("m"), workers(F.col(f"execution.{r}")).alias("workers"), F.col(f"execution.{r}").isNull().alias("direct"))
    there = F.get_json_object("text", "$.baseline").isNotNull()
    each = F.explode(F.when(there, F.array(*map(role, ROLES))).otherwise(F.array(role(ROLES[1]))))
    row = case.withColumn("x", each)
    m, wall, ticks = F.col("x.m"), lambda s: s["wall_seconds"], lambda s: s["clock_ticks"]
    every = lambda test: F.forall(m, lambda s: F.coalesce(test(s), F.lit(False)))
    error = _first(
        (F.trim("name") == "", "no case name"),
        ((F.col("same") > 1) | (F.col("name") == SUITE_NAME), "duplicate or reserved case name"),
        (F.col("c.expected_assembly_index").isNull(), "invalid expected index"),
        (m.isNull(), "no measurements"),
        (F.size(m) != F.col("runs"), "wrong number of samples"),
        (~F.forall(F.arrays_zip(m["round"].alias("r"), F.sequence(F.lit(1).cast("bigint"), F.greatest(F.size(m), F.lit(1)).cast("bigint")).alias("i")), lambda p: F.coalesce(p["r"] == p["i"], F.lit(False))), "invalid round order"),
        (~every(lambda s: ~F.isnan(wall(s)) & (wall(s) > 0) & (wall(s) < float("inf"))), "invalid wall sample"),
        (~every(lambda s: ticks(s) >= 0), "invalid clock sample"),
        (~every(lambda s: s["assembly_index"] == F.col("c.expected_assembly_index")), "unexpected index"),
        (F.col("x.workers").isNull() & ~F.col("x.direct"), "invalid number of workers"),
    )
    count = F.when(F.col("x.direct"), F.lit(1).cast("bigint")).otherwise(F.col("x.workers"))
    return row.select("path", "suite", "runs", F.col("name").alias("case"), "x.role", F.col("c.expected_assembly_index").alias("expected"), count.alias("workers"), m.alias("measurements"), error.alias("error"))


def samples(cases: DataFrame) -> DataFrame:
    """path, suite, case, role, round, wall_seconds, clock_ticks, workers: the samples of good rows, as the evaluation takes them.

    A paired case in which one role is in error has none, since rounds are compared in pairs.
    """
    broken = cases.where("error IS NOT NULL").select("path", "case").distinct()
    good = cases.where("error IS NULL").join(broken, ["path", "case"], "left_anti")
    return good.select("path", "suite", "case", "role", F.explode("measurements").alias("s"), "workers").select("path", "suite", "case", "role", F.col("s.round").cast("int").alias("round"), "s.wall_seconds", "s.clock_ticks", F.col("workers").cast("int").alias("workers"))


def errors(reports: DataFrame, cases: DataFrame) -> DataFrame:
    """path, case, role, error of all that cannot be read; case and role are null for whole reports."""
    whole = reports.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("case"), F.lit(None).cast("string").alias("role"), "error")
    return whole.unionByName(cases.where("error IS NOT NULL").select("path", "case", "role", "error"))


def documents(rows: DataFrame) -> DataFrame:
    """suite, value: samples (suite, case, role, round, wall_seconds, clock_ticks, workers) as one report a suite, each case's index 0.

    The reverse of samples(); a report is one JSON object, so a suite's samples meet in one row.
    """
    one = F.struct("round", "wall_seconds", "clock_ticks", F.lit(0).alias("assembly_index"))
    by_role = rows.groupBy("suite", "case", "role").agg(F.struct(F.array_sort(F.collect_list(one)).alias("measurements")).alias("m"), F.max("workers").alias("workers"))
    at = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    case = by_role.groupBy("suite", "case").agg(*[at(r, "m").alias(r) for r in ROLES], *[at(r, "workers").alias(f"{r}_workers") for r in ROLES], F.max(F.size("m.measurements")).alias("runs"))
    fields = F.struct(F.col("case").alias("name"), F.lit(0).alias("expected_assembly_index"), F.lit("reviewed").alias("expectation"), *ROLES)
    started = lambda r: F.struct(F.array().cast("array<string>").alias("launcher"), F.create_map(F.lit("OMP_NUM_THREADS"), F.max(f"{r}_workers").cast("string")).alias("environment")).alias(r)
    made = case.groupBy("suite").agg(F.max("runs").alias("runs"), F.struct(*map(started, ROLES)).alias("execution"), F.array_sort(F.collect_list(fields)).alias("cases"))
    return made.select("suite", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "suite", "runs", "execution", "cases"), {"ignoreNullFields": "true"}).alias("value"))
