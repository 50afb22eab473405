"""Tab-separated manifests and JSON reports of evaluation runs, with checks that name the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGRESSION = "molecule string, expected_assembly_index string"
PATHWAYS = "molecule string, expected_pathway string"
CASES = "name string, input string, expected_assembly_index string, expectation string, suites string, workload string"
WEIGHTS = "case string, repetitions string"
#: Fixed values of the case manifest.
SUITES = ("quick", "full", "profile", "scaling")
EXPECTATIONS = ("reviewed", "provisional")
CASE_NAME = "^[A-Za-z0-9][A-Za-z0-9_.-]*$"
SAMPLES = "suite string, case string, role string, round int, wall_seconds double, clock_ticks bigint, workers int"


class ManifestError(ValueError):
    pass


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest whose header must be the schema's names in order."""
    rows = spark.read.csv(path, sep="\t", schema=schema, header=True, enforceSchema=False, quote="")
    return rows


def _none(rows: DataFrame, what: str) -> None:
    bad = rows.take(3)
    if bad:
        raise ManifestError(f"{what}: {', '.join(str(tuple(r)) for r in bad)}")


def check_regression(rows: DataFrame) -> DataFrame:
    """molecule, expected_assembly_index int; no empty or repeated names, only integers."""
    _none(rows.where("molecule is null or trim(molecule) = ''"), "row without a name")
    _none(rows.groupBy("molecule").count().where("count > 1"), "repeated molecule")
    _none(rows.where("not coalesce(expected_assembly_index rlike '^-?[0-9]+$', false)"), "not an integer")
    return rows.select("molecule", F.col("expected_assembly_index").cast("int").alias("expected_assembly_index"))


def check_pathways(rows: DataFrame, regression: DataFrame) -> DataFrame:
    """Pathway rows, each of a molecule of the regression manifest."""
    _none(rows.groupBy("molecule").count().where("count > 1"), "repeated molecule")
    _none(rows.join(regression, "molecule", "left_anti"), "pathway of an unknown molecule")
    return rows


def check_cases(rows: DataFrame, expectations: tuple[str, ...] = ()) -> DataFrame:
    """One row per case and suite: name, input, expected int, expectation, suite, workload.

    expectations: the values allowed there, EXPECTATIONS for the case manifest; any if none are given.
    """
    _none(rows.groupBy("name").count().where("count > 1"), "repeated case")
    _none(rows.where(~F.coalesce(F.col("name").rlike(CASE_NAME), F.lit(False))), "malformed name")
    _none(rows.where("name is null or input is null or suites is null or workload is null or trim(workload) = ''"), "malformed case")
    if expectations:
        _none(rows.where(~F.coalesce(F.col("expectation").isin(*expectations), F.lit(False))), "unknown expectation")
    _none(rows.where("not coalesce(expected_assembly_index rlike '^-?[0-9]+$', false)"), "not an integer")
    out = rows.select("name", "input", F.col("expected_assembly_index").cast("int").alias("expected"), "expectation", F.explode(F.split("suites", ",")).alias("suite"), "workload")
    _none(out.where(~F.col("suite").isin(*SUITES)), "unknown suite")
    _none(out.groupBy("name", "suite").count().where("count > 1"), "suite given twice")
    return out


def check_weights(rows: DataFrame) -> DataFrame:
    _none(rows.where("not coalesce(repetitions rlike '^[1-9][0-9]*$', false)"), "repetitions must be positive")
    return rows.select("case", F.col("repetitions").cast("int").alias("repetitions"))


def unreferenced(fixtures: DataFrame, referenced: DataFrame) -> DataFrame:
    """Fixture names that no manifest row names."""
    return fixtures.select("molecule").exceptAll(referenced.select("molecule").distinct())


def content_audit(files: DataFrame) -> DataFrame:
    """digest, n, names, conflicting: files (name, content, expected) of equal content; conflicting if they expect different values."""
    groups = files.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"), (F.countDistinct("expected") > 1).alias("conflicting"))
    return groups.where("n > 1")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of JSON reports, one object per line, by an explicit schema; malformed lines are an error."""
    return spark.read.schema(SAMPLES).option("mode", "FAILFAST").json(path)
