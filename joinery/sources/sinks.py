"""Writers: result lines, documents, incumbent logs, metrics. None overwrites its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class OutputError(ValueError):
    pass


def check_outputs(inputs: list[str], outputs: list[str]) -> None:
    """Refuse outputs that are an input or lie in one; checked before any is opened."""
    norm = lambda p: p.removeprefix("file:").rstrip("/").replace("///", "/")
    seen: set[str] = set()
    for out in map(norm, outputs):
        if out in seen:
            raise OutputError(f"{out} is given twice")
        seen.add(out)
        for given in map(norm, inputs):
            if out == given or out.startswith(f"{given}/") or given.startswith(f"{out}/"):
                raise OutputError(f"output {out} would touch input {given}")


def _head(name: Column) -> Column:
    bound = F.when(F.col("upper_bound_only"), F.lit(" has assembly upper bound: ")).otherwise(F.lit(" has assembly index: "))
    return F.concat(name, bound, F.col("assembly_index").cast("string"))


def result_line(name: Column) -> Column:
    """The text line of a result row; a failed row's line has its error."""
    status = F.when(F.col("upper_bound_only"), " (heuristic upper bound, minimum not proven)")
    status = status.when(F.col("runtime_limit_reached"), " (runtime limit reached, best found)")
    status = status.when(F.col("enumeration_limit_reached"), " (enumeration limit reached, best found)").otherwise("")
    failed = F.concat(name, F.lit(" failed: "), F.coalesce("error", F.lit("no index")))
    return F.when(F.col("error").isNotNull() | F.col("assembly_index").isNull(), failed).otherwise(F.concat(_head(name), status))


def result_block(name: Column, kind: str = "graph") -> Column:
    """The lines of a result row as in an Out file: index or bound, status lines, counts of a bound, CPU time; kind: graph or string."""
    said = lambda label, column: F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))
    bound = F.col("upper_bound_only")
    lines = F.concat_ws(
        "\n",
        _head(name),
        F.when(bound, "status: heuristic upper bound (minimum not proven)"),
        F.when(bound, said("trivial upper bound", "trivial_bound")),
        F.when(bound, said(f"{kind}-repair rules", "rule_count")),
        F.when(bound, said("remaining fragments", "remaining_fragments")),
        F.when(F.col("runtime_limit_reached"), "status: runtime limit reached"),
        F.when(F.col("enumeration_limit_reached"), "status: enumeration limit reached"),
        said("time elapsed", "cpu_ns"),
    )
    return F.when(F.col("error").isNotNull() | F.col("assembly_index").isNull(), result_line(name)).otherwise(lines)


def write_lines(results: DataFrame, name: str, path: str) -> None:
    results.select(result_line(F.col(name)).alias("value")).write.mode("errorifexists").text(path)


def write_documents(results: DataFrame, path: str, column: str = "pathway") -> None:
    """JSON documents (pathways, certificates), one per line."""
    results.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def incumbents(results: DataFrame, key: str) -> DataFrame:
    """key, step, cpu_ns, index: every improvement of each object's index, in order."""
    return results.select(key, F.posexplode("history").alias("step", "h")).select(key, "step", "h.cpu_ns", "h.index")


def counters() -> dict[str, Column]:
    """What metrics() and Phases count."""
    return {
        "objects": F.count("*"),
        "succeeded": F.count_if("succeeded"),
        "runtime_limited": F.count_if("runtime_limit_reached"),
        "enumeration_limited": F.count_if("enumeration_limit_reached"),
        "bounds_only": F.count_if("upper_bound_only"),
        "states": F.sum("states"),
        "most_states": F.max("states"),
        "cpu_ns": F.sum("cpu_ns"),
    }


def metrics(results: DataFrame) -> DataFrame:
    """Counters over all objects: how many, proven, limited, failed, states, CPU."""
    return results.agg(*[c.alias(n) for n, c in counters().items()])


class Phases:
    """Counters of phases taken while they run: each phase's rows are observed on their way to its own sink, so nothing runs twice.

        phases = Phases()
        phases.watch(results, "search").write.parquet(path)
        phases.rows(spark)
    """

    def __init__(self) -> None:
        self.observed: dict[str, Observation] = {}

    def watch(self, results: DataFrame, phase: str, aggregates: dict[str, Column] | None = None) -> DataFrame:
        """results, observed: the metrics() of result rows, or the given aggregates of any other rows."""
        if phase in self.observed:
            raise OutputError(f"phase {phase} is given twice")
        self.observed[phase] = Observation(phase)
        return results.observe(self.observed[phase], *[c.alias(n) for n, c in (aggregates or counters()).items()])

    def rows(self, spark: SparkSession) -> DataFrame:
        """phase, counter, value of phases whose rows were written; waits for those that still run."""
        found = [(phase, name, None if value is None else int(value)) for phase, seen in self.observed.items() for name, value in seen.get.items()]
        return spark.createDataFrame(found, "phase string, counter string, value long")


def peak_memory_kb() -> int:
    """Peak resident memory of this process."""
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
