"""Command line: python -m joinery.cli INPUT... [options].

Exit status 0, 1 (some object failed), 2 (wrong usage), 130 (interrupted; what was ready is written). In a text file a
line that fails ends the file's results; other files go on.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.kernels.graphs import FormatError, checked
from joinery.plans.distributed import search_graph, search_string
from joinery.plans.options import GraphOptions, OptionError, StringOptions
from joinery.plans.solve import RESULT, assembly_of_graphs, assembly_of_strings
from joinery.sources.files import parse_graphs, read_graph_files, read_strings
from joinery.sources.sinks import OutputError, check_outputs, incumbents, metrics, result_block, result_line


class _Once(argparse.Action):
    def __call__(self, parser, namespace, values, option=None):
        given = namespace.__dict__.setdefault("_given", set())
        if self.dest in given:
            parser.error(f"{option} is given twice")
        given.add(self.dest)
        setattr(namespace, self.dest, values)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="joinery", description="Assembly indices of graph files, or of the lines of text files.")
    add = lambda *a, **k: p.add_argument(*a, action=_Once, **k)
    flag = {"type": int, "choices": (0, 1)}
    p.add_argument("inputs", nargs="+", metavar="INPUT")
    add("--algorithm", choices=("full", "re-pair"), default="full", help="exact search or a Re-Pair upper bound")
    add("--runtime", type=int, metavar="NS", help="CPU nanoseconds per object; 0 gives the first bound")
    add("--enum-max", type=int, metavar="COUNT", help="retained edge sets of a graph")
    add("--pathway", **flag, default=1, help="write pathways or certificates")
    add("--run-strings", "--runStrings", **flag, default=0, help="inputs are text files, a string per line")
    add("--accept-palindromes", "--acceptPalindromes", "--palindrome", **flag, default=0, help="a part equals its reversal")
    add("--remove-hydrogens", **flag, help="drop vertices labelled H (default 1)")
    add("--compensate-disjoint", **flag, default=0, help="leave out joins between components")
    add("--write-intermediate-mas", **flag, default=0, help="write each improvement")
    add("--telemetry", **flag, default=0, help="write counters")
    add("--parallel", choices=("auto", "on", "off"), default="auto", help="on: each object is searched over the cluster, without a pathway; off and auto: one object, one task")
    add("--threads", default="auto", help="number of local threads")
    add("--out", default=None, help="folder for lines, documents, history and metrics")
    return p


def options(args: argparse.Namespace) -> StringOptions | GraphOptions:
    common = {"algorithm": "repair" if args.algorithm == "re-pair" else "exact", "cpu_budget_ns": args.runtime, "with_pathway": bool(args.pathway and args.out), "with_history": bool(args.write_intermediate_mas)}
    if args.run_strings:
        if args.enum_max is not None or args.remove_hydrogens is not None or args.compensate_disjoint:
            raise OptionError("enum-max, remove-hydrogens and compensate-disjoint are for graphs")
        return StringOptions(accept_reversed=bool(args.accept_palindromes), **common)
    if args.accept_palindromes:
        raise OptionError("accept-palindromes is for strings")
    if args.enum_max is not None:
        common["enumeration_limit"] = args.enum_max
    return GraphOptions(remove_hydrogens=args.remove_hydrogens != 0, compensate_disjoint=bool(args.compensate_disjoint), **common)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        chosen = options(args)
        if args.parallel == "on" and (chosen.algorithm == "repair" or args.runtime is not None or args.write_intermediate_mas or args.telemetry or (args.out and args.pathway)):
            raise OptionError("parallel=on goes with neither re-pair, runtime, write-intermediate-mas and telemetry nor a pathway (--pathway=0)")
        if args.out:
            check_outputs(args.inputs, [args.out])
        if args.threads != "auto" and int(args.threads) < 1:
            raise OptionError("threads is auto or at least 1")
    except (OptionError, OutputError, ValueError) as e:
        print(f"joinery: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{'*' if args.threads == 'auto' else args.threads}]").appName("joinery").config("spark.ui.enabled", "false").getOrCreate()
    try:
        results, key = _results(spark, args, chosen)
        return _written(results, key, args)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        print("status: interrupted by user", file=sys.stderr)
        return 130


def _results(spark: SparkSession, args: argparse.Namespace, chosen: StringOptions | GraphOptions) -> tuple[DataFrame, list[str]]:
    if args.run_strings:
        rows, key = read_strings(spark, args.inputs).withColumnRenamed("error", "read_error"), ["source", "line_ix"]
        results = _over_cluster(spark, rows, chosen) if args.parallel == "on" else assembly_of_strings(rows, "text", chosen)
        results = results.withColumn("error", F.coalesce("read_error", "error")).cache()
        ends = results.where("error is not null").groupBy("source").agg(F.min("line_ix").alias("_end"))
        results = results.join(ends, "source", "left").where("_end is null or line_ix <= _end").drop("_end")
        return results.withColumn("name", F.concat("source", F.lit(":"), F.col("line_ix").cast("string"))), key
    rows = parse_graphs(read_graph_files(spark, args.inputs), remove_hydrogens=chosen.remove_hydrogens).withColumnRenamed("error", "read_error")
    results = _over_cluster(spark, rows, chosen) if args.parallel == "on" else assembly_of_graphs(rows, chosen)
    return results.withColumn("error", F.coalesce("read_error", "error")).withColumn("name", F.col("path")), ["path"]


def _over_cluster(spark: SparkSession, rows: DataFrame, chosen: StringOptions | GraphOptions) -> DataFrame:
    """Results of the objects one after the other, each one's first moves explored over all executors."""
    out = []
    for row in rows.toLocalIterator():
        mine = row.asDict(recursive=True)
        found = {"succeeded": False, "runtime_limit_reached": False, "enumeration_limit_reached": False, "upper_bound_only": False}
        if mine["read_error"] is None:
            try:
                if isinstance(chosen, StringOptions):
                    made = search_string(spark, mine["text"], chosen.accept_reversed, mode="distributed")
                    found["trivial_bound"] = len(mine["text"]) - 1
                else:
                    graph = checked(mine["labels"], [(e["src"], e["dst"], e["label"]) for e in mine["edges"]])
                    made = search_graph(spark, graph, chosen.compensate_disjoint, mode="distributed")
                    found["trivial_bound"] = len(graph.edges) - 1
                found |= {"assembly_index": made.index, "succeeded": True, "enumeration_limit_reached": not made.proven}
            except FormatError as e:
                found["error"] = str(e)
        out.append({**{f.name: None for f in RESULT.fields}, **mine, **found})
    return spark.createDataFrame(out, type(RESULT)([*rows.schema.fields, *RESULT.fields]))


def _written(results: DataFrame, key: list[str], args: argparse.Namespace) -> int:
    results = results.cache()
    name, kind = F.col("name"), "string" if args.run_strings else "graph"
    lines = results.orderBy(*key).select((result_block(name, kind) if args.out else result_line(name)).alias("value"))
    if args.out:
        lines.write.mode("errorifexists").text(f"{args.out}/lines")
        if args.pathway:
            results.where("pathway is not null").select("name", "pathway").write.json(f"{args.out}/pathways")
        if args.write_intermediate_mas:
            incumbents(results, "name").write.json(f"{args.out}/history")
        if args.telemetry:
            metrics(results).write.json(f"{args.out}/metrics")
    else:
        for row in lines.toLocalIterator():
            print(row["value"])
    failed = results.where("error is not null").count()
    results.unpersist()
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
