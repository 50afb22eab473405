"""Assembly indices of the rows of a DataFrame.

Equal objects are solved once: distinct inputs are dealt out by estimated cost, large ones first and finely, solved in
Arrow batches, and joined back. Each result row has a status; an object that fails has an error and does not stop the
others.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinery.kernels import graph_repair, graph_search, repair_bounds, string_repair, strings
from joinery.kernels.graphs import FormatError, Graph, checked, parse
from joinery.kernels.outcome import Outcome
from joinery.plans.options import GraphOptions, StringOptions
from joinery.runtime import ship

_INT, _LONG, _BOOL, _TEXT = T.IntegerType(), T.LongType(), T.BooleanType(), T.StringType()
RESULT = T.StructType(
    [
        T.StructField("assembly_index", _INT),
        T.StructField("trivial_bound", _INT),
        T.StructField("cpu_ns", _LONG),
        T.StructField("succeeded", _BOOL),
        T.StructField("runtime_limit_reached", _BOOL),
        T.StructField("enumeration_limit_reached", _BOOL),
        T.StructField("upper_bound_only", _BOOL),
        T.StructField("rule_count", _INT),
        T.StructField("remaining_fragments", _INT),
        T.StructField("states", _LONG),
        T.StructField("error", _TEXT),
        T.StructField("pathway", _TEXT),
        T.StructField("history", T.ArrayType(T.StructType([T.StructField("cpu_ns", _LONG), T.StructField("index", _INT)]))),
    ]
)
#: Column with the digest of an object.
_KEY = "__object"
#: Rows whose estimated cost is alike share a task; there are so many tasks per shuffle partition.
TASKS_PER_PARTITION = 4


def _row(outcome: Outcome | None = None, error: str | None = None, **more) -> dict:
    o = outcome or Outcome()
    row = {
        "assembly_index": o.index if error is None else None,
        "trivial_bound": None,
        "cpu_ns": None,
        "succeeded": error is None,
        "runtime_limit_reached": o.runtime_limit_reached,
        "enumeration_limit_reached": o.enumeration_limit_reached,
        "upper_bound_only": o.upper_bound_only,
        "rule_count": None,
        "remaining_fragments": None,
        "states": o.states,
        "error": error,
        "pathway": None,
        "history": [{"cpu_ns": t, "index": i} for t, i in o.history],
    }
    return row | more


def solve_string(text: str | None, options: StringOptions) -> dict:
    """Result row of one string."""
    if text is None:
        return _row(error="no string")
    began = time.process_time_ns()
    if options.algorithm == "repair":
        grammar = string_repair.repair(text, options.accept_reversed)
        more = {"rule_count": len(grammar.rules), "remaining_fragments": len(grammar.residual), "trivial_bound": grammar.trivial}
        out = Outcome(index=grammar.bound, upper_bound_only=True)
        document = grammar.certificate() if options.with_pathway else None
    else:
        out = strings.solve(text, options.accept_reversed, options.cpu_budget_ns, options.target_index)
        more = {"trivial_bound": len(text) - 1}
        document = strings.pathway(text, out.steps) if options.with_pathway else None
    if not options.with_history:
        out.history = []
    return _row(out, cpu_ns=time.process_time_ns() - began, pathway=json.dumps(document) if document else None, **more)


def solve_strings(texts: list[str | None], options: StringOptions) -> list[dict]:
    """Result rows of strings. Re-Pair bounds without certificates are worked out side by side; a row's CPU time is its share by length."""
    if options.algorithm != "repair" or options.with_pathway:
        return [solve_string(t, options) for t in texts]
    out, there = [_row(error="no string") if t is None else None for t in texts], [i for i, t in enumerate(texts) if t is not None]
    for block in repair_bounds.blocks([len(texts[i]) for i in there]):
        some = [texts[i] for i in there[block]]
        began = time.process_time_ns()
        found = repair_bounds.counted(some, options.accept_reversed) if repair_bounds.alike(some) else [None] * len(some)
        each = (time.process_time_ns() - began) / max(1, sum(map(len, some)))
        for i, text, bound in zip(there[block], some, found, strict=True):
            if bound is None:
                out[i] = solve_string(text, options)
                continue
            rules, fragments = bound
            outcome = Outcome(index=rules + fragments - 1, upper_bound_only=True)
            out[i] = _row(outcome, cpu_ns=int(each * len(text)), rule_count=rules, remaining_fragments=fragments, trivial_bound=len(text) - 1)
    return out


def solve_graph(graph: Graph, options: GraphOptions) -> dict:
    """Result row of one graph, hydrogens still in it."""
    began = time.process_time_ns()
    graph = graph_search.prepared(graph, options.remove_hydrogens)
    if options.algorithm == "repair":
        grammar = graph_repair.repair(graph, options.compensate_disjoint)
        more = {"rule_count": len(grammar.rules), "remaining_fragments": len(grammar.residual), "trivial_bound": grammar.trivial}
        out = Outcome(index=grammar.bound, upper_bound_only=True)
        document = grammar.certificate() if options.with_pathway else None
    else:
        out = graph_search.solve(graph, options.compensate_disjoint, options.cpu_budget_ns, options.enumeration_limit, want_steps=options.with_pathway)
        more = {"trivial_bound": len(graph.edges) - 1}
        document = graph_search.pathway(graph, out.steps) if options.with_pathway else None
    if not options.with_history:
        out.history = []
    return _row(out, cpu_ns=time.process_time_ns() - began, pathway=json.dumps(document) if document else None, **more)


def calculate_string(text: str, options: StringOptions = StringOptions()) -> dict:
    return solve_string(text, options)


def calculate_content(content: bytes | str, path: str = "", options: GraphOptions = GraphOptions()) -> dict:
    """Result row of one graph file's content; the path's suffix selects the format."""
    try:
        return solve_graph(parse(content, path), options)
    except FormatError as e:
        return _row(error=str(e))


def _mapped(solve: Callable[[list[dict]], list[dict]], keep: list[str]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = solve(batch.to_dict("records"))
            solved = pd.DataFrame(rows, columns=[f.name for f in RESULT.fields], index=batch.index)
            for column in ("assembly_index", "trivial_bound", "cpu_ns", "rule_count", "remaining_fragments"):
                solved[column] = solved[column].astype("Int64")
            yield pd.concat([batch[keep], solved], axis=1)

    return run


def _dealt_alike(each: DataFrame, size: Column, symbols: dict[int, int]) -> DataFrame:
    """Texts over tasks of about one block of symbols each, those of one class of lengths together: a step of a block costs much the same
    for a few texts as for many, and its longest one has the most. symbols: how many each class has, at least."""
    cores = each.sparkSession.sparkContext.defaultParallelism
    share = max(1, min(repair_bounds.SYMBOLS, sum(symbols.values()) // (2 * cores)))
    first, tasks, total = {}, {}, 0
    for c in sorted(symbols, reverse=True):
        first[c], tasks[c] = total, max(1, -(-symbols[c] // share))
        total += tasks[c]
    if not total:
        return each
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), _length_class(size))
    return each.repartitionById(total, (of(first) + F.pmod(F.xxhash64(_KEY), of(tasks))).cast("int"))


def _length_class(size: Column) -> Column:
    """Lengths up to 4,095 are one class, each further class is twice as wide."""
    return F.floor(F.log2(F.greatest(F.coalesce(size, F.lit(0)), F.lit(2048)))).cast("int")


def _once(df: DataFrame, key: Column, columns: list[Column], cost: Column, solve: Callable[[list[dict]], list[dict]], alike: bool = False) -> DataFrame:
    """df with the columns of RESULT: each object solved once, wherever it occurs; `alike` ones are dealt by _dealt_alike().

    Objects are known by a digest; neither the solved rows nor the join carry the objects themselves. They are dealt
    over many tasks, so that one hard object holds up few others.
    """
    spark: SparkSession = df.sparkSession
    ship(spark)
    tasks = TASKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(_KEY, key)
    each = keyed.where(F.col(_KEY).isNotNull()).select(_KEY, *columns).dropDuplicates([_KEY])
    if alike:
        sizes = df.select(*columns).groupBy(_length_class(cost).alias("c")).agg(F.sum(cost).alias("n")).collect()
        dealt = _dealt_alike(each, cost, {r["c"]: r["n"] or 0 for r in sizes})
    else:
        dealt = each.repartition(tasks, _KEY)
    solved = dealt.sortWithinPartitions(cost.desc()).mapInPandas(_mapped(solve, [_KEY]), T.StructType([T.StructField(_KEY, T.StringType()), *RESULT.fields]))
    return keyed.join(solved, _KEY, "left").select(*[keyed[c] for c in df.columns], *[solved[f.name] for f in RESULT.fields])


def assembly_of_strings(df: DataFrame, column: str, options: StringOptions = StringOptions()) -> DataFrame:
    """df with the columns of RESULT for its string column."""
    text = F.col(column)
    key = F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null"))
    return _once(df, key, [text.alias("_text")], F.length("_text"), lambda rows: solve_strings([r["_text"] for r in rows], options), options.algorithm == "repair" and not options.with_pathway)


def _solve_row(row: dict, options: GraphOptions) -> dict:
    try:
        graph = checked(list(row["_labels"]), [(e["src"], e["dst"], e["label"]) for e in row["_edges"]])
    except FormatError as e:
        return _row(error=str(e))
    return solve_graph(graph, options)


def assembly_of_graphs(df: DataFrame, options: GraphOptions = GraphOptions(), labels: str = "labels", edges: str = "edges") -> DataFrame:
    """df with the columns of RESULT for its graphs (labels array<string>, edges array<struct<src,dst,label>>)."""
    both = F.col(labels).isNotNull() & F.col(edges).isNotNull()
    key = F.when(both, F.sha2(F.to_json(F.struct(F.col(labels).alias("a"), F.col(edges).alias("b"))).cast("binary"), 256))
    return _once(df, key, [F.col(labels).alias("_labels"), F.col(edges).alias("_edges")], F.size("_edges"), lambda rows: [_solve_row(r, options) for r in rows])


def register(spark: SparkSession) -> None:
    """SQL functions: string_assembly(text, accept_reversed), string_repair(text, accept_reversed), graph_assembly(content, path), and table functions for pathways and rules."""
    ship(spark)
    kind = T.StructType([f for f in RESULT.fields if f.name not in ("history",)])

    def of(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows)[[f.name for f in kind.fields]]

    @F.pandas_udf(kind)
    def string_assembly(text: pd.Series, accept_reversed: pd.Series) -> pd.DataFrame:
        return of([solve_string(t, StringOptions(accept_reversed=bool(r))) for t, r in zip(text, accept_reversed, strict=True)])

    @F.pandas_udf(kind)
    def string_repair_(text: pd.Series, accept_reversed: pd.Series) -> pd.DataFrame:
        return of([solve_string(t, StringOptions(algorithm="repair", accept_reversed=bool(r))) for t, r in zip(text, accept_reversed, strict=True)])

    @F.pandas_udf(kind)
    def graph_assembly(content: pd.Series, path: pd.Series) -> pd.DataFrame:
        return of([calculate_content(c, p or "") for c, p in zip(content, path, strict=True)])

    @F.udtf(returnType="step int, kept_offset int, copy_offset int, length int")
    class PathwaySteps:
        def eval(self, text: str, accept_reversed: bool):
            for i, ((a, n), (b, _)) in enumerate(strings.solve(text or "", accept_reversed).steps):
                yield i, a, b, n

    @F.udtf(returnType="id int, left_id int, right_id int, left_reversed boolean, right_reversed boolean, length int")
    class RepairRules:
        def eval(self, text: str, accept_reversed: bool):
            for r in string_repair.repair(text or "", accept_reversed).rules:
                yield r.id, r.left, r.right, r.left_reversed, r.right_reversed, r.length

    spark.udf.register("string_assembly", string_assembly)
    spark.udf.register("string_repair", string_repair_)
    spark.udf.register("graph_assembly", graph_assembly)
    spark.udtf.register("pathway_steps", PathwaySteps)
    spark.udtf.register("repair_rules", RepairRules)
