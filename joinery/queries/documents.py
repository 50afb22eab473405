"""Pathways and certificates that the solvers write, counted from the documents; their values are worked out by recursion in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.operators import documents as ops
from joinery.plans.options import GraphOptions, StringOptions
from joinery.plans.solve import assembly_of_graphs, assembly_of_strings
from joinery.queries.bounds import _apart, repair_sql, ring_graphs, ring_sql
from joinery.queries.objects import ORDERS_SQL, distinct_order_strings, path_graphs
from joinery.queries.strings import index_sql


def _strings(spark: SparkSession, sf_dir: str, reverse: bool, algorithm: str) -> DataFrame:
    texts = distinct_order_strings(spark, sf_dir).select("text")
    solved = assembly_of_strings(texts, "text", StringOptions(algorithm=algorithm, accept_reversed=reverse, with_pathway=True))
    told = ops.string_pathway(F.col("pathway"), reverse) if algorithm == "exact" else ops.string_certificate(F.col("pathway"))
    return solved.select("text", *[c.alias(n) for n, c in told.items()])


def _graphs(graphs: DataFrame, key: str, algorithm: str) -> DataFrame:
    solved = assembly_of_graphs(graphs, GraphOptions(algorithm=algorithm, with_pathway=True))
    told = ops.graph_pathway(F.col("pathway")) if algorithm == "exact" else ops.graph_certificate(F.col("pathway"))
    return solved.select(F.col(key).alias("text"), *[c.alias(n) for n, c in told.items()])


def _told(sql: str, value: str, units: str) -> str:
    return f"SELECT text, {value} AS joins, CAST(length(text) AS INTEGER) AS {units}, true AS sound FROM ({sql})"


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of each path beside each other: index, and index without the join between components."""
    rows, n = path_graphs(spark, sf_dir).withColumn("atoms", F.size("labels")), F.col("atoms")
    moved = F.transform("edges", lambda e: F.struct((e["src"] + n).alias("src"), (e["dst"] + n).alias("dst"), e["label"].alias("label")))
    both = rows.select("graph_id", F.concat("labels", "labels").alias("labels"), F.concat("edges", moved).alias("edges"))
    plain = assembly_of_graphs(both, GraphOptions()).select("graph_id", F.col("assembly_index").alias("plain"))
    less = assembly_of_graphs(both, GraphOptions(compensate_disjoint=True)).select("graph_id", F.col("assembly_index").alias("compensated"))
    return plain.join(less, "graph_id").withColumnRenamed("graph_id", "text")


QUERIES = {
    "string_pathway_costs": (lambda s, d: _strings(s, d, False, "exact"), _told(index_sql(ORDERS_SQL, False), "assembly_index", "symbols")),
    "string_pathway_costs_reversed": (lambda s, d: _strings(s, d, True, "exact"), _told(index_sql(ORDERS_SQL, True), "assembly_index", "symbols")),
    "string_certificate_costs": (lambda s, d: _strings(s, d, False, "repair"), _told(_apart(repair_sql(ORDERS_SQL, False)), "upper_bound", "symbols")),
    "graph_pathway_costs": (lambda s, d: _graphs(path_graphs(s, d), "graph_id", "exact"), _told(index_sql(ORDERS_SQL, True), "assembly_index", "edges")),
    "graph_ring_pathway_costs": (lambda s, d: _graphs(ring_graphs(s, d), "text", "exact"), _told(ring_sql(ORDERS_SQL), "assembly_index", "edges")),
    "graph_certificate_costs": (lambda s, d: _graphs(path_graphs(s, d), "graph_id", "repair"), _told(_apart(repair_sql(ORDERS_SQL, True)), "upper_bound", "edges")),
    "graph_copies_compensated": (_copies, f"SELECT text, assembly_index + 1 AS plain, assembly_index AS compensated FROM ({index_sql(ORDERS_SQL, True)})"),
}
