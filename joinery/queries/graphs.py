"""Queries on graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.kernels import graph_repair, graph_search
from joinery.kernels.canon import Canonizer
from joinery.kernels.graphs import Graph
from joinery.operators import colours, graphs as ops
from joinery.operators.frontier import assembly_frontier
from joinery.plans.options import GraphOptions
from joinery.plans.solve import assembly_of_graphs
from joinery.queries.objects import DISTINCT_SQL, GRAPH_SQL, ORDERS_SQL, distinct_order_strings, order_graphs, path_graphs
from joinery.queries.strings import index_sql
from joinery.runtime import scratch_dir, ship, until_exit
from joinery.sources import molgraph
from joinery.sources.files import parse_graphs


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of edge-labelled paths, from the frontier of their strings' states."""
    strings = ops.path_strings(path_graphs(spark, sf_dir)).select(F.col("graph_id").alias("id"), "text")
    return assembly_frontier(strings, accept_reversed=True).select(F.col("id").alias("text"), "assembly_index")


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of stars with equal leaves: the shortest addition chain."""
    sizes = distinct_order_strings(spark, sf_dir).select(F.length("text").alias("n")).distinct()
    graphs = sizes.select("n", F.array_repeat(F.lit("C"), F.col("n") + 1).alias("labels"), F.transform(F.sequence(F.lit(1), "n"), lambda i: F.struct(F.lit(0).alias("src"), i.alias("dst"), F.lit(1).alias("label"))).alias("edges"))
    return assembly_of_graphs(graphs).select("n", "assembly_index")


STARS_SQL = f"""
WITH RECURSIVE sizes AS (SELECT DISTINCT CAST(length(text) AS INTEGER) AS n FROM ({DISTINCT_SQL})), top AS (SELECT max(n) AS m FROM sizes),
chains(c) AS (SELECT [CAST(1 AS BIGINT)] UNION SELECT c || [x + y] FROM (SELECT c, unnest(c) AS x FROM chains), unnest(c) t(y), top WHERE x + y > c[-1] AND x + y <= m AND len(c) < 7)
SELECT n, CAST(min(len(c) - 1) AS INTEGER) AS assembly_index FROM sizes JOIN chains ON c[-1] = n GROUP BY n
"""


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths written in the five-line format and read back."""
    rows = distinct_order_strings(spark, sf_dir)
    n = F.length("text")
    at = F.sequence(F.lit(1), n)
    lines = [
        F.col("text"),
        (n + 1).cast("string"),
        F.array_join(F.transform(at, lambda i: F.concat(i.cast("string"), F.lit(" "), (i + 1).cast("string"))), " "),
        F.array_join(F.array_repeat(F.lit("C"), n + 1), " "),
        F.array_join(F.transform(F.split("text", ""), lambda c: F.instr(F.lit("ANR"), c).cast("string")), " "),
    ]
    files = rows.select("text", F.concat_ws("\n", *lines).cast("binary").alias("content"), F.lit("x.graph").alias("path"))
    return _shape(parse_graphs(files))


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths written and read back by the data source."""
    molgraph.register(spark)
    folder = f"{scratch_dir(spark)}/joinery/graphs-{uuid.uuid4().hex}"
    path_graphs(spark, sf_dir).select(F.col("graph_id").alias("name"), "labels", "edges").write.format("molgraph").mode("append").save(folder)
    until_exit(spark, folder)
    read = spark.read.format("molgraph").option("removeHydrogens", "false").load(folder)
    return _shape(read.withColumn("text", F.regexp_extract("path", r"([^/]*)\.graph$", 1)))


def _molfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths as V2000 molfiles."""
    rows = distinct_order_strings(spark, sf_dir)
    n = F.length("text")
    three = lambda c: F.lpad(c.cast("string"), 3, " ")
    counts = F.concat(three(n + 1), three(n), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    atoms = F.transform(F.sequence(F.lit(0), n), lambda i: F.lit("    0.0000    0.0000    0.0000 C   0  0"))
    bonds = F.transform(F.split("text", ""), lambda c, i: F.concat(three(i + 1), three(i + 2), three(F.instr(F.lit("ANR"), c)), F.lit("  0")))
    content = F.concat_ws("\n", F.col("text"), F.lit(""), F.lit(""), counts, F.array_join(atoms, "\n"), F.array_join(bonds, "\n"), F.lit("M  END"))
    return _shape(parse_graphs(rows.select("text", content.cast("binary").alias("content"), F.lit("x.MOL").alias("path"))))


def _shape(parsed: DataFrame) -> DataFrame:
    return parsed.select("text", F.size("labels").cast("bigint").alias("atoms"), F.size("edges").cast("bigint").alias("bonds"), F.aggregate("edges", F.lit(0).cast("bigint"), lambda a, e: a + e["label"] * (e["src"] + 1) + e["dst"]).alias("weight"), F.col("error").isNotNull().alias("failed"))


SHAPE_SQL = f"""SELECT text, length(text) + 1 AS atoms, length(text) AS bonds,
CAST(list_sum(list_transform(range(1, length(text) + 1), lambda i: instr('ANR', substr(text, i, 1)) * i + i)) AS BIGINT) AS weight, false AS failed FROM ({DISTINCT_SQL})"""


def _rows(spark, sf_dir) -> DataFrame:
    return ops.stripped(order_graphs(spark, sf_dir))


def _stripped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return ops.exploded(_rows(spark, sf_dir))


_STRIPPED = f"""{GRAPH_SQL}, kept AS (SELECT graph_id, atom_ix AS old, row_number() OVER (PARTITION BY graph_id ORDER BY atom_ix) - 1 AS atom_ix, label FROM atoms WHERE label <> 'H'),
kb AS (SELECT b.graph_id, row_number() OVER (PARTITION BY b.graph_id ORDER BY b.edge_ix) - 1 AS edge_ix, s.atom_ix AS src, d.atom_ix AS dst, b.label, s.label AS la, d.label AS lb
    FROM bonds b JOIN kept s ON s.graph_id = b.graph_id AND s.old = b.src JOIN kept d ON d.graph_id = b.graph_id AND d.old = b.dst WHERE b.label <> 0)"""


def _bond_rows(spark, sf_dir):
    _, bonds = _stripped(spark, sf_dir)
    return bonds.select("graph_id", *[F.col(c).cast("bigint").alias(c) for c in ("edge_ix", "src", "dst", "label")])


def _edge_rows(spark, sf_dir):
    return ops.edge_list_in_rows(_rows(spark, sf_dir)).select("graph_id", *[F.col(c).cast("bigint").alias(c) for c in ("edge_ix", "src", "dst", "label")])


EDGES_SQL = f"WITH {_STRIPPED} SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY src, edge_ix) - 1 AS edge_ix, src, dst, label FROM kb"


def _named(classed: DataFrame) -> DataFrame:
    return classed.select("graph_id", F.concat_ws("-", "bond_class.a", "bond_class.b", F.col("bond_class.label").cast("string")).alias("bond_class"), *[c for c in classed.columns if c not in ("graph_id", "bond_class")])


def _classed(spark, sf_dir):
    return ops.exploded_with_class(_rows(spark, sf_dir))


def _class_counts(spark, sf_dir):
    return _named(ops.class_counts(_classed(spark, sf_dir))).select("graph_id", "bond_class", "n", F.col("first_edge").cast("bigint").alias("first_edge"))


_CLASS = "least(la, lb) || '-' || greatest(la, lb) || '-' || CAST(label AS VARCHAR)"
CLASS_SQL = f"WITH {_STRIPPED} SELECT graph_id, {_CLASS} AS bond_class, count(*) AS n, min(edge_ix) AS first_edge FROM kb GROUP BY 1, 2"


def _repeated(spark, sf_dir):
    return ops.repeated_in_rows(_rows(spark, sf_dir)).select("graph_id", F.col("edge_ix").cast("bigint").alias("edge_ix"))


REPEATED_SQL = f"WITH {_STRIPPED} SELECT graph_id, edge_ix FROM kb QUALIFY count(*) OVER (PARTITION BY graph_id, {_CLASS}) >= 2"


def _unique(spark, sf_dir):
    return ops.unique_in_rows(_rows(spark, sf_dir)).select("graph_id", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


UNIQUE_SQL = f"WITH {_STRIPPED} SELECT graph_id, src, dst FROM kb QUALIFY count(*) OVER (PARTITION BY graph_id, {_CLASS}) = 1"


def _degrees(spark, sf_dir):
    return ops.degrees_in_rows(_rows(spark, sf_dir)).withColumn("atom_ix", F.col("atom_ix").cast("bigint"))


DEGREE_SQL = f"WITH {_STRIPPED} SELECT k.graph_id, k.atom_ix, count(b.edge_ix) AS degree FROM kept k LEFT JOIN kb b ON b.graph_id = k.graph_id AND (b.src = k.atom_ix OR b.dst = k.atom_ix) GROUP BY 1, 2"


def _components(spark, sf_dir):
    return ops.component_counts(*_stripped(spark, sf_dir))


COMPONENTS_SQL = f"""
WITH RECURSIVE {_STRIPPED}, both_ AS (SELECT graph_id, src AS a, dst AS b FROM kb UNION SELECT graph_id, dst, src FROM kb),
reach(graph_id, a, b) AS (SELECT graph_id, atom_ix, atom_ix FROM kept UNION SELECT r.graph_id, r.a, e.b FROM reach r JOIN both_ e ON e.graph_id = r.graph_id AND e.a = r.b),
roots AS (SELECT graph_id, a, min(b) AS root, count(*) AS size FROM reach GROUP BY 1, 2)
SELECT graph_id, count(DISTINCT root) AS components, count(DISTINCT CASE WHEN size > 1 THEN root END) AS bonded_components FROM roots GROUP BY 1
"""


def _labels(spark, sf_dir):
    """Components by propagation alone, counted from the labels."""
    labels = ops.component_labels(*_stripped(spark, sf_dir))
    return labels.where("root = atom_ix").groupBy("graph_id").agg(F.count("*").alias("components"))


def _incident(spark, sf_dir):
    return ops.graph_pairs(_rows(spark, sf_dir)).select("graph_id", F.col("left_edge").cast("bigint").alias("left_edge"), F.col("right_edge").cast("bigint").alias("right_edge"))


INCIDENT_SQL = f"WITH {_STRIPPED} SELECT DISTINCT a.graph_id, a.edge_ix AS left_edge, b.edge_ix AS right_edge FROM kb a JOIN kb b ON a.graph_id = b.graph_id AND a.edge_ix < b.edge_ix AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst))"


def _subsets(spark, sf_dir):
    return ops.subsets_in_rows(_rows(spark, sf_dir), 3).select("graph_id", F.array_join(F.transform("mask", lambda e: e.cast("string")), ",").alias("mask"))


SUBSETS_SQL = f"""
WITH {_STRIPPED}, inc AS (SELECT DISTINCT a.graph_id, a.edge_ix AS x, b.edge_ix AS y FROM kb a JOIN kb b ON a.graph_id = b.graph_id AND a.edge_ix <> b.edge_ix AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst)))
SELECT DISTINCT graph_id, array_to_string(list_sort([x, y, z]), ',') AS mask FROM (
    SELECT p.graph_id, p.x, p.y, q.y AS z FROM inc p JOIN inc q ON q.graph_id = p.graph_id AND q.x = p.y AND q.y <> p.x)
"""


def _refined(spark, sf_dir):
    """Classes of atoms of the order graphs without hydrogens, and the rounds until they are stable."""
    found = colours.refined(*_stripped(spark, sf_dir))
    return found.select("graph_id", F.col("atom_ix").cast("bigint").alias("atom_ix"), F.col("class_atom").cast("bigint").alias("class_atom"), F.col("rounds").cast("bigint").alias("rounds"))


_LISTS = f"""{_STRIPPED}, lists AS (SELECT k.graph_id, k.labels, coalesce(e.es, []) AS es FROM (SELECT graph_id, list(label ORDER BY atom_ix) AS labels FROM kept GROUP BY 1) k
    LEFT JOIN (SELECT graph_id, list(struct_pack(s := src + 1, d := dst + 1, l := label)) AS es FROM kb GROUP BY 1) e USING (graph_id))"""
REFINED_SQL = f"""
WITH RECURSIVE {_LISTS}, r(graph_id, es, cols, rounds, more) AS (
    SELECT graph_id, es, labels, 0, true FROM lists
    UNION ALL
    SELECT graph_id, es, CASE WHEN len(list_distinct(new)) > len(list_distinct(cols)) THEN new ELSE cols END, rounds + CASE WHEN len(list_distinct(new)) > len(list_distinct(cols)) THEN 1 ELSE 0 END, len(list_distinct(new)) > len(list_distinct(cols))
    FROM (SELECT *, list_transform(range(1, len(cols) + 1), lambda i: md5(cols[i] || '|' || array_to_string(list_sort(list_transform(list_filter(es, lambda e: e.s = i OR e.d = i), lambda e: e.l || ':' || cols[e.s + e.d - i])), ','))) AS new FROM r WHERE more)
), ended AS (SELECT * FROM r WHERE NOT more)
SELECT graph_id, i - 1 AS atom_ix, list_position(cols, cols[i]) - 1 AS class_atom, CAST(rounds AS BIGINT) AS rounds FROM ended, unnest(range(1, len(cols) + 1)) t(i)
"""


def _peeled(spark, sf_dir):
    """Layers of leaves of the order graphs without hydrogens."""
    found = colours.peeled(*_stripped(spark, sf_dir))
    return found.select("graph_id", F.col("atom_ix").cast("bigint").alias("atom_ix"), F.col("layer").cast("bigint").alias("layer"))


PEELED_SQL = f"""
WITH RECURSIVE {_LISTS}, r(graph_id, es, layers, layer, more) AS (
    SELECT graph_id, es, list_transform(labels, lambda x: CAST(NULL AS BIGINT)), 0, true FROM lists
    UNION ALL
    SELECT graph_id, list_filter(es, lambda e: new[e.s] IS NULL AND new[e.d] IS NULL), new, layer + 1, len(list_filter(new, lambda x: x IS NOT NULL)) > len(list_filter(layers, lambda x: x IS NOT NULL))
    FROM (SELECT *, list_transform(range(1, len(layers) + 1), lambda i: CASE WHEN layers[i] IS NULL AND len(list_filter(es, lambda e: e.s = i OR e.d = i)) <= 1 THEN layer + 1 ELSE layers[i] END) AS new FROM r WHERE more)
), ended AS (SELECT * FROM r WHERE NOT more)
SELECT graph_id, i - 1 AS atom_ix, layers[i] AS layer FROM ended, unnest(range(1, len(layers) + 1)) t(i)
"""


def _graph(row) -> Graph:
    return Graph.of(list(row["labels"]), [(e["src"], e["dst"], e["label"]) for e in row["edges"]])


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-Pair certificates, pathways and canonical forms of the path graphs."""
    ship(spark)

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                graph = _graph(row)
                grammar, exact = graph_repair.repair(graph), graph_search.solve(graph)
                turned = Graph.of(graph.labels[::-1], [(len(graph.labels) - 1 - u, len(graph.labels) - 1 - v, x) for u, v, x in graph.edges])
                whole = (1 << len(graph.edges)) - 1
                out.append((row["graph_id"], graph_repair.replay(grammar.certificate()) == grammar.bound, grammar.bound >= exact.index, graph_search.replay(graph, exact.steps) == exact.index, Canonizer(graph).code(whole) == Canonizer(turned).code(whole)))
            yield pd.DataFrame(out, columns=["text", "replays", "not_below_exact", "pathway_replays", "renumbering_keeps_class"])

    return path_graphs(spark, sf_dir).mapInPandas(run, "text string, replays boolean, not_below_exact boolean, pathway_replays boolean, renumbering_keeps_class boolean")


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint copies of each path, plain and compensated: one join less per component after the first."""
    rows = path_graphs(spark, sf_dir)
    rows, n = rows.withColumn("shift", F.size("labels")), F.col("shift")
    both = rows.select("graph_id", F.concat("labels", "labels").alias("labels"), F.concat("edges", F.transform("edges", lambda e: F.struct((e["src"] + n).alias("src"), (e["dst"] + n).alias("dst"), e["label"].alias("label")))).alias("edges"))
    plain = assembly_of_graphs(both).select("graph_id", F.col("assembly_index").alias("plain"))
    less = assembly_of_graphs(both, GraphOptions(compensate_disjoint=True)).select("graph_id", F.col("assembly_index").alias("compensated"))
    return plain.join(less, "graph_id").select(F.col("graph_id").alias("text"), (F.col("plain") - F.col("compensated")).alias("difference"), (F.col("compensated") >= 0).alias("not_negative"))


DOUBLED_SQL = f"SELECT text, CAST(1 AS INTEGER) AS difference, true AS not_negative FROM ({DISTINCT_SQL})"


def _graph_bounds(spark, sf_dir):
    atoms, bonds = _stripped(spark, sf_dir)
    labels = atoms.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("atom_ix", "label"))), lambda a: a["label"]).alias("labels"))
    edges = ops.edge_list(bonds).groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_ix", "src", "dst", F.col("label").cast("int").alias("label")))), lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["label"].alias("label"))).alias("edges"))
    graphs = labels.join(edges, "graph_id")
    exact = assembly_of_graphs(graphs).select("graph_id", F.col("assembly_index").alias("exact"), "succeeded")
    bound = assembly_of_graphs(graphs, GraphOptions(algorithm="repair")).select("graph_id", F.col("assembly_index").alias("bound"), "trivial_bound")
    return exact.join(bound, "graph_id").select("graph_id", "succeeded", (F.col("exact") <= F.col("bound")).alias("bound_holds"), (F.col("bound") <= F.col("trivial_bound")).alias("not_above_trivial"), F.col("trivial_bound").cast("bigint").alias("trivial_bound"))


BOUNDS_SQL = f"WITH {_STRIPPED} SELECT graph_id, true AS succeeded, true AS bound_holds, true AS not_above_trivial, count(*) - 1 AS trivial_bound FROM kb GROUP BY graph_id"

def _positions(spark, sf_dir):
    return ops.path_positions(path_graphs(spark, sf_dir)).select(F.col("graph_id").alias("text"), F.col("edge_ix").cast("bigint").alias("edge_ix"), F.col("position").cast("bigint").alias("position"))


def _without():
    """A row for each label whose bonds a part leaves out."""
    return F.explode(F.array(*map(F.lit, range(3)))).alias("without")


def _children(spark, sf_dir):
    """From single bonds to pairs: transitions of the order graphs, each inside the three parts that the bonds of one label leave."""
    small, large = ops.parted(order_graphs(spark, sf_dir))
    found = ops.joined_by(ops.children_in_rows(_transition_rows(small)), large, lambda g: ops.children(*_transitions(ops.exploded(g)[1])).drop("part"))
    return found.select("graph_id", F.col("level").cast("bigint").alias("level"), F.col("node").cast("bigint").alias("node"))


def _transition_rows(graphs: DataFrame) -> DataFrame:
    """A row (graph_id, part, nodes, transitions) per graph and part."""
    step = lambda a, b: F.struct(F.lit(1).alias("level"), a.alias("node"), (F.least(a, b) * 100 + F.greatest(a, b)).alias("child"), b.alias("edge"))
    there, back = F.transform("pairs", lambda p: step(p["left_edge"], p["right_edge"])), F.transform("pairs", lambda p: step(p["right_edge"], p["left_edge"]))
    labels = F.transform("edges", lambda e: e["label"])
    rows = ops.held(ops.pairs_in_rows(graphs), transitions=F.concat(there, back), edge_labels=labels).select("*", _without())
    left = F.filter(F.transform("edge_labels", lambda x, i: F.when(x != F.col("without"), i)), lambda i: i.isNotNull())
    rows = rows.select((F.col("graph_id") * 3 + F.col("without")).alias("graph_id"), "transitions", left.alias("left"))
    return ops.held(rows, part=F.col("left"), nodes=F.transform("left", lambda i: F.struct(F.lit(1).alias("level"), i.alias("node"))), transitions=F.col("transitions"))


def _transitions(bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """transitions and nodes of graphs of any size."""
    near = ops.incident_pairs(bonds)
    both = near.unionByName(near.select("graph_id", F.col("right_edge").alias("left_edge"), F.col("left_edge").alias("right_edge")))
    pair = F.least("left_edge", "right_edge") * 100 + F.greatest("left_edge", "right_edge")
    both, bonds = (t.select("*", _without()).withColumn("graph_id", F.col("graph_id") * 3 + F.col("without")) for t in (both, bonds))
    transitions = both.select("graph_id", F.lit(1).alias("level"), F.col("left_edge").alias("node"), pair.alias("child"), F.col("right_edge").alias("edge"))
    left = bonds.where("label <> without")
    parts = left.groupBy("graph_id").agg(F.array_sort(F.collect_list("edge_ix")).alias("part"))
    nodes = left.join(parts, "graph_id").select("graph_id", F.lit(1).alias("level"), F.col("edge_ix").alias("node"), "part")
    return transitions, nodes


CHILDREN_SQL = f"""WITH {GRAPH_SQL} SELECT DISTINCT a.graph_id * 3 + w AS graph_id, CAST(2 AS BIGINT) AS level, a.edge_ix * 100 + b.edge_ix AS node FROM unnest(range(3)) t(w), bonds a JOIN bonds b ON a.graph_id = b.graph_id AND a.edge_ix < b.edge_ix AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst)) WHERE a.label <> w AND b.label <> w"""


def _workers(spark, sf_dir):
    """Least value that any event type found for each user."""
    from joinery.runtime import table

    found = table(spark, sf_dir, "events").select("user_id", F.round("value", 1).alias("index"), F.col("event_type").alias("worker"), F.col("event_id").alias("pathway"))
    return ops.best_of_workers(found, "user_id").select("user_id", F.col("index").alias("least"), "pathway", "worker")


def _counters(spark, sf_dir):
    from joinery.runtime import table

    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).alias("nodes"), F.floor("value").alias("depth"))
    return ops.merged_counters(rows, ["event_type"], ["nodes"], ["depth"])


QUERIES = {
    "graph_path_positions": (_positions, f"SELECT text, i AS edge_ix, i AS position FROM ({DISTINCT_SQL}), unnest(range(length(text))) t(i)"),
    "graph_children": (_children, CHILDREN_SQL),
    "worker_best": (_workers, "SELECT user_id, round(value, 1) AS least, event_id AS pathway, event_type AS worker FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 1), event_type, event_id) = 1"),
    "worker_counters": (_counters, "SELECT event_type, CAST(sum(floor(value * 100)) AS BIGINT) AS nodes, CAST(max(floor(value)) AS BIGINT) AS depth FROM events GROUP BY 1"),
    "graph_index_paths": (_paths, index_sql(ORDERS_SQL, True)),
    "graph_index_stars": (_stars, STARS_SQL),
    "graph_read_native": (_native, SHAPE_SQL),
    "graph_source_files": (_source, SHAPE_SQL),
    "graph_read_molfile": (_molfile, SHAPE_SQL),
    "graph_without_hydrogens": (_bond_rows, f"WITH {_STRIPPED} SELECT graph_id, edge_ix, src, dst, label FROM kb"),
    "graph_edge_list": (_edge_rows, EDGES_SQL),
    "graph_class_counts": (_class_counts, CLASS_SQL),
    "graph_repeated_classes": (_repeated, REPEATED_SQL),
    "graph_unique_bonds": (_unique, UNIQUE_SQL),
    "graph_degrees": (_degrees, DEGREE_SQL),
    "graph_components": (_components, COMPONENTS_SQL),
    "graph_component_labels": (_labels, f"SELECT graph_id, components FROM ({COMPONENTS_SQL})"),
    "graph_refined_classes": (_refined, REFINED_SQL),
    "graph_peeled_layers": (_peeled, PEELED_SQL),
    "graph_incident_pairs": (_incident, INCIDENT_SQL),
    "graph_connected_subsets": (_subsets, SUBSETS_SQL),
    "graph_checks": (_checks, f"SELECT text, true AS replays, true AS not_below_exact, true AS pathway_replays, true AS renumbering_keeps_class FROM ({DISTINCT_SQL})"),
    "graph_compensation": (_doubled, DOUBLED_SQL),
    "graph_exact_and_bound": (_graph_bounds, BOUNDS_SQL),
}
