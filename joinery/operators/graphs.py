"""Relational operators on graphs: atoms (graph_id, atom_ix, label) and bonds (graph_id, edge_ix, src, dst, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.functions.scalars import bond_class
from joinery.operators import masks
from joinery.runtime import forget, materialise

#: Atoms and bonds of a graph that is worked on in one row.
IN_ROW = 64
#: Edge numbers of a block: bonds of a vertex whose pairs are made in one row.
HUB = 1_000


def exploded(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """atoms and bonds of graphs (graph_id, labels, edges)."""
    atoms = graphs.select("graph_id", F.posexplode("labels").alias("atom_ix", "label"))
    bonds = graphs.select("graph_id", F.posexplode("edges").alias("edge_ix", "e")).select("graph_id", "edge_ix", "e.src", "e.dst", "e.label")
    return atoms, bonds


def without_label(atoms: DataFrame, bonds: DataFrame, label: str = "H") -> tuple[DataFrame, DataFrame]:
    """Drop vertices of exactly this label and their bonds; the others are numbered anew in order."""
    w = Window.partitionBy("graph_id").orderBy("atom_ix")
    kept = atoms.where(F.col("label") != label).withColumn("new_ix", F.row_number().over(w) - 1)
    place = kept.select("graph_id", F.col("atom_ix").alias("old"), "new_ix")
    joined = bonds.join(place.select("graph_id", F.col("old").alias("src"), F.col("new_ix").alias("s")), ["graph_id", "src"])
    joined = joined.join(place.select("graph_id", F.col("old").alias("dst"), F.col("new_ix").alias("d")), ["graph_id", "dst"])
    ordinal = F.row_number().over(Window.partitionBy("graph_id").orderBy("edge_ix")) - 1
    return (
        kept.select("graph_id", F.col("new_ix").alias("atom_ix"), "label"),
        joined.select("graph_id", ordinal.alias("edge_ix"), F.col("s").alias("src"), F.col("d").alias("dst"), "label"),
    )


def held(graphs: DataFrame, **columns) -> DataFrame:
    """graph_id and these columns, worked out once: a projection above would work them out anew for each element that refers to them."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return graphs.select("graph_id", F.explode(F.array(made)).alias("_g")).select("graph_id", *[F.col(f"_g.{n}").alias(n) for n in columns])


def stripped(graphs: DataFrame, label: str = "H") -> DataFrame:
    """without_label() and without_zero_order() of graphs that are rows (graph_id, labels, edges), each in its row: no sort and no join."""
    other = lambda x: x != label
    ix = lambda end: F.size(F.filter(F.slice("labels", F.lit(1), end), other))
    kept = F.filter("edges", lambda e: other(F.get("labels", e["src"])) & other(F.get("labels", e["dst"])) & (e["label"] != 0))
    moved = F.transform(kept, lambda e: F.struct(ix(e["src"]).alias("src"), ix(e["dst"]).alias("dst"), e["label"].alias("label")))
    return held(graphs, labels=F.filter("labels", other), edges=moved)


def exploded_with_class(graphs: DataFrame) -> DataFrame:
    """bonds with `bond_class` of graphs (graph_id, labels, edges), as with_class() of their tables."""
    end = lambda e, c: F.get("labels", e[c])
    each = F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["label"].alias("label"), bond_class(end(e, "src"), end(e, "dst"), e["label"]).alias("bond_class")))
    return graphs.select("graph_id", F.posexplode(each).alias("edge_ix", "e")).select("graph_id", "edge_ix", "e.src", "e.dst", "e.label", "e.bond_class")


def parted(graphs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Graphs of up to IN_ROW atoms and bonds, which are worked on in their rows, and the larger ones, written once, if there are any."""
    fits = (F.size("labels") <= IN_ROW) & (F.size("edges") <= IN_ROW)
    large = materialise(graphs.where(~fits), "large")
    return graphs.where(fits), None if large.isEmpty() else large


def joined_by(found: DataFrame, large: DataFrame | None, made) -> DataFrame:
    """found, and made(large) if there are large graphs."""
    return found if large is None else found.unionByName(made(large))


def without_zero_order(bonds: DataFrame) -> DataFrame:
    return bonds.where(F.col("label") != 0)


def edge_list(bonds: DataFrame) -> DataFrame:
    """Each bond once with src < dst, by src and then its place in the input, numbered from 0."""
    turned = bonds.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "label", F.col("edge_ix").alias("_old"))
    w = Window.partitionBy("graph_id").orderBy("src", "_old")
    return turned.select("graph_id", (F.row_number().over(w) - 1).alias("edge_ix"), "src", "dst", "label")


def edge_list_in_rows(graphs: DataFrame) -> DataFrame:
    """edge_list() of graphs that are rows (graph_id, labels, edges): a row's bonds are sorted in it."""
    turned = F.transform("edges", lambda e, i: F.struct(F.least(e["src"], e["dst"]).alias("src"), i.alias("old"), F.greatest(e["src"], e["dst"]).alias("dst"), e["label"].alias("label")))
    return graphs.select("graph_id", F.posexplode(F.array_sort(turned)).alias("edge_ix", "e")).select("graph_id", "edge_ix", "e.src", "e.dst", "e.label")


def with_class(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """bonds with `bond_class`."""
    ends = lambda c, n: atoms.select("graph_id", F.col("atom_ix").alias(c), F.col("label").alias(n))
    joined = bonds.join(ends("src", "_a"), ["graph_id", "src"]).join(ends("dst", "_b"), ["graph_id", "dst"])
    return joined.withColumn("bond_class", bond_class(F.col("_a"), F.col("_b"), F.col("label"))).drop("_a", "_b")


def class_counts(classed: DataFrame) -> DataFrame:
    """graph_id, bond_class, n, first_edge."""
    return classed.groupBy("graph_id", "bond_class").agg(F.count("*").alias("n"), F.min("edge_ix").alias("first_edge"))


def repeated_classes(classed: DataFrame) -> DataFrame:
    """Bonds whose class occurs at least twice in their graph."""
    return classed.withColumn("_n", F.count("*").over(Window.partitionBy("graph_id", "bond_class"))).where("_n >= 2").drop("_n")


def unique_bonds(classed: DataFrame) -> DataFrame:
    """Bonds that no duplicate can hold, by (src, dst)."""
    return classed.withColumn("_n", F.count("*").over(Window.partitionBy("graph_id", "bond_class"))).where("_n = 1").select("graph_id", "src", "dst")


def _classes_in_rows(graphs: DataFrame, holds) -> DataFrame:
    """Bonds (edge_ix, src, dst, bond_class) of small graphs that are rows, whose class occurs so often in its graph that holds(how often)."""
    end = lambda e, c: F.get("labels", e[c])
    each = F.transform("edges", lambda e, i: F.struct(i.alias("edge_ix"), e["src"].alias("src"), e["dst"].alias("dst"), bond_class(end(e, "src"), end(e, "dst"), e["label"]).alias("bond_class")))
    often = lambda e: F.size(F.filter("bonds", lambda x: x["bond_class"].eqNullSafe(e["bond_class"])))
    kept = F.filter("bonds", lambda e: holds(often(e)))
    return held(graphs, bonds=each).select("graph_id", F.explode(kept).alias("e")).select("graph_id", "e.*")


def repeated_in_rows(graphs: DataFrame) -> DataFrame:
    """graph_id, edge_ix of repeated_classes() of graphs (graph_id, labels, edges): small graphs in their rows, others by a window."""
    small, large = parted(graphs)
    found = _classes_in_rows(small, lambda n: n >= 2).select("graph_id", "edge_ix")
    return joined_by(found, large, lambda g: repeated_classes(exploded_with_class(g)).select("graph_id", "edge_ix"))


def unique_in_rows(graphs: DataFrame) -> DataFrame:
    """unique_bonds() of graphs (graph_id, labels, edges): small graphs in their rows, others by a window."""
    small, large = parted(graphs)
    found = _classes_in_rows(small, lambda n: n == 1).select("graph_id", "src", "dst")
    return joined_by(found, large, lambda g: unique_bonds(exploded_with_class(g)))


def degrees(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, atom_ix, degree; isolated atoms have 0."""
    ends = bonds.select("graph_id", F.explode(F.array("src", "dst")).alias("atom_ix")).groupBy("graph_id", "atom_ix").agg(F.count("*").alias("degree"))
    return atoms.select("graph_id", "atom_ix").join(ends, ["graph_id", "atom_ix"], "left").select("graph_id", "atom_ix", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degrees_in_rows(graphs: DataFrame) -> DataFrame:
    """degrees() of graphs (graph_id, labels, edges): small graphs in their rows, others by a join."""
    small, large = parted(graphs)
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["dst"])))
    counted = held(small, n=F.size("labels"), ends=ends)
    each = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.size(F.filter("ends", lambda x: x == i)).cast("bigint")))
    return joined_by(counted.select("graph_id", F.posexplode(each).alias("atom_ix", "degree")), large, lambda g: degrees(*exploded(g)))


def gathered(atoms: DataFrame, bonds: DataFrame, most: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Graphs of up to `most` atoms and bonds as rows (graph_id, atoms, bonds: arrays of structs with labels as strings), and atoms and bonds of the larger ones, if there are any.

    The tables are written once, so that neither is worked out again for its sizes.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    text = F.col("label").cast("string").alias("label") if "label" in bonds.columns else F.lit(None).cast("string").alias("label")
    a = atoms.select("graph_id", "atom_ix", none(bonds, "src").alias("src"), none(bonds, "dst").alias("dst"), F.col("label").cast("string").alias("label") if "label" in atoms.columns else text, F.lit(True).alias("atom"))
    b = bonds.select("graph_id", none(atoms, "atom_ix").alias("atom_ix"), "src", "dst", text, F.lit(False).alias("atom"))
    rows = materialise(a.unionByName(b), "graphs")
    big = materialise(rows.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("graph_id"), "large")
    large = None
    if not big.isEmpty():
        those = rows.join(big, "graph_id", "left_semi")
        large = (those.where("atom").select("graph_id", "atom_ix", "label"), those.where("not atom").select("graph_id", "src", "dst", "label"))
        rows = rows.join(big, "graph_id", "left_anti")
    all_ = lambda here, *c: F.array_sort(F.collect_list(F.when(here, F.struct(*c))))
    is_atom = F.col("atom")
    return rows.groupBy("graph_id").agg(all_(is_atom, "atom_ix", "label").alias("atoms"), all_(~is_atom, "src", "dst", "label").alias("bonds")), large


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def component_labels(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, atom_ix, root (the least atom of its component).

    A graph of up to IN_ROW atoms and bonds is labelled in its row: each bond gives both ends' components the lesser root. Larger ones go in rounds.
    """
    rows, large = gathered(atoms.select("graph_id", "atom_ix"), bonds.select("graph_id", "src", "dst"), IN_ROW)
    rows = held(rows, ixs=F.transform("atoms", lambda a: a["atom_ix"]), bonds=F.col("bonds"))
    root = lambda roots, end: F.get(roots, (F.array_position("ixs", end) - 1).cast("int"))
    lower = lambda roots, p: F.transform(roots, lambda r: F.when(r == F.greatest(p["a"], p["b"]), F.least(p["a"], p["b"])).otherwise(r))
    at = lambda roots, e: F.struct(F.when(F.array_contains("ixs", e["src"]), root(roots, e["src"])).alias("a"), F.when(F.array_contains("ixs", e["dst"]), root(roots, e["dst"])).alias("b"))
    joined = F.aggregate("bonds", F.col("ixs"), lambda roots, e: let(at(roots, e), lambda p: F.when(p["a"] != p["b"], lower(roots, p)).otherwise(roots)))
    rows = held(rows, found=F.arrays_zip(F.col("ixs").alias("atom_ix"), joined.alias("root")))
    found = rows.select("graph_id", F.explode("found").alias("f")).select("graph_id", "f.atom_ix", "f.root")
    return found if large is None else found.unionByName(propagated_labels(*large))


def propagated_labels(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """component_labels() of graphs of any size, by label propagation with pointer jumping.

    The state is written between rounds; the number of rounds is logarithmic in the longest path for most graphs.
    """
    both = materialise(bonds.select("graph_id", "src", "dst").unionByName(bonds.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    state, sum_ = materialise(atoms.select("graph_id", "atom_ix", F.col("atom_ix").alias("root")), "roots"), None
    while True:
        near = both.join(state.select("graph_id", F.col("atom_ix").alias("dst"), F.col("root").alias("r")), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("atom_ix")).agg(F.min("r").alias("r"))
        lower = state.join(near, ["graph_id", "atom_ix"], "left").withColumn("root", F.least("root", "r")).drop("r")
        up = lower.select("graph_id", F.col("atom_ix").alias("root"), F.col("root").alias("r"))
        before, state = state, materialise(lower.join(up, ["graph_id", "root"], "left").select("graph_id", "atom_ix", F.least("root", "r").alias("root")), "roots")
        forget(before)
        now = state.agg(F.sum(F.col("root").cast("decimal(20,0)"))).first()[0]  # roots only fall
        if now == sum_:
            return state
        sum_ = now


def component_counts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, components (isolated atoms included), bonded_components (only those with a bond)."""
    roots = component_labels(atoms, bonds).groupBy("graph_id", "root").agg(F.count("*").alias("n"))
    return roots.groupBy("graph_id").agg(F.count("*").alias("components"), F.sum((F.col("n") > 1).cast("long")).alias("bonded_components"))


def incident_pairs(bonds: DataFrame, kept: str | None = None) -> DataFrame:
    """graph_id, left_edge, right_edge: bonds that share a vertex, each pair once; with `kept`, a column of the bonds, also left_ and right_ of it.

    A vertex's bonds lie in blocks of HUB edge numbers. The pairs of a block are made in its row. Only bonds numbered HUB or more have
    others in an earlier block; each block of a vertex has its own key, so that the pairs of a hub are made in many tasks. Bonds that share
    both vertices meet at the lesser one only.
    """
    more = [kept] if kept else []
    ends = bonds.select("graph_id", "edge_ix", *more, F.explode(F.array_distinct(F.array(F.struct(F.col("src").alias("vertex"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("vertex"), F.col("src").alias("other"))))).alias("v"))
    ends = ends.select("graph_id", "edge_ix", *more, "v.vertex", "v.other", F.floor(F.col("edge_ix") / HUB).cast("int").alias("block"))
    member = F.struct("edge_ix", "other", *more)
    blocks = ends.groupBy("graph_id", "vertex", "block").agg(F.array_sort(F.collect_list(member)).alias("all"))
    first = lambda a, b: (a["other"] != b["other"]) | (a["other"] >= F.col("vertex"))

    def told(pairs: DataFrame) -> DataFrame:
        out = pairs.where(first(F.col("a"), F.col("b")))
        return out.select("graph_id", F.col("a.edge_ix").alias("left_edge"), F.col("b.edge_ix").alias("right_edge"), *[F.col(f"{x}.{kept}").alias(f"{n}_{kept}") for x, n in (("a", "left"), ("b", "right")) if kept])

    rest = F.transform("all", lambda a, i: F.struct(a.alias("a"), F.slice("all", i + 2, F.size("all")).alias("rest")))
    inside = blocks.where(F.size("all") > 1).select("graph_id", "vertex", F.explode(rest).alias("e")).select("graph_id", "vertex", "e.a", F.explode("e.rest").alias("b"))
    later = ends.where("block > 0").select("graph_id", "vertex", "block", member.alias("b"))
    goals = later.groupBy("graph_id", "vertex").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    asked = ends.join(goals, ["graph_id", "vertex"]).select("graph_id", "vertex", member.alias("a"), F.explode(F.filter("blocks", lambda x: x > F.col("block"))).alias("block"))
    across = asked.join(later, ["graph_id", "vertex", "block"]).select("graph_id", "vertex", "a", "b")
    return told(inside).unionByName(told(across))


def _meet(a: Column, b: Column) -> Column:
    return (a["src"] == b["src"]) | (a["src"] == b["dst"]) | (a["dst"] == b["src"]) | (a["dst"] == b["dst"])


def pairs_in_rows(graphs: DataFrame, kept: str | None = None) -> DataFrame:
    """graph_id, edges, pairs: small graphs that are rows with their incident_pairs() as an array."""
    bonds = F.transform("edges", lambda e, i: F.struct(i.alias("edge_ix"), e["src"].alias("src"), e["dst"].alias("dst"), *[e[c].alias(c) for c in (kept,) if c]))
    later = lambda a: F.filter("bonds", lambda b: (b["edge_ix"] > a["edge_ix"]) & _meet(a, b))
    told = lambda a, b: F.struct(a["edge_ix"].alias("left_edge"), b["edge_ix"].alias("right_edge"), *[x[kept].alias(f"{n}_{kept}") for x, n in ((a, "left"), (b, "right")) if kept])
    pairs = F.flatten(F.transform("bonds", lambda a: F.transform(later(a), lambda b: told(a, b))))
    return held(held(graphs, edges=F.col("edges"), bonds=bonds), edges=F.col("edges"), pairs=pairs)


def graph_pairs(graphs: DataFrame) -> DataFrame:
    """incident_pairs() of graphs (graph_id, labels, edges): small graphs in their rows, others by keys."""
    small, large = parted(graphs)
    inside = pairs_in_rows(small).select("graph_id", F.explode("pairs").alias("p")).select("graph_id", "p.left_edge", "p.right_edge")
    return joined_by(inside, large, lambda g: incident_pairs(exploded(g)[1]))


def connected_subsets(bonds: DataFrame, size: int) -> DataFrame:
    """graph_id, mask: all connected sets of `size` bonds, grown bond by bond along shared vertices."""
    near = incident_pairs(bonds)
    near = near.unionByName(near.select("graph_id", F.col("right_edge").alias("left_edge"), F.col("left_edge").alias("right_edge")))
    level = bonds.select("graph_id", F.array("edge_ix").alias("mask"))
    for _ in range(size - 1):
        front = level.select("graph_id", "mask", F.explode("mask").alias("left_edge"))
        grown = front.join(near, ["graph_id", "left_edge"]).where(~F.expr("array_contains(mask, right_edge)"))
        level = grown.select("graph_id", F.array_sort(F.array_append("mask", F.col("right_edge"))).alias("mask")).distinct()
    return level


def subsets_in_rows(graphs: DataFrame, size: int) -> DataFrame:
    """connected_subsets() of graphs (graph_id, labels, edges): sets of up to 3 bonds of small graphs are words, grown in their rows; others go by joins."""
    if size > 3:
        return connected_subsets(exploded(graphs)[1], size)
    small, large = parted(graphs)
    bonds = F.transform("edges", lambda e, i: F.struct(masks.word(F.array(i)).alias("bit"), e["src"].alias("src"), e["dst"].alias("dst")))
    near = lambda a: F.aggregate(F.filter("bonds", lambda b: (a["bit"] != b["bit"]) & _meet(a, b)), F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(b["bit"]))
    rows = held(held(small, bonds=bonds), near=F.transform("bonds", lambda a: F.struct(a["bit"].alias("bit"), near(a).alias("near"))))
    rows = rows.withColumn("level", F.transform("near", lambda n: n["bit"]))
    for _ in range(size - 1):
        new = lambda m: F.filter("near", lambda n: (n["bit"].bitwiseAND(m) == 0) & (n["near"].bitwiseAND(m) != 0))
        grown = F.array_distinct(F.flatten(F.transform("level", lambda m: F.transform(new(m), lambda n: n["bit"].bitwiseOR(m)))))
        rows = held(rows, near=F.col("near"), level=grown)
    found = rows.select("graph_id", F.explode("level").alias("bits")).select("graph_id", masks.members(F.col("bits"), F.lit(0)).alias("mask"))
    return joined_by(found, large, lambda g: connected_subsets(exploded(g)[1], size))


def disjoint_class_pairs(occ: DataFrame) -> DataFrame:
    """Pairs (graph_id, canon, left, right) of occurrences (graph_id, canon, ix, mask) of a class without a common bond."""
    a, b = occ.alias("a"), occ.alias("b")
    same = (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.canon") == F.col("b.canon")) & (F.col("a.ix") < F.col("b.ix"))
    pairs = a.join(b, same & ~F.arrays_overlap("a.mask", "b.mask"))
    return pairs.select("a.graph_id", "a.canon", F.col("a.ix").alias("left"), F.col("b.ix").alias("right"))


def class_pairs_in_rows(rows: DataFrame, meeting: bool) -> DataFrame:
    """graph_id, canon, left, right: each two occurrences of a class that share a bond (`meeting`) or share none, of small graphs that are
    rows (graph_id, occ: structs of canon, ix and bits, a word of bonds)."""
    later = lambda a: F.filter("occ", lambda b: (b["canon"] == a["canon"]) & (b["ix"] > a["ix"]) & ((a["bits"].bitwiseAND(b["bits"]) != 0) == meeting))
    met = F.flatten(F.transform("occ", lambda a: F.transform(later(a), lambda b: F.struct(a["canon"].alias("canon"), a["ix"].alias("left"), b["ix"].alias("right")))))
    return rows.select("graph_id", F.explode(met).alias("p")).select("graph_id", "p.*")


def class_unions(occ: DataFrame) -> DataFrame:
    """graph_id, canon and the union of the masks of each class, by packed words."""
    keys = ["graph_id", "canon"]
    return masks.unpacked(masks.packed(occ, keys), keys)


def unions_in_rows(rows: DataFrame) -> DataFrame:
    """class_unions() of small graphs that are rows, as class_pairs_in_rows() takes them."""
    union = lambda c: F.aggregate(F.filter("occ", lambda o: o["canon"] == c), F.lit(0).cast("long"), lambda bits, o: bits.bitwiseOR(o["bits"]))
    each = F.transform(F.array_distinct(F.transform("occ", lambda o: o["canon"])), lambda c: F.struct(c.alias("canon"), union(c).alias("bits")))
    return rows.select("graph_id", F.explode(each).alias("c")).select("graph_id", "c.canon", masks.members(F.col("c.bits"), F.lit(0).cast("long")).alias("mask"))


def first_seen_in_rows(rows: DataFrame, order: str) -> DataFrame:
    """first_seen_ids() of graphs that are rows (graph_id, occ: structs of canon and `order`)."""
    placed = F.array_sort(F.transform("occ", lambda o: F.struct(o[order].alias("at"), o["canon"].alias("canon"))))
    names = F.array_distinct(F.transform(placed, lambda o: o["canon"]))
    return rows.select("graph_id", F.posexplode(names).alias("class_id", "canon"))


def first_seen_ids(occ: DataFrame, order: str) -> DataFrame:
    """Dense class numbers from 0 by first appearance in `order`."""
    first = occ.groupBy("graph_id", "canon").agg(F.min(order).alias("_first"))
    return first.select("graph_id", "canon", (F.row_number().over(Window.partitionBy("graph_id").orderBy("_first")) - 1).alias("class_id"))


def undominated(states: DataFrame, stored: DataFrame) -> DataFrame:
    """New states (key, saved) that no stored state of the same key reaches; of equal keys the best one."""
    best = states.groupBy("key").agg(F.max("saved").alias("saved"))
    known = stored.groupBy("key").agg(F.max("saved").alias("_known"))
    return best.join(known, "key", "left").where(F.col("_known").isNull() | (F.col("_known") < F.col("saved"))).drop("_known")


def children(transitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Next level of a precomputed enumeration: transitions (graph_id, level, node, child, edge) of the nodes
    (graph_id, level, node, part) whose added edge lies in the node's part (array of edges)."""
    return nodes.join(transitions, ["graph_id", "level", "node"]).where(F.expr("array_contains(part, edge)")).select("graph_id", (F.col("level") + 1).alias("level"), F.col("child").alias("node"), "part").distinct()


def children_in_rows(rows: DataFrame) -> DataFrame:
    """children() without the parts, of graphs that are rows (graph_id, part, nodes, transitions: arrays of structs) and whose nodes have one part."""
    from_node = lambda t: F.exists("nodes", lambda n: (n["level"] == t["level"]) & (n["node"] == t["node"]))
    taken = F.filter("transitions", lambda t: F.array_contains("part", t["edge"]) & from_node(t))
    new = F.array_distinct(F.transform(taken, lambda t: F.struct((t["level"] + 1).alias("level"), t["child"].alias("node"))))
    return rows.select("graph_id", F.explode(new).alias("c")).select("graph_id", "c.level", "c.node")


def path_positions(graphs: DataFrame) -> DataFrame:
    """graph_id, edge_ix, position along the path from its lesser end; only graphs that are one path (labels, edges arrays).

    List ranking by pointer jumping: each bond is two darts, a dart's successor goes on at its far end, and in each round
    successors skip as far again. The rounds are logarithmic in the longest path, and a path's darts are spread over all tasks.
    """
    _, bonds = exploded(graphs)
    side = lambda a, b: bonds.select("graph_id", "edge_ix", F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("edge_ix") * 2 + (F.col(a) > F.col(b)).cast("int")).cast("long").alias("dart"))
    darts = side("src", "dst").unionByName(side("dst", "src"))
    degree = darts.groupBy("graph_id", "src").agg(F.count("*").alias("n"))
    shape = degree.groupBy("graph_id").agg(F.max("n").alias("most"), F.sum((F.col("n") == 1).cast("int")).alias("ends"), (F.sum("n") / 2).cast("long").alias("bonds"), F.max(F.when(F.col("n") == 1, F.col("src"))).alias("last"))
    darts = darts.join(shape.where("most <= 2 AND ends = 2").select("graph_id", "bonds", "last"), "graph_id")
    a, b = darts.alias("a"), darts.alias("b")
    follows = (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.edge_ix") != F.col("b.edge_ix"))
    jump = F.coalesce("b.dart", "a.dart").alias("jump")
    state = a.join(b, follows, "left").select("a.graph_id", "a.edge_ix", "a.dart", "a.bonds", jump, F.col("b.dart").isNotNull().cast("long").alias("steps"), (F.col("b.dart").isNull() & (F.col("a.dst") == F.col("a.last"))).alias("final"))
    state = materialise(state, "darts")
    reach, most = 1, state.agg(F.max("bonds")).first()[0] or 0
    while reach < most:
        to = state.select("graph_id", F.col("dart").alias("jump"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"))
        before, state = state, materialise(state.join(to, ["graph_id", "jump"]).select("graph_id", "edge_ix", "dart", "bonds", F.col("_jump").alias("jump"), (F.col("steps") + F.col("_steps")).alias("steps"), "final"), "darts")
        forget(before)
        reach *= 2
    goal = state.where("final").select("graph_id", F.col("dart").alias("jump"))
    found = state.join(goal, ["graph_id", "jump"])
    # bonds of a ring beside the path never reach its end
    whole = found.groupBy("graph_id").agg(F.count("*").alias("n"))
    found = found.join(whole, "graph_id").where("n = bonds")
    return found.select("graph_id", F.col("edge_ix").cast("int").alias("edge_ix"), (F.col("bonds") - 1 - F.col("steps")).cast("int").alias("position"))


def path_strings(graphs: DataFrame) -> DataFrame:
    """graph_id, text: a symbol for each bond label along the path, of graphs that are one path with equal atoms.

    A part of such a graph and its mirror image are isomorphic, so its index is that of the text when parts equal their reversals.
    """
    alike = graphs.where(F.size(F.array_distinct("labels")) == 1)
    _, bonds = exploded(alike)
    # labels are 1 to 32767, so the symbols lie between U+3401 and U+B3FF
    symbol = F.decode(F.unhex(F.lpad(F.hex(F.col("label") + 0x3400), 4, "0")), "UTF-16BE")
    placed = path_positions(alike).join(bonds.select("graph_id", "edge_ix", symbol.alias("symbol")), ["graph_id", "edge_ix"])
    return placed.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda x: x["symbol"]), "").alias("text"))


def best_of_workers(found: DataFrame, key: str) -> DataFrame:
    """key, index, pathway, worker: the least index that any worker found; of equal ones the first worker's."""
    best = F.min(F.struct("index", "worker", "pathway")).alias("b")
    return found.groupBy(key).agg(best).select(key, "b.index", "b.pathway", "b.worker")


def merged_counters(telemetry: DataFrame, keys: list[str], counters: list[str], peaks: list[str]) -> DataFrame:
    """Counters of all workers added up, high-water marks by their largest."""
    return telemetry.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], *[F.max(c).alias(c) for c in peaks])
