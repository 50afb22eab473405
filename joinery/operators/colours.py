"""Classes of vertices by colour refinement, and leaves peeled in layers, of all graphs of a table together; no Python in the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.operators import graphs
from joinery.operators.graphs import gathered, held, let
from joinery.runtime import materialise


def _both(bonds: DataFrame) -> DataFrame:
    turned = bonds.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label")
    return materialise(bonds.select("graph_id", "src", "dst", "label").unionByName(turned), "both")


def _first(label: Column) -> Column:
    return F.sha2(F.concat(F.lit("label "), F.coalesce(label.cast("string"), F.lit(""))), 256)


def _next(colour: Column, around: Column) -> Column:
    """An atom's new colour from its own and those around it (array of label:colour)."""
    return F.sha2(F.concat_ws("|", colour, F.array_join(F.array_sort(around), ",")), 256)


def _refined_in_rows(rows: DataFrame) -> DataFrame:
    """refined() of graphs that are rows, as gathered() gives them: all rounds of a graph in its row."""
    rows = held(rows, ixs=F.transform("atoms", lambda a: a["atom_ix"]), colours=F.transform("atoms", lambda a: _first(a["label"])), bonds=F.col("bonds"))
    place = lambda end: (F.array_position("ixs", end) - 1).cast("int")
    side = lambda x, a, b: F.transform(F.filter("bonds", lambda e: (e[a] == x) & F.array_contains("ixs", e[b])), lambda e: F.struct(e["label"].alias("label"), place(e[b]).alias("at")))
    rows = held(rows, ixs=F.col("ixs"), colours=F.col("colours"), near=F.transform("ixs", lambda x: F.concat(side(x, "src", "dst"), side(x, "dst", "src"))))
    kinds = lambda colours: F.size(F.array_distinct(colours))
    state = lambda colours, n, rounds, more: F.struct(colours.alias("colours"), n.alias("n"), rounds.alias("rounds"), F.lit(more).alias("more"))
    new = lambda s: F.transform("near", lambda ns, i: _next(F.get(s["colours"], i), F.transform(ns, lambda m: F.concat_ws(":", m["label"], F.get(s["colours"], m["at"])))))
    split = lambda s, c: F.when(kinds(c) > s["n"], state(c, kinds(c), s["rounds"] + 1, True)).otherwise(state(s["colours"], s["n"], s["rounds"], False))
    step = lambda s, _: F.when(s["more"], let(new(s), lambda c: split(s, c))).otherwise(s)
    ended = F.aggregate(F.sequence(F.lit(1), F.size("ixs")), state(F.col("colours"), kinds("colours"), F.lit(0), True), step)
    rows = held(rows, ixs=F.col("ixs"), s=ended).where(F.size("ixs") > 0)
    rows = rows.select("graph_id", "ixs", F.col("s.colours").alias("colours"), "s.rounds")
    atom = F.transform("ixs", lambda x, i: F.struct(x.alias("atom_ix"), F.get("colours", i).alias("colour"), F.get("ixs", (F.array_position("colours", F.get("colours", i)) - 1).cast("int")).alias("class_atom")))
    return rows.select("graph_id", F.explode(atom).alias("a"), "rounds").select("graph_id", "a.atom_ix", "a.colour", "a.class_atom", "rounds")


def refined(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, atom_ix, colour, class_atom, rounds: the coarsest stable partition of each graph's atoms that refines their labels.

    In a round an atom's new colour is the SHA-256 of its own and its neighbours' bond labels and colours in order, so equal
    colours mean the same in all graphs, and graphs with different colours are not isomorphic. A graph is done when a round splits none
    of its classes; `rounds` counts those that did, class_atom is the least atom of a class. A hub's neighbours meet in one row
    as digests, as they must to be compared; isolated atoms keep their label's colour's class; empty tables give no rows. Graphs of up
    to IN_ROW atoms and bonds go through their rounds in their rows, larger ones in rounds over the table.
    """
    rows, large = gathered(atoms, bonds, graphs.IN_ROW)
    found = _refined_in_rows(rows)
    return found if large is None else found.unionByName(_refined_in_rounds(*large))


def _refined_in_rounds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    near = _both(bonds)
    state = materialise(atoms.select("graph_id", "atom_ix", _first(F.col("label")).alias("colour")), "colours")
    classes = lambda s: s.groupBy("graph_id").agg(F.countDistinct("colour").alias("classes"))
    sizes, done, rounds = materialise(classes(state), "classes"), None, 0
    while True:
        seen = near.join(state.select("graph_id", F.col("atom_ix").alias("dst"), "colour"), ["graph_id", "dst"])
        around = seen.groupBy("graph_id", F.col("src").alias("atom_ix")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("label").cast("string"), "colour"))), ",").alias("around"))
        new = state.join(around, ["graph_id", "atom_ix"], "left").select("graph_id", "atom_ix", F.sha2(F.concat_ws("|", "colour", F.coalesce("around", F.lit(""))), 256).alias("colour"))
        new = materialise(new, "colours")
        counts = materialise(classes(new).join(sizes.withColumnRenamed("classes", "before"), "graph_id"), "classes")
        still = counts.where("classes = before").select("graph_id")
        ended = state.join(still, "graph_id", "left_semi").withColumn("rounds", F.lit(rounds))
        done = ended if done is None else done.unionByName(ended)
        state = new.join(counts.where("classes > before").select("graph_id"), "graph_id", "left_semi")
        sizes = counts.where("classes > before").select("graph_id", "classes")
        if sizes.isEmpty():
            break
        rounds += 1
    done = materialise(done, "refined")
    least = done.groupBy("graph_id", "colour").agg(F.min("atom_ix").alias("class_atom"))
    return done.join(least, ["graph_id", "colour"]).select("graph_id", "atom_ix", "colour", "class_atom", "rounds")


def signatures(coloured: DataFrame) -> DataFrame:
    """graph_id, signature: equal for graphs that refinement cannot tell apart, whatever their atoms' numbers."""
    counts = coloured.groupBy("graph_id", "colour").agg(F.count("*").alias("n"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "colour", F.col("n").cast("string")))), ",")
    return counts.groupBy("graph_id").agg(F.sha2(text, 256).alias("signature"))


def peeled(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, atom_ix, layer: the round in which an atom falls off when all atoms of at most one bond are taken away at once, from 1; null in rings and between them.

    Trees end in one centre or two. As many rounds as the longest path from a leaf; each is written to the shared folder.
    """
    near = _both(bonds)
    left, out, layer = materialise(atoms.select("graph_id", "atom_ix"), "peeled"), None, 0
    while True:
        layer += 1
        degree = near.groupBy("graph_id", F.col("src").alias("atom_ix")).agg(F.count("*").alias("n"))
        gone = materialise(left.join(degree, ["graph_id", "atom_ix"], "left").where("coalesce(n, 0) <= 1").select("graph_id", "atom_ix"), "peeled")
        if gone.isEmpty():
            rest = left.withColumn("layer", F.lit(None).cast("int"))
            return rest if out is None else out.unionByName(rest)
        now = gone.withColumn("layer", F.lit(layer))
        out = now if out is None else out.unionByName(now)
        left = materialise(left.join(gone, ["graph_id", "atom_ix"], "left_anti"), "peeled")
        kept = near.join(gone.withColumnRenamed("atom_ix", "src"), ["graph_id", "src"], "left_anti").join(gone.withColumnRenamed("atom_ix", "dst"), ["graph_id", "dst"], "left_anti")
        near = materialise(kept.select("graph_id", "src", "dst", "label"), "both")
