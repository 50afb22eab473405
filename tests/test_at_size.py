"""Steps whose disk, memory or rounds grew too fast: what they do now, and that both ways of each give the same rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from joinery.kernels import repair_bounds
from joinery.operators import graphs as ops
from joinery.operators import colours, grammar, masks, ranks, selection, strings
from joinery.plans import solve
from joinery.queries import graphs as queries
from joinery.queries import scalars
from joinery.runtime import dealt


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("reverse", [False, True])
def test_duplicates_in_rows_shuffle_no_places(spark, monkeypatch, reverse):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab😀"[: 2 + i % 2], k=rng.randrange(0, 70)))) for i in range(30)] + [(90, None), (91, "ab\0" * 30), (92, "xyyx" * 9 + "q" + "x" * 40)]
    strings = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    found = ranks.duplicate_classes(strings, reverse)
    assert exchanges(found) <= 1  # rows dealt to all cores; before, every place of every size was joined
    monkeypatch.setattr(ranks, "IN_ROW", 20)
    mixed = ranks.duplicate_classes(strings, reverse)
    monkeypatch.setattr(ranks, "IN_ROW", -1)
    rounds = ranks.duplicate_classes(strings, reverse)
    plain = sorted(map(tuple, rounds.collect()))
    assert len(plain) > 100 and plain == sorted(map(tuple, found.collect())) == sorted(map(tuple, mixed.collect()))
    assert found.schema.simpleString() == rounds.schema.simpleString()


def graph_rows(spark, n=40):
    rng = random.Random(11)
    rows = []
    for g in range(n):
        size = rng.randrange(1, 9)
        pairs = sorted({tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randrange(0, 2 * size))}) if size > 1 else []
        rows.append((g, rng.choices("CNH", k=size), [(u, v, rng.randrange(0, 3)) for u, v in pairs]))
    return spark.createDataFrame(rows, "graph_id int, labels array<string>, edges array<struct<src:int,dst:int,label:int>>")


def sorted_rows(df, *columns):
    return sorted(map(repr, df.select(*(columns or df.columns)).collect()))


def test_graphs_are_stripped_in_their_rows(spark):
    graphs = graph_rows(spark)
    atoms, bonds = ops.exploded(graphs)
    want = ops.without_label(atoms, ops.without_zero_order(bonds))
    rows = ops.stripped(graphs)
    got = ops.exploded(rows)
    assert all(sorted_rows(g) == sorted_rows(w) for g, w in zip(got, want, strict=True))
    assert sorted_rows(ops.exploded_with_class(rows), "graph_id", "edge_ix", "bond_class") == sorted_rows(ops.with_class(*want), "graph_id", "edge_ix", "bond_class")
    assert exchanges(rows) == 0  # before, windows and two joins


def test_incident_pairs_of_loops_and_parallel_bonds(spark, monkeypatch):
    rng = random.Random(2)
    bonds = [(g, k, rng.randrange(6), rng.randrange(6), rng.randrange(3)) for g in range(5) for k in range(25)]
    label = {(g, k): x for g, k, _, _, x in bonds}
    want = sorted((g, i, j, label[g, i], label[g, j]) for g, i, a, b, _ in bonds for h, j, c, d, _ in bonds if g == h and i < j and {a, b} & {c, d})
    frame = spark.createDataFrame(bonds, "graph_id int, edge_ix int, src int, dst int, label int")
    for hub in (1_000, 7, 1):
        monkeypatch.setattr(ops, "HUB", hub)
        assert sorted(map(tuple, ops.incident_pairs(frame, "label").collect())) == want


def test_complement_sorts_once(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(60), rng.randrange(1, 12)) for _ in range(40)]
    intervals = spark.createDataFrame(rows, "id int, offset int, length int")
    wholes = spark.createDataFrame([(i, 50 + i) for i in range(8)], "id int, length int")
    found = strings.interval_complement(wholes, intervals)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window") <= 2  # before, three windows and an aggregate
    want = []
    for i in range(8):
        used = {p for j, o, n in rows if i == j for p in range(o, o + n)} | {-1}
        free = [p for p in range(max(50 + i, max(used))) if p not in used]
        starts = [p for p in free if p - 1 not in free or p == 50 + i]
        for p in [q for q in starts if q - 1 not in free]:
            n = next(k for k in range(1, 99) if p + k not in free)
            want += [(i, p, n)] if not p < 50 + i < p + n else [(i, p, 50 + i - p), (i, 50 + i, p + n - 50 - i)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_small_graphs_need_no_rounds(spark, monkeypatch):
    atoms, bonds = ops.exploded(graph_rows(spark))
    extra = spark.createDataFrame([(0, 90, 0, 77, 1), (1, 91, 0, 0, 2)], bonds.schema)  # a bond to no atom, and a loop
    bonds = bonds.unionByName(extra)
    calls = []
    plain = ops.propagated_labels
    monkeypatch.setattr(ops, "propagated_labels", lambda *a: calls.append(1) or plain(*a))
    rounds = colours._refined_in_rounds
    monkeypatch.setattr(colours, "_refined_in_rounds", lambda *a: calls.append(2) or rounds(*a))
    labels, classes = ops.component_labels(atoms, bonds), colours.refined(atoms, bonds)
    assert calls == []  # before, all graphs went through joins in rounds
    want = sorted_rows(plain(atoms, bonds)), sorted_rows(rounds(atoms, bonds))
    assert (sorted_rows(labels), sorted_rows(classes)) == want
    monkeypatch.setattr(ops, "IN_ROW", 6)
    assert (sorted_rows(ops.component_labels(atoms, bonds)), sorted_rows(colours.refined(atoms, bonds))) == want and calls == [1, 2]


@pytest.mark.parametrize("reverse", [False, True])
def test_short_texts_are_repaired_in_their_rows(spark, monkeypatch, reverse):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abc", k=rng.randrange(0, 30)))) for i in range(20)] + [(50, None), (51, ""), (52, "é😀" * 9)]
    texts = spark.createDataFrame(rows, "id long, text string")
    plain = grammar.repaired
    monkeypatch.setattr(grammar, "repaired", None)  # before, every text went through rounds
    found = sorted_rows(grammar.repair_bounds(texts, reverse))
    monkeypatch.setattr(grammar, "repaired", plain)
    monkeypatch.setattr(grammar, "IN_ROW", 15)
    assert found == sorted_rows(grammar.repair_bounds(texts, reverse)) == sorted_rows(grammar.bounds_in_rounds(texts, reverse))


def some_graphs(spark, monkeypatch):
    """Graphs with repeated bonds, loops, isolated atoms and none at all; those over 6 atoms or bonds count as large."""
    monkeypatch.setattr(ops, "IN_ROW", 6)
    extra = [(90, [], []), (91, ["C"] * 5, []), (92, ["C", "N"], [(0, 1, 1), (1, 0, 1), (0, 0, 2)]), (93, ["C"] * 40, [(0, i, i % 3) for i in range(1, 40)])]
    graphs = graph_rows(spark)
    return graphs.unionByName(spark.createDataFrame(extra, graphs.schema))


def test_incident_pairs_are_made_in_rows(spark, monkeypatch):
    graphs = some_graphs(spark, monkeypatch)
    want = sorted_rows(ops.incident_pairs(ops.exploded(graphs)[1]))
    assert want and sorted_rows(ops.graph_pairs(graphs)) == want
    small, _ = ops.parted(graphs)
    assert exchanges(ops.pairs_in_rows(small, "label")) == 0  # before, two aggregates and two joins


def occurrences(spark, monkeypatch, graphs):
    """Rows and table of scalars._occurrence_rows() over these graphs, and all as a table made by keys."""
    monkeypatch.setattr(scalars, "order_graphs", lambda *a: graphs)
    rows, others = scalars._occurrence_rows(spark, None)
    return rows, others, scalars._occurrence_table(graphs)


def test_first_seen_needs_no_window(spark, monkeypatch):
    rows, others, plain = occurrences(spark, monkeypatch, some_graphs(spark, monkeypatch))
    found = ops.first_seen_in_rows(rows, "ix")
    assert exchanges(found) == 0  # before, pairs by keys, an aggregate and a window
    both = found.unionByName(ops.first_seen_ids(others, "ix"))
    assert sorted_rows(both, "graph_id", "canon", "class_id") == sorted_rows(ops.first_seen_ids(plain, "ix"), "graph_id", "canon", "class_id")
    assert sorted_rows(scalars._occurrences(spark, None)) == sorted_rows(plain)


def test_pairs_of_a_class_are_met_in_rows(spark, monkeypatch):
    rows, others, plain = occurrences(spark, monkeypatch, some_graphs(spark, monkeypatch))
    keys = ["graph_id", "canon"]
    for meeting, table in ((True, lambda o: masks.overlapping_pairs(masks.packed(o, [*keys, "ix"]), keys)), (False, ops.disjoint_class_pairs)):
        found = ops.class_pairs_in_rows(rows, meeting)
        assert exchanges(found) == 0  # before, occurrences were joined by class
        want = sorted_rows(table(plain), *keys, "left", "right")
        assert want and sorted_rows(found.unionByName(table(others)), *keys, "left", "right") == want


def test_unions_of_classes_in_rows(spark, monkeypatch):
    rows, others, plain = occurrences(spark, monkeypatch, some_graphs(spark, monkeypatch))
    found = ops.unions_in_rows(rows)
    assert exchanges(found) == 0  # before, words were aggregated by class
    assert sorted_rows(found.unionByName(ops.class_unions(others))) == sorted_rows(ops.class_unions(plain))


def test_greedy_selection_in_rows(spark, monkeypatch):
    rows, others, plain = occurrences(spark, monkeypatch, some_graphs(spark, monkeypatch))
    assert exchanges(selection.first_disjoint_in_rows(rows)) == 0
    want = set()
    classes_ = defaultdict(list)
    for r in plain.collect():
        classes_[r["graph_id"], r["canon"]].append((r["ix"], r["mask"]))
    for key, runs in classes_.items():
        used = set()
        for ix, mask in sorted(runs):
            if not used & set(mask):
                used |= set(mask)
                want.add((*key, ix))
    assert {tuple(r) for r in scalars._selected(spark, None).collect()} == want != set()
    small, _ = ops.parted(graph_rows(spark))
    monkeypatch.setattr(scalars, "order_graphs", lambda *a: small)
    monkeypatch.setattr(selection, "materialise", None)
    assert scalars._selected(spark, None).count() > 0  # before, all classes went in rounds


def test_rounds_of_the_greedy_selection_send_no_table_to_the_driver(spark, monkeypatch):
    plans, write = [], selection.materialise

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(selection, "materialise", seen)
    pairs = spark.createDataFrame([(1, r, [r, r + 1]) for r in range(6)] + [(2, 0, [])], "id int, rank int, members array<int>")
    assert sorted(map(tuple, selection.first_disjoint(pairs).select("id", "rank").collect())) == [(1, 0), (1, 2), (1, 4), (2, 0)]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)  # before, each round's small files were broadcast


def test_children_in_rows(spark, monkeypatch):
    graphs = some_graphs(spark, monkeypatch)
    monkeypatch.setattr(queries, "order_graphs", lambda *a: graphs)
    found = ops.children_in_rows(queries._transition_rows(ops.parted(graphs)[0]))
    assert exchanges(found) == 0  # before, transitions and nodes were joined
    want = ops.children(*queries._transitions(ops.exploded(graphs)[1])).selectExpr("graph_id", "CAST(level AS bigint) AS level", "CAST(node AS bigint) AS node")
    assert sorted_rows(queries._children(spark, None)) == sorted_rows(want) != []


def test_words_hold_a_whole_row_of_bonds(spark):
    path = [(i, i + 1, 1) for i in range(64)]  # bonds 0 to 63: the sign bit too
    graphs = spark.createDataFrame([(1, ["C"] * 64, path[:-1] + [(63, 0, 1)])], graph_rows(spark, 1).schema)
    small, large = ops.parted(graphs)
    assert small.count() == 1 and large is None
    masks_ = sorted(r.mask for r in ops.subsets_in_rows(graphs, 3).collect())
    assert masks_ == sorted(sorted([i, (i + 1) % 64, (i + 2) % 64]) for i in range(64))


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_connected_subsets_in_rows(spark, monkeypatch, size):
    graphs = some_graphs(spark, monkeypatch).where("graph_id <> 93 OR %d < 4" % size)
    assert sorted_rows(ops.subsets_in_rows(graphs, size)) == sorted_rows(ops.connected_subsets(ops.exploded(graphs)[1], size)) != []


def test_degrees_in_rows(spark, monkeypatch):
    graphs = some_graphs(spark, monkeypatch)
    assert sorted_rows(ops.degrees_in_rows(graphs)) == sorted_rows(ops.degrees(*ops.exploded(graphs)))


def test_edge_list_in_rows(spark, monkeypatch):
    graphs = some_graphs(spark, monkeypatch)
    found = ops.edge_list_in_rows(graphs)
    assert exchanges(found) == 0  # before, a window over all bonds
    assert sorted_rows(found) == sorted_rows(ops.edge_list(ops.exploded(graphs)[1]))


def test_repeated_classes_in_rows(spark, monkeypatch):
    graphs = some_graphs(spark, monkeypatch)
    assert sorted_rows(ops.repeated_in_rows(graphs)) == sorted_rows(ops.repeated_classes(ops.exploded_with_class(graphs)), "graph_id", "edge_ix") != []


def test_unique_bonds_in_rows(spark, monkeypatch):
    graphs = some_graphs(spark, monkeypatch)
    assert sorted_rows(ops.unique_in_rows(graphs)) == sorted_rows(ops.unique_bonds(ops.exploded_with_class(graphs))) != []


def test_texts_of_like_lengths_are_repaired_together(spark, monkeypatch):
    monkeypatch.setattr(repair_bounds, "SYMBOLS", 20_000)
    texts = spark.createDataFrame([(str(i), "ab" * (3_000 if i % 10 == 0 else 5 + i % 200)) for i in range(400)] + [("none", None), ("empty", "")], "__object string, t string")
    size = F.length("t")
    sums = {r["c"]: r["n"] or 0 for r in texts.groupBy(solve._length_class(size).alias("c")).agg(F.sum(size).alias("n")).collect()}
    tasks = solve._dealt_alike(texts, size, sums).rdd.glom().map(lambda rows: [len(r["t"] or "") for r in rows]).collect()
    assert sum(map(len, tasks)) == 402 and max(map(sum, tasks)) < 60_000
    assert all(max(t) < 4_096 or min(t) >= 4_096 for t in tasks if t)  # before, dealt by a hash of the text
    assert solve._dealt_alike(texts.limit(0), size, {}).count() == 0


def test_rows_of_a_task_do_not_grow_with_the_input(spark):
    lines = spark.range(0, 5_000, 1, 3).withColumnRenamed("id", "key")
    assert dealt(lines, "key", 5_000).rdd.getNumPartitions() == 3  # left alone
    many = dealt(lines, "key", 100)
    assert many.rdd.getNumPartitions() == 50 and max(many.rdd.glom().map(len).collect()) < 200
    assert exchanges(many.groupBy("key").count()) == 1
