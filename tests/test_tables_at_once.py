"""Operators that work on all objects of a table in rounds, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from joinery.kernels.string_repair import repair
from joinery.kernels.strings import solve
from joinery.operators import colours, frontier, grammar, masks, ranks, selection, strings
from joinery.operators import graphs as ops

TEXTS = [None, "", "x", "abcdef", "abab", "aaa", "aaaa", "abababab", "bbbabba", "baabaa", "abcxcba", "abba", "😀é😀é", "000001111122222"]


def texts(n, longest, letters="abc", seed=1):
    rng = random.Random(seed)
    found = TEXTS + ["".join(rng.choices(letters[: 2 + i % 2], k=rng.randrange(2, longest))) for i in range(n)]
    return list(enumerate(dict.fromkeys(found)))


@pytest.mark.parametrize("reverse", [False, True])
def test_frontier_equals_single_searches(spark, reverse):
    rows = texts(40, 12)
    got = {r["id"]: r["assembly_index"] for r in frontier.assembly_frontier(spark.createDataFrame(rows, "id long, text string"), reverse).collect()}
    assert got == {i: None if t is None else solve(t, reverse).index for i, t in rows}


def test_frontier_has_no_python_and_deals_states(spark, tmp_path):
    spark.createDataFrame([("a", ["abab"], 2, 0)], "id string, parts array<string>, longest int, saved long").write.parquet(f"{tmp_path}/s")
    front = spark.read.parquet(f"{tmp_path}/s")
    objects = front.select("id", F.lit(4).alias("symbols"), F.lit(0).alias("floor"), F.lit(0).cast("long").alias("best"))
    plan = frontier.worth(frontier.unvisited(frontier.best_of_keys(frontier.moved(front)), front), objects, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning(id" in plan and "parts" in plan
    assert frontier.assembly_frontier(spark.createDataFrame([], "id long, text string")).collect() == []


def classes(text, size, reverse):
    found = defaultdict(list)
    for i in range(len(text or "") - size + 1):
        part = text[i : i + size]
        found[min(part, part[::-1]) if reverse else part].append(i)
    return sorted((len(p), p[0], p[-1], p[-1] - p[0] >= size) for p in found.values() if len(p) > 1)


@pytest.mark.parametrize("reverse", [False, True])
def test_doubling_finds_all_duplicates(spark, reverse):
    rows = texts(25, 60) + [(100, "abcd" * 50), (101, "a" * 300), (102, "xy" * 40 + "q" + "yx" * 40)]
    strings = spark.createDataFrame(rows, "id long, text string")
    got = defaultdict(list)
    for r in ranks.duplicate_classes(strings, reverse).collect():
        got[r["id"], r["length"]].append((r["n"], r["first"], r["last"], r["valid"]))
    want = {(i, 2**k): classes(t, 2**k, reverse) for i, t in rows for k in range(1, 9)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    longest = {r["id"]: r["length"] for r in ranks.longest_duplicates(strings, reverse).collect()}
    assert longest == {i: max([k for k in range(2, len(t or "")) if classes(t, k, reverse)], default=0) for i, t in rows}


def test_any_length_is_two_overlapping_parts(spark):
    rows = texts(10, 50)
    levels = dict(ranks.doubled(spark.createDataFrame(rows, "id long, text string"), True))
    for length in (5, 7, 8):
        got = defaultdict(list)
        for r in ranks.summary(ranks.of_size(levels[4], 4, length, True), length).collect():
            got[r["id"]].append((r["n"], r["first"], r["last"], r["valid"]))
        assert {k: sorted(v) for k, v in got.items()} == {i: c for i, t in rows if (c := classes(t, length, True))}


def test_no_duplicates_at_all(spark):
    none = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, text string")
    assert ranks.duplicate_classes(none).collect() == []
    assert {r["length"] for r in ranks.longest_duplicates(none).collect()} == {0}


@pytest.mark.parametrize("reverse", [False, True])
def test_grammar_rounds_equal_single_grammars(spark, reverse):
    rows = texts(40, 25) + [(100, "abcd" * 6 + "dcba")]
    strings = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in grammar.repair_bounds(strings, reverse).collect()}
    plain = {i: repair(t, reverse) for i, t in rows if t is not None}
    assert got == {i: (None,) * 3 if t is None else (plain[i].bound, len(plain[i].rules), len(plain[i].residual)) for i, t in rows}
    left, rules = grammar.repaired(strings, reverse)
    pieces = defaultdict(list)
    for r in left.collect():
        pieces[r["id"]].append((r["at"], r["piece"]))
    assert {i: "".join(p for _, p in sorted(x)) for i, x in pieces.items()} == {i: t for i, t in rows if t}
    steps = defaultdict(list)
    for r in rules.orderBy("round").collect():
        steps[r["id"]].append(len(r["key"]))
    assert steps == {i: [r.length for r in g.rules] for i, g in plain.items() if g.rules}


def test_grammar_of_nothing(spark):
    assert grammar.repair_bounds(spark.createDataFrame([], "id long, text string")).collect() == []


def test_first_disjoint_is_the_greedy_choice(spark):
    rng = random.Random(4)
    rows = [(g, r, rng.sample(range(8), rng.randrange(0, 4))) for g in range(30) for r in range(rng.randrange(0, 15))]
    want = set()
    for g in range(30):
        used = set()
        for _, r, m in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            if not used & set(m):
                used |= set(m)
                want.add((g, r))
    got = selection.first_disjoint(spark.createDataFrame(rows, "id int, rank int, members array<int>")).collect()
    assert {(r["id"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert selection.first_disjoint(spark.createDataFrame([], "id int, rank int, members array<int>")).collect() == []


def random_graphs(spark, seed=9, n=25):
    rng = random.Random(seed)
    atoms, bonds = [], []
    for g in range(n):
        size = rng.randrange(1, 9)
        atoms += [(g, i, rng.choice("CN")) for i in range(size)]
        pairs = {tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randrange(0, size + 1))} if size > 1 else set()
        bonds += [(g, k, u, v, rng.randrange(1, 3)) for k, (u, v) in enumerate(sorted(pairs))]
    return atoms, bonds, spark.createDataFrame(atoms, "graph_id int, atom_ix int, label string"), spark.createDataFrame(bonds, "graph_id int, edge_ix int, src int, dst int, label int")


def test_refinement_and_peeling(spark):
    atoms, bonds, a, b = random_graphs(spark)
    near = defaultdict(list)
    for g, _, u, v, x in bonds:
        near[g, u].append((x, v))
        near[g, v].append((x, u))
    got = {(r["graph_id"], r["atom_ix"]): (r["class_atom"], r["rounds"]) for r in colours.refined(a, b).collect()}
    layers = {(r["graph_id"], r["atom_ix"]): r["layer"] for r in colours.peeled(a, b).collect()}
    for g in {x[0] for x in atoms}:
        mine = {i: label for h, i, label in atoms if h == g}
        colour, rounds = dict(mine), 0
        while True:
            new = {i: (colour[i], tuple(sorted((x, colour[v]) for x, v in near[g, i]))) for i in mine}
            if len(set(new.values())) == len(set(colour.values())):
                break
            colour, rounds = new, rounds + 1
        for i in mine:
            assert got[g, i] == (min(j for j in mine if colour[j] == colour[i]), rounds)
        left, layer = set(mine), 0
        while gone := {i for i in left if sum(v in left for _, v in near[g, i]) <= 1}:
            layer += 1
            assert {layers[g, i] for i in gone} == {layer}
            left -= gone
        assert all(layers[g, i] is None for i in left)
    assert len(got) == len(layers) == len(atoms)


def test_signatures_do_not_see_numbers(spark):
    atoms, bonds, a, b = random_graphs(spark)
    turned = lambda df, *c: df.select("graph_id", *[(F.lit(20) - F.col(x)).alias(x) if x in c else F.col(x) for x in df.columns[1:]])
    plain = dict(map(tuple, colours.signatures(colours.refined(a, b)).collect()))
    assert plain == dict(map(tuple, colours.signatures(colours.refined(turned(a, "atom_ix"), turned(b, "src", "dst"))).collect()))
    assert colours.refined(a.limit(0), b.limit(0)).collect() == [] == colours.peeled(a.limit(0), b.limit(0)).collect()


def test_path_positions_of_long_paths_and_other_graphs(spark):
    edge = lambda u, v: (u, v, 1)
    path = list(range(100))
    random.Random(3).shuffle(path)
    rows = [
        ("long", ["C"] * 100, [edge(*sorted(path[i : i + 2])) for i in range(99)]),
        ("ring", ["C"] * 3, [edge(0, 1), edge(1, 2), edge(0, 2)]),
        ("path and ring", ["C"] * 5, [edge(0, 1), edge(2, 3), edge(3, 4), edge(2, 4)]),
        ("star", ["C"] * 4, [edge(0, 1), edge(0, 2), edge(0, 3)]),
        ("two", ["C"] * 4, [edge(0, 1), edge(2, 3)]),
        ("one", ["C"] * 2, [edge(0, 1)]),
        ("none", ["C"], []),
    ]
    graphs = spark.createDataFrame(rows, "graph_id string, labels array<string>, edges array<struct<src:int,dst:int,label:int>>")
    got = {(r["graph_id"], r["edge_ix"]): r["position"] for r in ops.path_positions(graphs).collect()}
    forward = path if path[0] < path[-1] else path[::-1]
    place = {tuple(sorted(forward[i : i + 2])): i for i in range(99)}
    want = {("long", k): place[u, v] for k, (u, v, _) in enumerate(rows[0][2])} | {("one", 0): 0}
    assert got == want
    texts_ = dict(map(tuple, ops.path_strings(graphs).collect()))
    assert {k: len(v) for k, v in texts_.items()} == {"long": 99, "one": 1}
    assert ops.path_positions(graphs.limit(0)).collect() == []


def test_containing_by_cells(spark):
    rng = random.Random(6)
    rows = lambda n, longest: [(rng.randrange(2), rng.randrange(300), rng.randrange(longest)) for _ in range(n)]
    parts, asked = rows(60, 90), rows(80, 30) + [(7, 3, 2), (0, 5, 0), (0, 5, 0)]
    frame = lambda x: spark.createDataFrame(x, "id int, offset int, length int")
    want = []
    for i, o, n in asked:
        holds = [(i, o, n, p, m) for j, p, m in parts if i == j and p <= o and p + m >= o + n]
        want += holds or [(i, o, n, None, None)]
    found = strings.containing(frame(parts), frame(asked))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert strings.containing(frame(parts).limit(0), frame(asked)).where("part_offset is not null").count() == 0


def test_packed_words(spark):
    rng = random.Random(5)
    sets = {(k, i): sorted(rng.sample(range(300), rng.randrange(0, 40))) for k in range(4) for i in range(6)}
    sets[0, 0] = [63, 64, 127, 128]
    sets[1, 1] = []
    df = spark.createDataFrame([(k, i, m + m[:1]) for (k, i), m in sets.items()] + [(9, 9, None)], "k int, ix int, mask array<int>")
    words = masks.packed(df, ["k", "ix"])
    by = lambda d, c: {(r["k"], r["ix"]): r[c] for r in d.collect()}
    some = {key: m for key, m in sets.items() if m}
    assert by(masks.unpacked(words, ["k", "ix"]), "mask") == some
    assert by(masks.sizes(words, ["k", "ix"]), "members") == {key: len(m) for key, m in some.items()}
    for at in (0, 63, 64, 100, 299):
        assert by(masks.next_member(words, ["k", "ix"], at), "next") == {key: min(x for x in m if x >= at) for key, m in some.items() if m[-1] >= at}
    pairs = {(k, a, b) for k, a in some for h, b in some if k == h and a < b and set(sets[k, a]) & set(sets[k, b])}
    assert {tuple(r) for r in masks.overlapping_pairs(words, ["k"]).collect()} == pairs
    union = {r["k"]: r["mask"] for r in masks.unpacked(masks.united(words, ["k"]), ["k"]).collect()}
    assert union == {k: sorted({x for (h, _), m in some.items() if h == k for x in m}) for k in range(4)}


def test_hubs_have_all_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(ops, "HUB", 4)
    bonds = [(0, k, 0, k + 1, 1) for k in range(30)] + [(0, 30, 1, 2, 1), (1, 0, 0, 1, 1)]
    got = ops.incident_pairs(spark.createDataFrame(bonds, "graph_id int, edge_ix int, src int, dst int, label int")).collect()
    want = {(g, i, j) for g, i, a, b, _ in bonds for h, j, c, d, _ in bonds if g == h and i < j and {a, b} & {c, d}}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_phases_are_counted_while_they_run(spark, tmp_path):
    from joinery.plans.solve import assembly_of_strings
    from joinery.sources import sinks

    solved = assembly_of_strings(spark.createDataFrame([("abab",), ("abc",), (None,)], "text string"), "text")
    phases = sinks.Phases()
    phases.watch(solved, "search").write.parquet(f"{tmp_path}/out")
    phases.watch(spark.read.parquet(f"{tmp_path}/out"), "report", {"rows": F.count("*"), "longest": F.max(F.length("text"))}).write.format("noop").mode("overwrite").save()
    got = {(r["phase"], r["counter"]): r["value"] for r in phases.rows(spark).collect()}
    assert got["search", "objects"] == 3 and got["search", "succeeded"] == 2 and got["report", "rows"] == 3 and got["report", "longest"] == 4
    assert {k: v for (p, k), v in got.items() if p == "search"} == sinks.metrics(spark.read.parquet(f"{tmp_path}/out")).first().asDict()
    with pytest.raises(sinks.OutputError):
        phases.watch(solved, "search")
