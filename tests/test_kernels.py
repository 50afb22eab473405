"""Kernels against independent brute force, exhaustive small corpora and hand-checked values."""

import json
import random
from functools import lru_cache
from itertools import combinations, permutations, product

import numpy as np
import pytest

from joinery.kernels import canon, chains, graph_repair, graph_search, graphs, repair_bounds, string_repair, strings
from joinery.kernels.graphs import FormatError, Graph
from joinery.plans import solve
from joinery.plans.options import StringOptions


def string_index(text, turned):
    form = lambda s: min(s, s[::-1]) if turned else s

    @lru_cache(None)
    def most(parts):
        best = 0
        places = [(i, a, k) for i, p in enumerate(parts) for k in range(2, len(p) + 1) for a in range(len(p) - k + 1)]
        for (i, a, k), (j, b, m) in combinations(places, 2):
            if k != m or form(parts[i][a : a + k]) != form(parts[j][b : b + k]) or (i == j and abs(a - b) < k):
                continue
            rest = [parts[i][a : a + k]]
            for q, p in enumerate(parts):
                at = 0
                for start in sorted(s for r, s in ((i, a), (j, b)) if r == q):
                    rest.append(p[at:start])
                    at = start + k
                rest.append(p[at:])
            best = max(best, k - 1 + most(tuple(sorted(form(r) for r in rest if len(r) > 1))))
        return best

    return len(text) - 1 - (most((form(text),)) if len(text) > 1 else 0)


def full_scan_repair(text, turned):
    """Expansions of the rules and the residual parts, by looking at all neighbours in every round."""
    form = lambda s: min(s, s[::-1]) if turned else s
    parts, known, rules = list(text), set(text), []
    while True:
        groups = {}
        for i in range(len(parts) - 1):
            groups.setdefault(form(parts[i] + parts[i + 1]), []).append(i)
        best = (0, 0, None, [])
        for key, places in groups.items():
            apart = []
            for i in places:
                if not apart or i > apart[-1] + 1:
                    apart.append(i)
            rank = (len(apart) - (key not in known), -places[0])
            if rank[0] > 0 and (best[2] is None or rank > best[:2]):
                best = (*rank, key, apart)
        if best[2] is None:
            return rules, parts
        if best[2] not in known:
            known.add(best[2])
            rules.append(best[2])
        for i in reversed(best[3]):
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("turned", [False, True])
def test_repair_as_a_full_scan(turned):
    rng = random.Random(11)
    words = ["aabbaa", "cbcacaaccbcacbacbccbccbac"] + ["".join(rng.choice("abcdef"[: rng.randrange(1, 7)]) for _ in range(rng.randrange(100))) for _ in range(400)]
    words += [w + w[::-1] + w for w in words[::10]]
    for word in words:
        grammar = string_repair.repair(word, turned)
        rules, parts = full_scan_repair(word, turned)
        text = dict(grammar.terminals)
        for r in grammar.rules:
            text[r.id] = (text[r.left][::-1] if r.left_reversed else text[r.left]) + (text[r.right][::-1] if r.right_reversed else text[r.right])
        assert [text[r.id] for r in grammar.rules] == rules
        assert [word[o : o + n] for _, _, o, n in grammar.residual] == parts


def odd_texts(n, seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 6))) for _ in range(8)]
    texts = ["", "x", "aaaa", "a" * 300, "ab" * 90 + "a" * 20, "baabaa", "abcxcba", "😀é😀é😀", "ab\0" * 9, "\ud800a\ud800a", "abc" * 3 + "cba" * 3]
    texts += ["".join(rng.choices("abcdefgh"[: rng.choice([1, 2, 3, 8])], k=rng.randrange(0, 90))) for _ in range(n)]
    return texts + [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(n // 10)]


@pytest.mark.parametrize("turned", [False, True])
def test_bounds_side_by_side_are_those_of_single_texts(turned, monkeypatch):
    texts = odd_texts(300)
    want = [(len(g.rules), len(g.residual)) for g in (string_repair.repair(t, turned) for t in texts)]
    assert repair_bounds.counted(texts, turned) == want
    assert repair_bounds.counted([]) == [] and repair_bounds.counted(["", ""]) == [(0, 0), (0, 0)]
    options = StringOptions(algorithm="repair", accept_reversed=turned)
    rows = [solve.solve_string(t, options) for t in [None, *texts]]
    monkeypatch.setattr(repair_bounds, "SYMBOLS", 500)
    monkeypatch.setattr(repair_bounds, "LONGEST", 0)
    monkeypatch.setattr(string_repair, "repair", None)  # before, each text was repaired alone
    got = solve.solve_strings([None, *texts], options)
    assert [r | {"cpu_ns": 0} for r in got] == [r | {"cpu_ns": 0} for r in rows]


def test_blocks_of_texts():
    sizes = [repair_bounds.SYMBOLS + 1, 5, repair_bounds.SYMBOLS - 5, 1, 0]
    assert [(b.start, b.stop) for b in repair_bounds.blocks(sizes)] == [(0, 1), (1, 3), (3, 5)] and not list(repair_bounds.blocks([]))
    assert repair_bounds.alike(["abc"] * 3) and not repair_bounds.alike(["abc" * 3, "ab"])


@pytest.mark.parametrize("turned", [False, True])
def test_texts_that_share_a_hash_are_repaired_alone(turned, monkeypatch):
    texts = odd_texts(100)
    want = [string_repair.repair(t, turned) for t in texts]
    mixed = repair_bounds._mixed
    for bits in (3, 8):
        monkeypatch.setattr(repair_bounds, "_mixed", lambda x, bits=np.uint64(64 - bits): mixed(x) >> bits << bits)
        got = repair_bounds.counted(texts, turned)
        assert None in got and all(g in (None, (len(w.rules), len(w.residual))) for g, w in zip(got, want, strict=True))
        rows = solve.solve_strings(texts, StringOptions(algorithm="repair", accept_reversed=turned))
        assert [r["assembly_index"] for r in rows] == [w.bound for w in want]


@pytest.mark.parametrize("turned", [False, True])
def test_all_short_strings(turned):
    words = [w for n in range(8) for w in product("ab", repeat=n)] + [w for n in range(6) for w in product("abc", repeat=n)]
    for word in map("".join, words):
        exact = strings.solve(word, turned)
        assert exact.index == string_index(word, turned) and exact.proven
        assert strings.replay(word, exact.steps, turned) == exact.index
        grammar = string_repair.repair(word, turned)
        assert string_repair.replay(json.loads(json.dumps(grammar.certificate()))) == grammar.bound >= exact.index
        assert strings.replay(word, grammar.witness(), turned) == grammar.bound


@pytest.mark.parametrize(
    "text, turned, exact, bound",
    [("", 0, -1, -1), ("x", 0, 0, 0), ("abcdef", 0, 5, 5), ("abab", 0, 2, 2), ("aaa", 0, 2, 2), ("aaaa", 0, 2, 2), ("abababab", 0, 3, 3), ("bbbabba", 0, 4, 5), ("baabaa", 1, 3, 4), ("abcxcba", 0, 6, 6), ("abcxcba", 1, 4, 4), ("abba", 0, 3, 3), ("abba", 1, 2, 2), ("aa", 0, 1, 1), ("😀é😀é", 0, 2, 2), ("\x00\n\x00\n", 0, 2, 2)],
)
def test_known_strings(text, turned, exact, bound):
    assert strings.solve(text, bool(turned)).index == exact
    assert string_repair.repair(text, bool(turned)).bound == bound


@pytest.mark.parametrize("n, index", [(5, 11), (10, 14), (15, 17), (20, 17)])
def test_blocks(n, index):
    assert strings.solve("0" * n + "1" * n + "2" * n).index == index


@pytest.mark.parametrize("n", [15, 16, 23, 31, 64, 100])
def test_unary_strings_are_addition_chains(n):
    found = strings.solve("a" * n)
    assert found.index == chains.chain_length(n) and strings.replay("a" * n, found.steps) == found.index


def test_string_properties():
    random.seed(0)
    for _ in range(60):
        text = "".join(random.choice("abc") for _ in range(random.randrange(2, 13)))
        plain, turned = strings.solve(text).index, strings.solve(text, True).index
        assert strings.solve(text[::-1]).index == plain and turned <= plain
        counts = [text.count(c) for c in set(text)]
        assert chains.vector_floor(counts) <= turned and plain <= string_repair.repair(text).bound <= len(text) - 1


def test_string_budget_and_target():
    text = "".join(random.Random(1).choice("ab") for _ in range(40))
    none = strings.solve(text, cpu_budget_ns=0)
    assert none.index == 39 and none.runtime_limit_reached and not none.proven
    some = strings.solve(text, cpu_budget_ns=30_000_000)
    assert some.index <= string_repair.repair(text).bound
    known = strings.solve("abcabcabdabd").index
    first = strings.solve("abcabcabdabd", target=known)
    assert first.index == known and strings.replay("abcabcabdabd", first.steps) == known
    assert [i for _, i in some.history] == sorted({i for _, i in some.history}, reverse=True)


def test_string_pathway_document():
    found = strings.solve("abxab")
    document = strings.pathway("abxab", found.steps)
    assert document["file_graph"] == [{"Fragments": ["abxab"], "Positions": [0]}]
    assert document["duplicates"] == [{"Left": [0, 2], "Right": [3, 2]}] and document["remnant"] == [{"Fragments": ["abx"], "Positions": [0]}]


def test_broken_pathways_are_refused():
    for steps in ([((0, 2), (1, 2))], [((0, 2), (2, 3))], [((0, 2), (3, 2))], [((0, 2), (2, 2)), ((0, 2), (2, 2))]):
        with pytest.raises(ValueError):
            strings.replay("ababc", steps)


def test_mutated_string_certificates_are_refused():
    good = string_repair.repair("abcabcab").certificate()
    changes = [("upper_bound", 1), ("rule_count", 9), ("remaining_fragments", 1), ("length", 2), ("input", "abcabcaa"), ("schema", "x"), ("trivial_upper_bound", 3)]
    bad = [good | {k: v} for k, v in changes]
    bad.append(good | {"rules": good["rules"][1:]})
    bad.append(good | {"rules": [good["rules"][0] | {"left_reversed": True}, *good["rules"][1:]]})
    bad.append(good | {"residual": good["residual"][:-1]})
    bad.append(good | {"residual": [good["residual"][0] | {"offset": 1}, *good["residual"][1:]]})
    bad.append(good | {"terminals": good["terminals"] + good["terminals"][:1]})
    for c in bad:
        with pytest.raises(ValueError):
            string_repair.replay(c)


def test_chain_lengths_by_breadth():
    """All chains, not only those that add their last entry."""
    best, level = {1: 0}, {(1,)}
    for depth in range(1, 8):
        level = {tuple(sorted({*c, a + b})) for c in level for a in c for b in c if a + b > c[-1] and a + b <= 40}
        for c in level:
            best.setdefault(c[-1], depth)
    for n in range(1, 31):
        assert chains.chain_length(n) == best[n]
    assert [chains.chain_length(n) for n in (127, 191, 256, 257)] == [10, 11, 8, 9]


def test_vector_floor():
    assert chains.vector_floor([]) == 0 and chains.vector_floor([1, 1, 1]) == 2 and chains.vector_floor([2, 2, 2]) == 3
    assert chains.vector_floor([15]) == 5 and chains.vector_floor([0, 1, 0]) == 0


def test_packing_bounds():
    assert chains.packing_bound(10, 3) == 6 and chains.eligible_packing_bound(10, 3, 10) == 6
    assert chains.eligible_packing_bound(10, 3, 2) == 5 and chains.savings_bound([8], 4) == 4


# graphs


def isomorphic(g, a, h, b):
    """By trying all vertex assignments."""
    ends = lambda graph, m: [graph.edges[i] for i in graphs.bits(m)]
    ea, eb = ends(g, a), ends(h, b)
    va, vb = sorted({x for e in ea for x in e[:2]}), sorted({x for e in eb for x in e[:2]})
    if len(ea) != len(eb) or len(va) != len(vb):
        return False
    want = {(frozenset(e[:2]), e[2]) for e in eb}
    for p in permutations(vb):
        at = dict(zip(va, p, strict=True))
        if all(g.labels[v] == h.labels[at[v]] for v in va) and {(frozenset((at[u], at[v])), x) for u, v, x in ea} == want:
            return True
    return False


def graph_index(graph):
    whole = (1 << len(graph.edges)) - 1
    connected = [m for m in range(1, whole + 1) if m & (m - 1) and len(graph.split(m)) == 1]
    pairs = [(a, b) for a, b in combinations(connected, 2) if not a & b and a.bit_count() == b.bit_count() and isomorphic(graph, a, graph, b)]

    @lru_cache(None)
    def most(parts):
        best = 0
        for a, b in pairs:
            if all(any(m & p == m for p in parts) for m in (a, b)):
                rest = [q for p in parts for q in graph.split(p & ~(a | b)) if q & (q - 1)]
                for keep in (a, b):
                    best = max(best, a.bit_count() - 1 + most(tuple(sorted([*rest, keep]))))
        return best

    return len(graph.edges) - 1 - most(tuple(sorted(p for p in graph.split(whole) if p & (p - 1))))


def checked(graph):
    exact = graph_search.solve(graph)
    assert exact.proven and graph_search.replay(graph, exact.steps) == exact.index
    grammar = graph_repair.repair(graph)
    assert graph_repair.replay(json.loads(json.dumps(grammar.certificate()))) == grammar.bound
    assert not graph.edges or grammar.bound >= exact.index
    assert graph_search.solve(graph, seed=False).index == graph_search.solve(graph, want_steps=False).index == exact.index
    return exact.index


def test_all_tiny_graphs():
    for n in range(1, 5):
        pairs = list(combinations(range(n), 2))
        for chosen in product((0, 1), repeat=len(pairs)):
            graph = Graph.of(["C"] * n, [(*p, 1) for p, yes in zip(pairs, chosen, strict=True) if yes])
            assert checked(graph) == (graph_index(graph) if graph.edges else -1)


def random_graph(rng, n, m):
    pairs = rng.sample(list(combinations(range(n), 2)), min(m, n * (n - 1) // 2))
    return Graph.of([rng.choice("CCN") for _ in range(n)], [(u, v, rng.choice((1, 1, 2))) for u, v in pairs])


def test_random_graphs_and_renumbering():
    rng = random.Random(3)
    for _ in range(60):
        graph = random_graph(rng, rng.randrange(3, 7), rng.randrange(2, 8))
        index = checked(graph)
        assert index == graph_index(graph)
        order = rng.sample(range(len(graph.labels)), len(graph.labels))
        labels = [""] * len(order)
        for old, new in enumerate(order):
            labels[new] = graph.labels[old]
        other = Graph.of(labels, [(order[u], order[v], x) for u, v, x in graph.edges])
        assert graph_search.solve(other).index == index


def test_canonical_forms_against_all_assignments():
    rng = random.Random(4)
    for _ in range(150):
        g, h = random_graph(rng, 5, 5), random_graph(rng, 5, 5)
        a, b = (1 << len(g.edges)) - 1, (1 << len(h.edges)) - 1
        if len(g.split(a)) == len(h.split(b)) == 1:
            assert (canon.Canonizer(g).code(a) == canon.Canonizer(h).code(b)) == isomorphic(g, a, h, b)
    for n in (3, 6, 8):
        ring = Graph.of(["C"] * n, [(i, (i + 1) % n, 1 + i % 2) for i in range(n)])
        turned = Graph.of(["C"] * n, [(i, (i + 1) % n, 1 + (i + 1) % 2) for i in range(n)])
        assert (canon.Canonizer(ring).code((1 << n) - 1) == canon.Canonizer(turned).code((1 << n) - 1)) == (n % 2 == 0 or n == 1 or isomorphic(ring, (1 << n) - 1, turned, (1 << n) - 1))


def path(n, label="C"):
    return Graph.of([label] * (n + 1), [(i, i + 1, 1) for i in range(n)])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 11, 15, 20])
def test_uniform_paths_and_stars_are_addition_chains(n):
    star = Graph.of(["C"] * (n + 1), [(0, i, 1) for i in range(1, n + 1)])
    assert graph_search.solve(path(n)).index == chains.chain_length(n)
    if n <= 11:
        assert graph_search.solve(star).index == chains.chain_length(n)


@pytest.mark.parametrize("n", [2, 3, 31, 63, 64, 71, 127, 129, 191, 256])
def test_long_uniform_objects_have_their_chain(n):
    rng = random.Random(n)
    place = rng.sample(range(n + 3), n + 1)  # vertices and edges in any order, and two isolated atoms
    bonds = [(place[i], place[i + 1], 2) for i in range(n)]
    rng.shuffle(bonds)
    graph = Graph.of(["C"] * (n + 3), bonds)
    out = graph_search.solve(graph)
    assert out.index == chains.chain_length(n) == graph_search.replay(graph, out.steps)
    assert graph_search.solve(graph, compensate=True).index == out.index - 2
    for turned in (False, True):
        found = strings.solve("a" * n, turned)
        assert found.index == out.index == strings.replay("a" * n, found.steps, turned)


def test_uniform_paths_are_told_from_other_graphs():
    path = [(i, i + 1, 1) for i in range(5)]
    assert graph_search.uniform_path(Graph.of(["C"] * 6, path)) in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])
    others = [(["C"] * 5 + ["N"], path), (["C"] * 6, [*path[:4], (4, 5, 2)]), (["C"] * 6, [*path, (5, 0, 1)]), (["C"] * 7, [*path, (2, 6, 1)])]
    others += [(["C"] * 6, path[:2] + path[3:]), (["C"] * 9, [*path, (6, 7, 1), (7, 8, 1), (6, 8, 1)])]
    for labels, bonds in others:
        assert graph_search.uniform_path(Graph.of(labels, bonds)) is None


def test_components_and_compensation():
    triangles = Graph.of(["C"] * 6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)])
    assert graph_search.solve(triangles).index == 3 and graph_search.solve(triangles, compensate=True).index == 2
    assert graph_repair.repair(triangles).bound == 3 and graph_repair.repair(triangles, True).bound == 2
    pairs = Graph.of(["C", "C", "C", "C", "N"], [(0, 1, 1), (2, 3, 1)])
    assert pairs.components() == 3 and pairs.bonded_components() == 2
    assert graph_search.solve(pairs, compensate=True).index == -1 and graph_repair.repair(pairs, True).bound == 0
    empty = Graph([])
    assert graph_search.solve(empty).index == graph_search.solve(empty, compensate=True).index == -1
    assert graph_repair.repair(empty).bound == graph_repair.repair(Graph(["C"]), True).bound == 0
    assert graph_search.solve(path(1)).index == graph_repair.repair(path(1)).bound == 0


def test_graph_limits():
    rng = random.Random(5)
    graph = random_graph(rng, 9, 16)
    assert graph_search.solve(graph, enumeration_limit=5).enumeration_limit_reached
    none = graph_search.solve(graph, cpu_budget_ns=0)
    assert none.index == len(graph.edges) - 1 and none.runtime_limit_reached


def test_enumeration_goes_as_far_as_the_reference():
    assert graph_search.ENUMERATION_LIMIT == 50_000_000


def test_unique_classes_and_pathway():
    graph = Graph.of(["C", "C", "C", "N", "C"], [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 2)])
    assert graph.unique_edges() == [(2, 3), (3, 4)] and graphs.bits(graph.repeated_edges()) == [0, 1]
    document = graph_search.pathway(graph, graph_search.solve(graph).steps)
    assert document["removed_edges"] == [[2, 3], [3, 4]] and document["remnant"][0]["Edges"] == [[0, 1], [1, 2]]
    assert document["file_graph"][0]["EdgeColours"] == ["single", "single", "single", "double"]
    assert graph_search.colour(4) == "4"
    with pytest.raises(ValueError):
        graph_search.colour(0)


def test_mutated_graph_certificates_are_refused():
    good = graph_repair.repair(path(8)).certificate()
    bad = [good | {"upper_bound": 1}, good | {"schema": "x"}, good | {"components": 2}, good | {"rules": good["rules"][1:]}, good | {"residual": good["residual"][:-1]}, good | {"residual": good["residual"] * 2}]
    bad.append(good | {"rules": [good["rules"][0] | {"right_edges": good["rules"][0]["left_edges"]}, *good["rules"][1:]]})
    for c in bad:
        with pytest.raises(ValueError):
            graph_repair.replay(c)


def mol(atoms, bonds, head="  0  0  0  0  0  0  0  0999 V2000"):
    lines = ["name", "", "", f"{len(atoms):3d}{len(bonds):3d}{head}"]
    lines += [f"{0.0:10.4f}{0.0:10.4f}{0.0:10.4f} {a:<3} 0  0" for a in atoms]
    lines += [f"{u:3d}{v:3d}{x:3d}  0" for u, v, x in bonds]
    return "\n".join([*lines, "M  END", "> <junk>", "$$$$"])


def test_molfiles():
    graph = graphs.parse(mol(["C", "Cl", "H"], [(2, 1, 2), (1, 3, 1)]).encode(), "a.SDF")
    assert graph.labels == ["C", "Cl", "H"] and graph.edges == [(0, 1, 2), (0, 2, 1)]
    assert graph.without("H").labels == ["C", "Cl"] and graph.without("H").edges == [(0, 1, 2)]
    assert graphs.parse_molfile(mol(["C", "C"], [(1, 2, 1)]).replace("\n", "\r\n")).edges == [(0, 1, 1)]


@pytest.mark.parametrize(
    "content, what",
    [
        ("", "counts"),
        (mol(["C"], [], "  0  0 V3000"), "V2000"),
        (mol(["C", "C"], [(1, 1, 1)]), "self loop"),
        (mol(["C", "C"], [(1, 3, 1)]), "range"),
        (mol(["C", "C"], [(1, 2, 1), (2, 1, 1)]), "duplicate"),
        (mol(["C", "C"], [(1, 2, 0)]), "zero"),
        (mol(["C", "C"], [(1, 2, -1)]), "negative"),
        (mol(["", "C"], []), "symbol"),
        (mol(["C"], []).replace("  1  0", "  x  0"), "integer"),
        (mol(["C"], []).replace("  1  0", " -1  0"), "negative"),
        (mol(["C"], []).replace("  1  0", "  9  0"), "missing"),
        (mol(["C"], []).encode().replace(b" C ", b" \xff "), "UTF-8"),
    ],
)
def test_broken_molfiles(content, what):
    with pytest.raises(FormatError, match=what):
        graphs.parse(content, "x.mol")


def test_native_format():
    graph = graphs.parse("chain\n3\n1 2 +2 3\nC N C\n1 4\nignored\n")
    assert graph.labels == ["C", "N", "C"] and graph.edges == [(0, 1, 1), (1, 2, 4)]
    assert graphs.parse("none\n0\n\n\n\n").labels == []
    assert "0 C: 1(1)" in graphs.listing(graph)


@pytest.mark.parametrize("content, what", [("a", "missing"), ("a\n2\n1 2 1\nC C\n1", "partner"), ("a\n2\n1 2\nC\n1", "vertex labels"), ("a\n2\n1 2\nC C\n", "bond labels"), ("a\n2\n1 2\nC C\n0", "range"), ("a\n2\n1 2\nC C\n40000", "range"), ("a\n2\n1 x\nC C\n1", "integer"), ("a\n40000\n\n\n", "range"), ("a\n2\n1 1\nC C\n1", "self loop"), ("a\n2\n1 3\nC C\n1", "range"), ("a\n2 2\n1 2\nC C\n1", "one number")])
def test_broken_native_files(content, what):
    with pytest.raises(FormatError, match=what):
        graphs.parse(content)


def vector_chain(goal):
    """Shortest vector chain by trying all sets of sums."""
    units = frozenset(tuple(int(i == j) for j in range(len(goal))) for i in range(len(goal)))
    level, depth = {units}, 0
    while not any(goal in c for c in level):
        depth += 1
        level = {c | {s} for c in level for a in c for b in c if (s := tuple(x + y for x, y in zip(a, b, strict=True))) not in c and all(x <= y for x, y in zip(s, goal, strict=True))}
    return depth


@pytest.mark.parametrize("goal", [(1, 1), (2, 2), (2, 3), (1, 5), (2, 2, 2), (3, 4), (1, 2, 3), (5, 5)])
def test_refined_floor_is_exact_on_small_vectors(goal):
    assert chains.refined_vector_floor(goal, work=10**6) == vector_chain(goal)
    assert chains.vector_floor(goal) <= chains.refined_vector_floor(goal, work=5) <= vector_chain(goal)


def test_trails_cover_every_edge_once():
    from joinery.kernels import trails

    rng = random.Random(6)
    for _ in range(50):
        graph = random_graph(rng, 7, 9)
        paths = trails.trails(graph)
        assert sorted(i for p in paths for i in p) == list(range(len(graph.edges)))
        for p in paths:
            assert all(graph.touching[a] >> b & 1 for a, b in zip(p, p[1:], strict=False))
        assert trails.baseline(graph) <= len(graph.edges) - 1
    assert trails.baseline(path(8)) >= chains.chain_length(8) and trails.baseline(Graph([])) == 0


def test_path_positions():
    assert path(4).path_positions() == [0, 1, 2, 3]
    assert Graph.of(["C"] * 4, [(3, 1, 1), (1, 0, 1), (0, 2, 1)]).path_positions() == [1, 0, 2]
    assert Graph.of(["C"] * 3, [(0, 1, 1), (1, 2, 1), (0, 2, 1)]).path_positions() is None
    assert Graph.of(["C"] * 4, [(0, 1, 1), (2, 3, 1)]).path_positions() is None
