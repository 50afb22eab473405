"""A simple baseline for graph Re-Pair: cut a graph into trails and run Re-Pair on their labels."""

from __future__ import annotations

from collections import Counter

from joinery.kernels.graphs import Graph


def trails(graph: Graph) -> list[list[int]]:
    """The edges as vertex-simple paths: from the least free end (odd degree first), always along the least edge."""
    free: dict[int, set[int]] = {}
    for i, (u, v, _) in enumerate(graph.edges):
        free.setdefault(u, set()).add(i)
        free.setdefault(v, set()).add(i)
    out = []
    while any(free.values()):
        at = min((v for v in free if free[v]), key=lambda v: (len(free[v]) % 2 == 0, v))
        seen, path = {at}, []
        while True:
            ahead = [i for i in sorted(free[at]) if (graph.edges[i][0] + graph.edges[i][1] - at) not in seen]
            if not ahead:
                break
            i = ahead[0]
            u, v, _ = graph.edges[i]
            free[u].discard(i)
            free[v].discard(i)
            at = u + v - at
            seen.add(at)
            path.append(i)
        out.append(path)
    return out


def baseline(graph: Graph) -> int:
    """Joins of a grammar over trails: repeated neighbours of equal label (and direction) become one rule, most frequent first."""
    rows = [[graph.bond_class(i) for i in path] for path in trails(graph)]
    tokens = [[(c,) for c in row] for row in rows]
    rules = 0
    while True:
        count: Counter = Counter()
        for row in tokens:
            last = None
            for i in range(len(row) - 1):
                pair = row[i] + row[i + 1]
                if last == (i - 1, pair):
                    last = None
                    continue
                count[row[i], row[i + 1]] += 1
                last = (i, pair)
        if not count:
            break
        (a, b), n = max(count.items(), key=lambda x: (x[1], repr(x[0])))
        if n < 2:
            break
        rules += 1
        for row in tokens:
            i = 0
            while i < len(row) - 1:
                if row[i] == a and row[i + 1] == b:
                    row[i : i + 2] = [a + b]
                i += 1
    return rules + sum(map(len, tokens)) - 1 if graph.edges else 0
