"""Exact canonical forms of labelled graphs: equal codes if and only if the graphs are isomorphic."""

from __future__ import annotations

from joinery.kernels.graphs import Graph, bits


class Canonizer:
    """Codes of edge sets of one graph, remembered by mask. Codes of different graphs can be compared."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.known: dict[int, str] = {}

    def code(self, mask: int) -> str:
        found = self.known.get(mask)
        if found is None:
            found = self.known[mask] = self._code(mask)
        return found

    def _code(self, mask: int) -> str:
        near: dict[int, dict[int, int]] = {}
        for i in bits(mask):
            u, v, x = self.graph.edges[i]
            near.setdefault(u, {})[v] = x
            near.setdefault(v, {})[u] = x
        count = mask.bit_count()
        if len(near) == count + 1:
            return f"T{self._tree(near)}"
        return f"G{self._general(near)}"

    def _tree(self, near: dict[int, dict[int, int]]) -> str:
        """Peel leaves to the centre; a vertex's code is its label and its children's, each with its edge."""
        labels = self.graph.labels
        degree = {v: len(n) for v, n in near.items()}
        below: dict[int, list[str]] = {v: [] for v in near}
        layer, left, gone = [v for v, d in degree.items() if d == 1], len(near), set()

        def sealed(v: int) -> str:
            return f"({labels[v]!r}{''.join(sorted(below[v]))})"

        while left > 2:
            nxt = []
            for v in layer:
                gone.add(v)
                left -= 1
                for u, x in near[v].items():
                    if u not in gone:
                        below[u].append(f"{x}{sealed(v)}")
                        degree[u] -= 1
                        if degree[u] == 1:
                            nxt.append(u)
            layer = nxt
        centre = [v for v in near if v not in gone]
        if len(centre) == 1:
            return sealed(centre[0])
        a, b = centre
        return f"{near[a][b]}" + "".join(sorted((sealed(a), sealed(b))))

    def _general(self, near: dict[int, dict[int, int]]) -> str:
        """Refine colours until they are stable; single out each vertex of the smallest open cell; least code wins."""
        order = sorted({self.graph.labels[v] for v in near})
        colour = {v: order.index(self.graph.labels[v]) for v in near}
        best: list[str | None] = [None]

        def refine(colour: dict[int, int]) -> dict[int, int]:
            cells = len(set(colour.values()))
            while True:
                sign = {v: (colour[v], tuple(sorted((colour[u], x) for u, x in near[v].items()))) for v in near}
                rank = {s: i for i, s in enumerate(sorted(set(sign.values())))}
                colour = {v: rank[sign[v]] for v in near}
                if len(rank) == cells:
                    return colour
                cells = len(rank)

        def visit(colour: dict[int, int]) -> None:
            colour = refine(colour)
            cells: dict[int, list[int]] = {}
            for v, c in colour.items():
                cells.setdefault(c, []).append(v)
            open_ = [(len(m), c) for c, m in cells.items() if len(m) > 1]
            if not open_:
                at = {v: c for v, c in colour.items()}
                rows = sorted((at[u], at[v], x) for u in near for v, x in near[u].items() if at[u] < at[v])
                code = f"{[self.graph.labels[v] for v in sorted(near, key=at.get)]!r}{rows!r}"
                if best[0] is None or code < best[0]:
                    best[0] = code
                return
            _, cell = min(open_)
            for v in cells[cell]:
                visit({u: 2 * c + (c == cell and u != v) for u, c in colour.items()})

        visit(colour)
        return best[0]
