"""Labelled undirected simple graphs: model, text formats, preparation."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

LARGEST = 32767


class FormatError(ValueError):
    """What is wrong with a graph file."""


@dataclass
class Graph:
    """Vertex labels, and edges (u, v, label) with u < v, by u and then in order of the input."""

    labels: list[str]
    edges: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, labels: list[str], bonds: list[tuple[int, int, int]]) -> Graph:
        return cls(list(labels), sorted(((min(u, v), max(u, v), x) for u, v, x in bonds), key=lambda e: e[0]))

    @cached_property
    def touching(self) -> list[int]:
        """For each edge, the mask of the edges that share a vertex with it."""
        at = [0] * len(self.labels)
        for i, (u, v, _) in enumerate(self.edges):
            at[u] |= 1 << i
            at[v] |= 1 << i
        return [(at[u] | at[v]) & ~(1 << i) for i, (u, v, _) in enumerate(self.edges)]

    def bond_class(self, i: int) -> tuple[str, str, int]:
        u, v, label = self.edges[i]
        return (*sorted((self.labels[u], self.labels[v])), label)

    def without(self, label: str) -> Graph:
        """The graph without the vertices of this label and their edges; the others keep their order."""
        keep = [i for i, x in enumerate(self.labels) if x != label]
        place = {old: new for new, old in enumerate(keep)}
        return Graph([self.labels[i] for i in keep], [(place[u], place[v], x) for u, v, x in self.edges if u in place and v in place])

    def components(self) -> int:
        """Connected components, isolated vertices included."""
        root = list(range(len(self.labels)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for u, v, _ in self.edges:
            root[find(u)] = find(v)
        return sum(find(i) == i for i in range(len(root)))

    def bonded_components(self) -> int:
        """Connected components that have an edge."""
        bonded = {x for u, v, _ in self.edges for x in (u, v)}
        return self.components() - (len(self.labels) - len(bonded))

    def repeated_edges(self) -> int:
        """Mask of the edges whose class occurs at least twice; no other edge can be in a duplicate."""
        count = Counter(map(self.bond_class, range(len(self.edges))))
        return sum(1 << i for i in range(len(self.edges)) if count[self.bond_class(i)] > 1)

    def unique_edges(self) -> list[tuple[int, int]]:
        keep = self.repeated_edges()
        return sorted((u, v) for i, (u, v, _) in enumerate(self.edges) if not keep >> i & 1)

    def path_positions(self) -> list[int] | None:
        """Place of each edge along the graph, if its edges form one path, counted from the lesser end; else None."""
        near: dict[int, list[int]] = {}
        for i, (u, v, _) in enumerate(self.edges):
            near.setdefault(u, []).append(i)
            near.setdefault(v, []).append(i)
        ends = sorted(v for v, e in near.items() if len(e) == 1)
        if len(ends) != 2 or any(len(e) > 2 for e in near.values()):
            return None
        at, last, place = ends[0], -1, [-1] * len(self.edges)
        for step in range(len(self.edges)):
            ahead = [i for i in near[at] if i != last]
            if not ahead:
                return None
            last = ahead[0]
            place[last] = step
            at = sum(self.edges[last][:2]) - at
        return place

    def split(self, mask: int) -> list[int]:
        """Connected pieces of an edge set."""
        out = []
        while mask:
            piece = front = mask & -mask
            while front:
                near = 0
                while front:
                    low = front & -front
                    near |= self.touching[low.bit_length() - 1]
                    front ^= low
                front = near & mask & ~piece
                piece |= front
            out.append(piece)
            mask &= ~piece
        return out


def bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def _integer(text: str, what: str) -> int:
    body = text[1:] if text[:1] == "+" else text
    if not body.lstrip("-").isascii() or not body.removeprefix("-").isdigit():
        raise FormatError(f"{what} is not an integer")
    return int(body)


def checked(labels: list[str], bonds: list[tuple[int, int, int]]) -> Graph:
    """The graph, if it is a simple one with positive bond labels; FormatError names what is wrong."""
    pairs, degree = set(), Counter()
    for u, v, label in bonds:
        if not (0 <= u < len(labels) and 0 <= v < len(labels)):
            raise FormatError("endpoint out of range")
        if u == v:
            raise FormatError("self loop")
        if (pair := (min(u, v), max(u, v))) in pairs:
            raise FormatError("duplicate bond")
        pairs.add(pair)
        if label < 0:
            raise FormatError("negative bond order")
        if label == 0:
            raise FormatError("zero bond order")
        degree.update(pair)
    if max(degree.values(), default=0) > LARGEST + 1:
        raise FormatError("vertex degree too large")
    return Graph.of(labels, bonds)


def _decoded(content: bytes | str) -> str:
    if isinstance(content, str):
        return content
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise FormatError("invalid UTF-8") from e


def parse_molfile(content: bytes | str) -> Graph:
    """First record of a V2000 molfile or SDF: three header lines, a counts line, atoms, bonds; the rest is ignored."""
    data = content.encode("utf-8", "surrogateescape") if isinstance(content, str) else content
    lines = [x.removesuffix(b"\r") for x in data.split(b"\n")]

    def cell(line: bytes, at: int, what: str) -> int:
        if len(line) < at + 3:
            raise FormatError(f"{what} field is too short")
        text = line[at : at + 3].strip(b" ")
        try:
            return _integer(text.decode("ascii"), what)
        except UnicodeDecodeError as e:
            raise FormatError(f"{what} is not an integer") from e

    if len(lines) < 4:
        raise FormatError("missing counts line")
    head = lines[3]
    if len(head) < 39 or head[34:39] != b"V2000":
        raise FormatError("counts line is not V2000")
    n, m = cell(head, 0, "atom count"), cell(head, 3, "bond count")
    if n < 0 or m < 0:
        raise FormatError("negative count")
    if len(lines) < 4 + n + m:
        raise FormatError("missing atom or bond line")
    labels = []
    for line in lines[4 : 4 + n]:
        symbol = line[31:34].strip(b" ")
        if not symbol:
            raise FormatError("missing atom symbol")
        labels.append(_decoded(symbol))
    bonds = [(cell(x, 0, "bond endpoint") - 1, cell(x, 3, "bond endpoint") - 1, cell(x, 6, "bond order")) for x in lines[4 + n : 4 + n + m]]
    return checked(labels, bonds)


def parse_native(content: bytes | str) -> Graph:
    """Five lines: name, vertex count, one-based endpoint pairs, vertex labels, edge labels; the rest is ignored."""
    data = content.encode("utf-8", "surrogateescape") if isinstance(content, str) else content
    lines = [x.removesuffix(b"\r") for x in data.split(b"\n")]
    if lines and not lines[-1]:
        lines.pop()
    if len(lines) < 3:
        raise FormatError("missing line")
    lines += [b""] * (5 - len(lines))
    size, ends, names, orders = (_decoded(x).split() for x in lines[1:5])
    if len(size) != 1:
        raise FormatError("vertex count line needs one number")
    n = _integer(size[0], "vertex count")
    if not 0 <= n <= LARGEST:
        raise FormatError("vertex count out of range")
    points = [_integer(x, "endpoint") for x in ends]
    if len(points) % 2:
        raise FormatError("endpoint without partner")
    if len(names) != n:
        raise FormatError("wrong number of vertex labels")
    if len(orders) != len(points) // 2:
        raise FormatError("wrong number of bond labels")
    labels = [_integer(x, "bond label") for x in orders]
    if any(not 1 <= x <= LARGEST for x in labels):
        raise FormatError("bond label out of range")
    return checked(names, [(u - 1, v - 1, x) for u, v, x in zip(points[::2], points[1::2], labels, strict=True)])


def is_molfile(path: str) -> bool:
    return path[-4:].lower() in (".mol", ".sdf")


def parse(content: bytes | str, path: str = "") -> Graph:
    return parse_molfile(content) if is_molfile(path) else parse_native(content)


def listing(graph: Graph) -> str:
    """Adjacency listing for people."""
    near: dict[int, list[str]] = {i: [] for i in range(len(graph.labels))}
    for u, v, x in graph.edges:
        near[u].append(f"{v}({x})")
        near[v].append(f"{u}({x})")
    return "\n".join(f"{i} {graph.labels[i]}: {' '.join(near[i])}".rstrip() for i in near)
