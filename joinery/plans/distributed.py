"""One hard object over the whole cluster: a row per first move, searched in rounds that share the best index.

The driver prepares the object and a Re-Pair bound. Jobs go out in rounds, those with the best bound first; after each
round the best index is collected, and jobs whose bound cannot beat it are dropped. Bounds only prune, so a round that
starts from an old index is still right. Jobs that spent their round's budget are cut into their own first moves and
queued again, so that no task holds a large part of the search alone. A state carries the moves that lead to it, so
the best index comes with a pathway that replays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import SparkSession

from joinery.kernels import graph_search, string_repair, strings
from joinery.kernels.canon import Canonizer
from joinery.kernels.chains import savings_bound
from joinery.kernels.graph_repair import repair as graph_repair
from joinery.kernels.graphs import Graph
from joinery.kernels.outcome import Budget, OutOfBudget
from joinery.runtime import ship

LOCAL_ROUND_NS = 500_000_000


@dataclass
class Distributed:
    index: int
    rounds: int = 0
    jobs: int = 0
    proven: bool = True
    #: Moves (kept, copy) that prove the index; None where it comes from a Re-Pair bound alone.
    steps: list | None = None
    best_by_round: list[int] = field(default_factory=list)


class _StringProblem:
    def __init__(self, text: str, accept_reversed: bool):
        self.text, self.reversed = text, accept_reversed

    def search(self, best: int, budget_ns: int | None) -> strings.Search:
        return strings.Search(self.text, self.reversed, Budget(budget_ns), best)

    def root(self):
        parts = tuple(strings.repeated_runs(self.text))
        return parts, max((n for _, n in parts), default=0), 0, ()

    def seed(self) -> tuple[int, list | None]:
        grammar = string_repair.repair(self.text, self.reversed)
        return grammar.bound, grammar.witness()

    def moves(self, state, best: int):
        """States after each first move, with the least index that they may reach; equivalent states once."""
        parts, longest, saved, path = state
        search, seen = self.search(best, None), set()
        for k, a, b in search.moves(parts, longest):
            child = strings.cut(parts, a, b)
            key = (tuple(sorted(string_repair.canonical(self.text[o : o + n], self.reversed) for o, n in child)), k)
            if key not in seen:
                seen.add(key)
                gain = saved + k - 1
                yield (child, k, gain, (*path, (a, b))), len(self.text) - 1 - gain - savings_bound([n for _, n in child], k)

    def explore(self, state, best: int, budget_ns: int | None) -> tuple[int, list | None, bool]:
        """Best index, the moves to it if it is better than `best`, and whether the search came to its end."""
        search = self.search(best, budget_ns)
        search.path = list(state[3])
        try:
            search.run(state[0], state[1], state[2])
        except OutOfBudget:
            return search.best, search.found, False
        return search.best, search.found, True


class _GraphProblem:
    def __init__(self, graph: Graph):
        self.graph = graph
        self.canon = Canonizer(graph)
        self.levels, self.limited = graph_search.enumerate_duplicates(self.canon, graph.repeated_edges())

    def search(self, best: int, budget_ns: int | None) -> graph_search.Search:
        return graph_search.Search(self.graph, self.canon, Budget(budget_ns), best)

    def root(self):
        return tuple(p for p in self.graph.split(self.graph.repeated_edges()) if p & (p - 1)), len(self.graph.edges), 0, ()

    def seed(self) -> tuple[int, list | None]:
        bound = graph_repair(self.graph, canonizer=self.canon).bound
        return bound, [] if bound == len(self.graph.edges) - 1 else None

    def moves(self, state, best: int):
        parts, longest, saved, path = state
        search, seen = self.search(best, None), set()
        for k, classes in search.start(self.levels, parts):
            for masks in classes if k <= longest else []:
                for i, a in enumerate(masks):
                    for b in masks[i + 1 :]:
                        if a & b:
                            continue
                        child = search.cut(parts, a, b)
                        key = (tuple(sorted(map(self.canon.code, child))), k)
                        if key not in seen:
                            seen.add(key)
                            gain = saved + k - 1
                            yield (child, k, gain, (*path, (a, b))), len(self.graph.edges) - 1 - gain - savings_bound([p.bit_count() for p in child], k)

    def explore(self, state, best: int, budget_ns: int | None) -> tuple[int, list | None, bool]:
        search = self.search(best, budget_ns)
        search.path = list(state[3])
        if search.trivial - state[2] < best:
            search.best, search.found = search.trivial - state[2], list(state[3])
        try:
            search.run(state[0], [level for level in search.start(self.levels, state[0]) if level[0] <= state[1]], state[2])
        except OutOfBudget:
            return search.best, search.found, False
        return search.best, search.found, True


def _explored(problem, best: int, budget_ns: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = best
        for batch in batches:
            out = []
            for job, state in zip(batch["job"], batch["state"], strict=True):
                found, steps, done = problem.explore(_unpacked(state), mine, budget_ns)
                mine = min(mine, found)
                out.append((job, found, None if steps is None else repr(steps), done))
            yield pd.DataFrame(out, columns=["job", "found", "steps", "done"])

    return run


def _unpacked(text: str):
    import ast

    return ast.literal_eval(text)


def search(spark: SparkSession, problem, slots: int | None = None, mode: str = "auto", max_rounds: int | None = None, with_pathway: bool = False) -> Distributed:
    """mode: local searches on the driver; auto does so until LOCAL_ROUND_NS are spent, then goes out; distributed goes out at once.

    with_pathway: where the Re-Pair bound has no moves of its own, go on until moves prove as good an index.
    """
    seed, steps = problem.seed()
    best = seed + (with_pathway and steps is None)
    out = Distributed(seed, steps=steps)

    def better(found: int, steps: list | None) -> None:
        nonlocal best
        if steps is not None and found < best:
            best, out.index, out.steps = found, found, steps

    if mode != "distributed":
        found, steps, done = problem.explore(problem.root(), best, None if mode == "local" else LOCAL_ROUND_NS)
        better(found, steps)
        if done:
            return out
    ship(spark)
    slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    queue = sorted(problem.moves(problem.root(), best), key=lambda j: j[1])
    budget = LOCAL_ROUND_NS
    while queue:
        queue = [(s, low) for s, low in queue if low < best]
        now, queue = queue[: 8 * slots], queue[8 * slots :]
        if not now:
            break
        if max_rounds is not None and out.rounds >= max_rounds:
            out.proven = False
            break
        jobs = spark.createDataFrame([(i, repr(s)) for i, (s, _) in enumerate(now)], "job int, state string").repartition(min(len(now), 4 * slots), "job")
        told = jobs.mapInPandas(_explored(problem, best, budget), "job int, found int, steps string, done boolean").collect()
        for r in told:
            better(r["found"], r["steps"] and _unpacked(r["steps"]))
        out.rounds, out.jobs = out.rounds + 1, out.jobs + len(now)
        out.best_by_round.append(out.index)
        for r in told:
            if not r["done"]:
                queue += list(problem.moves(now[r["job"]][0], best))
        queue.sort(key=lambda j: j[1])
        budget *= 2
    return out


def search_string(spark: SparkSession, text: str, accept_reversed: bool = False, **how) -> Distributed:
    if len(text) < 2:
        return Distributed(len(text) - 1, steps=[])
    return search(spark, _StringProblem(text, accept_reversed), **how)


def search_graph(spark: SparkSession, graph: Graph, compensate: bool = False, **how) -> Distributed:
    less = graph_search.compensation(graph, compensate)
    if len(graph.edges) < 2:
        return Distributed(len(graph.edges) - 1 - less, steps=[])
    problem = _GraphProblem(graph)
    out = search(spark, problem, **how)
    out.index -= less
    out.proven &= not problem.limited
    return out
