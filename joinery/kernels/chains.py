"""Addition chains: certified lower bounds on constructions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from itertools import pairwise

EXACT_UP_TO = 256


def ceil_log2(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


@lru_cache(maxsize=None)
def chain_length(n: int) -> int:
    """Length of the shortest addition chain for n (exact up to EXACT_UP_TO, ceil(log2 n) beyond)."""
    if n < 1:
        raise ValueError("addition chains start at 1")
    return ceil_log2(n) if n > EXACT_UP_TO else len(shortest_chain(n)) - 1


@lru_cache(maxsize=None)
def shortest_chain(n: int) -> tuple[int, ...]:
    """A shortest addition chain for n up to EXACT_UP_TO that adds its last entry in every step."""
    depth = ceil_log2(n)
    while not (chain := _reaching((1,), n, depth)):
        depth += 1
    return chain


def _reaching(chain: tuple[int, ...], goal: int, steps: int) -> tuple[int, ...] | None:
    """The chain with up to `steps` more sums to goal; below 12509 some shortest chain adds its last entry in every step."""
    last = chain[-1]
    if last == goal:
        return chain
    if not steps or last << steps < goal:
        return None
    return next(filter(None, (_reaching((*chain, last + x), goal, steps - 1) for x in reversed(chain) if last + x <= goal)), None)


def uniform_moves(n: int) -> list[tuple[int, int]]:
    """(size, place) of the copies that build n equal units in a row in chain_length(n) joins, longest first.

    Each is a copy of the first `size` units: every entry of the chain is a front piece, the next one adds a shorter front piece.
    """
    return sorted(((b - a, a) for a, b in pairwise(shortest_chain(n)) if b - a > 1), reverse=True)


def vector_floor(counts: Iterable[int]) -> int:
    """Joins that any object with these primitive counts needs at least: by total, by coordinate, by support."""
    counts = [c for c in counts if c]
    if not counts:
        return 0
    support = len(counts) - (max(counts) == 1)
    return max(support, chain_length(sum(counts)), *map(chain_length, counts))


def packing_bound(n: int, k: int) -> int:
    """Most joins that reuse of parts of up to k units saves on n units."""
    return n - -(-n // k)


def eligible_packing_bound(n: int, k: int, eligible: int) -> int:
    """As packing_bound, where only `eligible` of the units can lie in parts of size k; other parts are smaller."""
    large = eligible // k
    return n - large - -(-(n - large * k) // (k - 1))


def savings_bound(sizes: Iterable[int], largest: int) -> int:
    """Most joins that further reuse of parts of 2..largest units saves on fragments of these sizes together.

    A plan whose largest part has k units cuts each fragment into at least ceil(n / k) pieces and builds that part by
    at least chain_length(k) joins.
    """
    sizes = list(sizes)
    return max([0, *(sum(packing_bound(n, k) for n in sizes) - chain_length(k) for k in range(2, largest + 1))])


def refined_vector_floor(counts: Iterable[int], work: int = 4000, most: int = 16, enough: int | None = None) -> int:
    """vector_floor, raised while an exhaustive search rules out chains of that length.

    Only for totals up to `most`; `work` bounds the sums tried, over all depths. A depth that was cut short raises
    nothing, so any result is a certified floor; it may depend on `work`. enough: no need to go beyond.
    """
    goal = tuple(sorted(c for c in counts if c))
    floor, total = vector_floor(goal), sum(goal)
    if len(goal) < 2 or total > most:
        return floor
    left = [work]
    units = tuple(tuple(int(i == j) for j in range(len(goal))) for i in range(len(goal)))

    def reaches(chain: tuple, steps: int) -> bool | None:
        if chain[-1] == goal:
            return True
        if not steps:
            return False
        cut = False
        for i, a in enumerate(chain):
            for b in chain[i:]:
                left[0] -= 1
                if left[0] < 0:
                    return None
                new = tuple(x + y for x, y in zip(a, b, strict=True))
                if new in chain or any(x > y for x, y in zip(new, goal, strict=True)):
                    continue
                if steps == 1 and new != goal:
                    continue
                # sums in an order that never steps back, since the order of independent sums does not matter
                if len(chain) > len(units) and (sum(new), new) <= (sum(chain[-1]), chain[-1]):
                    continue
                found = reaches((*chain, new), steps - 1)
                if found:
                    return True
                cut |= found is None
        return None if cut else False

    while floor < total - 1 and (enough is None or floor < enough):
        if reaches(units, floor) is not False:
            break
        floor += 1
    return floor
