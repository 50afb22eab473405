"""Substrings of one text that recur, by prefix doubling on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _numbered(keys: np.ndarray, most: int) -> np.ndarray:
    """Equal keys (0 to most - 1) get equal numbers, dense from 0."""
    if most > 4 * len(keys):
        return np.unique(keys, return_inverse=True)[1]
    there = np.zeros(most, bool)
    there[keys] = True
    return (np.cumsum(there) - 1)[keys]


def recurring(text: str, accept_reversed: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, n, first, last) for sizes 2, 4, 8, ...: places, first and last place of each substring of that size that occurs twice or more.

    With accept_reversed a substring also recurs where its reversal stands. A place goes on to the next size if its class recurs, or is
    its own reversal: such a place can be the middle of a longer text and of its reversal.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    name = back = np.unique(codes, return_inverse=True)[1]
    pos, size = np.arange(len(codes)), 1
    while len(pos):
        row = np.full(len(codes) + size, -1)
        row[pos] = np.arange(len(pos))
        right = row[pos + size]
        left = np.flatnonzero(right >= 0)
        if not len(left):
            return
        right, most = right[left], int(max(name.max(), back.max())) + 1
        stands = name[left] * most + name[right]
        turned = back[right] * most + back[left] if accept_reversed else stands[:0]
        both = _numbered(np.concatenate([stands, turned]), most * most)
        pos, size = pos[left], size * 2
        name, back = (both[: len(pos)], both[len(pos) :]) if accept_reversed else (both, both)
        kind = np.minimum(name, back)
        n = np.bincount(kind)
        first, last = np.zeros_like(n), np.zeros_like(n)
        first[kind[::-1]], last[kind] = pos[::-1], pos
        if len(often := np.flatnonzero(n > 1)):
            yield size, n[often], first[often], last[often]
        keep = n[kind] > 1
        if accept_reversed:
            keep |= name == back
        name, back, pos = name[keep], back[keep], pos[keep]
