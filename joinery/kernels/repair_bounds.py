"""Re-Pair of many texts side by side: each step of every text is a step of array operations over all of them.

It joins what string_repair.repair() joins and counts rules and fragments only, so it has no certificate. Pairs are known by a hash of
their joined text; before a pair is joined its text is compared with that of its rule, and a text where two differ is told, not guessed.
Texts that share a hash can only make a group look better than it is, so a group that is wrongly passed over is impossible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places of a block: what is best in a block is looked up, not searched for.
BLOCK = 32
#: Pairs that enter their groups at once at the start.
AT_ONCE = 1 << 16
#: Symbols that are worked on side by side; a longer text goes alone.
SYMBOLS = 1 << 21
#: A step costs about as much for one text as for some: so many times the longest text's symbols make it worth while.
LONGEST = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.int64(32)
_LOW = np.int64((1 << 32) - 1)
#: Symbol of a token that is no more: no character's, which are from -1 down, and no rule's, from 0 on.
_GONE = np.int32(-(1 << 31))
_TRUE = np.ones(1, bool)
#: Numbers of texts that are worked on side by side.
_TEXTS = np.uint64((1 << 16) - 1)
_OF_GROUPS = ("count", "bound", "first", "start", "size", "rep", "length", "left_side", "right_side", "known", "seen")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit words over all words, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    end = np.cumsum(size)
    out = np.ones(end[-1] if len(end) else 0, np.int64)
    here = size > 0
    start, size, end = start[here], size[here], end[here]
    if len(start):
        out[0] = start[0]
        out[end[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(out)


def _more(a: np.ndarray, size: int) -> np.ndarray:
    """a with room for so many."""
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class _Names:
    """Hashes numbered from 0, as they come."""

    def __init__(self, room: int):
        self.bits = max(8, int(2 * room).bit_length())
        self.hash, self.name, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def of(self, h: np.ndarray) -> np.ndarray:
        """The numbers of hashes (none is 0), of new ones those from n on."""
        if 10 * (self.n + len(h)) > 7 << self.bits:
            held = self.hash != 0
            h0, name = self.hash[held], self.name[held]
            self.bits = int(2 * (self.n + len(h))).bit_length() + 1
            self.hash, self.name = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(h0, name)
        return self._put(h, None)

    def _put(self, h: np.ndarray, names: np.ndarray | None) -> np.ndarray:
        out, left = np.empty(len(h), np.int64), np.arange(len(h))
        slot, last = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(left):
            free = (self.hash.take(slot) == 0).nonzero()[0]
            if len(free):
                at, mine, who = slot.take(free), h.take(free), left.take(free)
                self.hash[at] = mine
                won = self.hash.take(at) == mine
                if not won.all():
                    at, who = at[won], who[won]
                self.name[at] = who
                one = self.name.take(at) == who  # of equal hashes one gets the number
                if not one.all():
                    at, who = at[one], who[one]
                self.name[at] = np.arange(self.n, self.n + len(at)) if names is None else names[who]
                self.n += 0 if names is not None else len(at)
            met = self.hash.take(slot) == h
            if met.all():
                out[left] = self.name.take(slot)
                break
            out[left[met]] = self.name.take(slot[met])
            rest = (~met).nonzero()[0]
            left, slot, h = left.take(rest), (slot.take(rest) + 1) & last, h.take(rest)
        return out


class _Texts:
    """Texts one after another, each from a block's start; a token is named by its first place.

    A group holds the places of pairs of one joined text, ascending, as a range of `pool` in which places that left it are passed
    over. `bound` is its saving or, where its pairs may share tokens, no less. A group that may save anything shows its bound at
    its first place in `shown`, and a block its best in `best`: bound, then the earliest place.
    """

    def __init__(self, texts: list[str], accept_reversed: bool):
        size = np.array([len(t) for t in texts], np.int64)
        blocks = -(-size // BLOCK)
        self.block = np.concatenate([[0], np.cumsum(blocks)])
        n, self.reversed = int(self.block[-1]) * BLOCK, accept_reversed
        places = _ranges(self.block[:-1] * BLOCK, size)
        self.text = np.zeros(n, np.uint32)
        self.text[places] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.rules, self.left, self.told = np.zeros(len(texts), np.int64), size.copy(), np.zeros(len(texts), bool)

        self.next, self.prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        there = size > 0
        first, end = self.block[:-1][there] * BLOCK, self.block[:-1][there] * BLOCK + size[there]
        self.prev[first], self.next[end - 1] = -1, -1
        self.end = np.arange(1, n + 1, dtype=np.int32)
        self.symbol = -1 - self.text.astype(np.int32)

        value, up, self.down = _mixed(self.text + _ODD), _powers(int(_ODD), n), _powers(pow(int(_ODD), -1, 1 << 64), n)
        self.forward = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up)])
        if accept_reversed:
            self.up, self.backward = up, np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.down)])
        self.number = np.repeat(np.arange(1, len(texts) + 1, dtype=np.uint64), blocks)
        self.seed = _mixed(self.number)

        self.key, self.shown = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.best, self.mark = np.zeros(n // BLOCK, np.int64), np.zeros(n // BLOCK, np.int32)
        room = n // 2 + 1
        self.names = _Names(room)
        for name in _OF_GROUPS:
            setattr(self, name, np.zeros(room, bool if name == "known" else np.int32))
        self.pool, self.used = np.zeros(n, np.int32), 0
        self.touched: list[np.ndarray] = []
        pairs = places[self.next[places] >= 0]
        for i in range(0, len(pairs), AT_ONCE):
            self._enter(pairs[i : i + AT_ONCE])
        self._refresh()

    def _hash(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of what stands from at to end: bits of a hash above the text's number, so that texts share no group."""
        h = (self.forward.take(end) - self.forward.take(at)) * self.down.take(at)
        if self.reversed:
            h = np.minimum(h, (self.backward.take(end) - self.backward.take(at)) * self.up.take(end - 1))
        block = at // BLOCK
        return (_mixed(h ^ self.seed.take(block)) & ~_TEXTS) | self.number.take(block)

    def _show(self, at: np.ndarray, bound) -> None:
        self.shown[at] = bound
        self.touched.append(at)

    def _once(self, groups: np.ndarray) -> np.ndarray:
        """Each group one time."""
        i = np.arange(len(groups))
        self.seen[groups] = i
        return groups[self.seen.take(groups) == i]

    def _members(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of groups, and the group of each by its number in `groups`."""
        size = self.size.take(groups).astype(np.int64)
        at = self.pool.take(_ranges(self.start.take(groups).astype(np.int64), size)).astype(np.int64)
        which = np.repeat(np.arange(len(groups)), size)
        in_it = self.key.take(at) == groups.take(which)
        return (at, which) if in_it.all() else (at[in_it], which[in_it])

    def _enter(self, at: np.ndarray) -> None:
        """Pairs at these places join the groups of their texts."""
        if not len(at):
            return
        right, before = self.next.take(at).astype(np.int64), self.names.n
        end = self.end.take(right).astype(np.int64)
        group = self.names.of(self._hash(at, end))
        self._make_room(self.names.n)
        new = (group >= before).nonzero()[0]
        g = group.take(new)
        self.rep[g] = new
        one = new[self.rep.take(g) == new]  # of several pairs of a new group one stands for it
        g, p = group.take(one), at.take(one)
        self.rep[g], self.length[g] = p, end.take(one) - p
        self.left_side[g], self.right_side[g] = self.symbol.take(p), self.symbol.take(right.take(one))

        all_ = (group << _HIGH) | at
        if len(new) < len(group):
            old = group[group < before]
            old = self._once(old[self.count.take(old) > 0])
            if len(old):
                self._show(self.first.take(old[self.bound.take(old) > 0]).astype(np.int64), 0)
                here, which = self._members(old)
                all_ = np.concatenate([all_, (old.take(which) << _HIGH) | here])
        self.key[at] = group
        all_.sort()
        group, place = all_ >> _HIGH, all_ & _LOW
        begin = np.concatenate([_TRUE, group[1:] != group[:-1]]).nonzero()[0]
        group, size, first = group.take(begin), np.diff(np.append(begin, len(place))), place.take(begin)
        self.pool = _more(self.pool, self.used + len(place))
        self.pool[self.used : self.used + len(place)] = place
        self.start[group], self.size[group], self.count[group] = self.used + begin, size, size
        self.used += len(place)
        bound = size - ~self.known.take(group)
        self.first[group], self.bound[group] = first, bound
        saves = (bound > 0).nonzero()[0]
        self._show(first.take(saves), bound.take(saves))

    def _make_room(self, groups: int) -> None:
        for name in _OF_GROUPS:
            setattr(self, name, _more(getattr(self, name), groups))

    def _leave(self, at: np.ndarray) -> None:
        """Pairs at these places leave their groups."""
        group = self.key.take(at).astype(np.int64)
        self.key[at] = -1
        np.subtract.at(self.count, group, np.int32(1))
        was = self.bound.take(group) > 0
        group = self._once(group[was])
        first, bound = self.first.take(group).astype(np.int64), np.minimum(self.bound.take(group), self.count.take(group) - ~self.known.take(group))
        self.bound[group] = bound
        gone = self.key.take(first) != group
        self._show(first, np.where(gone, 0, np.maximum(bound, 0)))
        late = group[gone & (bound > 0)]
        if len(late):
            here, which = self._members(late)
            here = here[np.concatenate([_TRUE, which[1:] != which[:-1]])]
            self.first[late] = here
            self._show(here, self.bound.take(late))

    def _refresh(self) -> None:
        """The best of blocks whose places show something else."""
        if self.touched:
            block = np.concatenate(self.touched) // BLOCK
            self.touched = []
            i = np.arange(len(block))
            self.mark[block] = i
            block = block[self.mark.take(block) == i]
            rows = self.shown.reshape(-1, BLOCK).take(block, axis=0)
            at = rows.argmax(axis=1) + block * BLOCK
            self.best[block] = (self.shown.take(at).astype(np.int64) << _HIGH) | (_LOW - at)

    def _same(self, at: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether pairs spell their group's text."""
        length = self.length.take(group)
        same = self.end.take(right) - at == length
        if not self.reversed:
            asked = (same & ((self.symbol.take(at) != self.left_side.take(group)) | (self.symbol.take(right) != self.right_side.take(group)))).nonzero()[0]
        else:
            asked = same.nonzero()[0]
        if len(asked):
            at, rep, length = at.take(asked), self.rep.take(group.take(asked)).astype(np.int64), length.take(asked).astype(np.int64)
            begin, here = np.cumsum(length) - length, _ranges(at, length)
            there = self.text.take(_ranges(rep, length))
            alike = np.logical_and.reduceat(there == self.text.take(here), begin)
            if self.reversed:
                back = np.repeat(2 * at + length - 1, length) - here
                alike |= np.logical_and.reduceat(there == self.text.take(back), begin)
            same[asked] = alike
        return same

    def run(self) -> None:
        active = (self.left > 1).nonzero()[0]
        while len(active):
            most = len(active)
            blocks = (self.block[active + 1] - self.block[active]).astype(np.int64)
            where, begin = _ranges(self.block[active], blocks), np.cumsum(blocks) - blocks
            going = np.ones(most, bool)
            while 2 * np.count_nonzero(going) > most:
                best = np.maximum.reduceat(self.best[where], begin)
                going &= best >> _HIGH > 0
                self._step(active[going], best[going])
            active = active[going]

    def _step(self, texts: np.ndarray, best: np.ndarray) -> None:
        """One step of each of these texts, from its best group."""
        if not len(texts):
            return
        place = _LOW - (best & _LOW)
        group = self.key.take(place).astype(np.int64)
        at, which = self._members(group)
        shared = np.concatenate([~_TRUE, self.next.take(at[:-1]) == at[1:]])
        if shared.any():
            i = np.arange(len(at))
            taken = (i - np.maximum.accumulate(np.where(shared, 0, i))) % 2 == 0
            at, which = at[taken], which[taken]
        new = ~self.known.take(group)
        exact = np.bincount(which, minlength=len(texts)) - new
        done = exact == self.bound.take(group)
        if not done.all():
            # pairs share tokens: the group shows what it saves and is weighed anew
            lower = group[~done]
            self.bound[lower] = exact[~done]
            self._show(place[~done], np.maximum(exact[~done], 0))
            kept = done[which]
            at, which = at[kept], which[kept]
        right = self.next.take(at).astype(np.int64)
        same = self._same(at, right, group.take(which))
        if not same.all():
            wrong = np.unique(which[~same])
            self.told[texts[wrong]] = True
            for t in texts[wrong]:
                self.shown[self.block[t] * BLOCK : self.block[t + 1] * BLOCK] = 0
                self.best[self.block[t] : self.block[t + 1]] = 0
            done[wrong] = False
            kept = done[which]
            at, which, right = at[kept], which[kept], right[kept]
        if len(at):
            which_group = group.take(which)
            if not done.all():
                group, texts, new, place, exact = group[done], texts[done], new[done], place[done], exact[done]
            self.rules[texts] += new
            self.left[texts] -= exact + new
            self._show(place, 0)
            self.known[group], self.bound[group] = True, 0
            self._join(at, right, which_group)
        self._refresh()

    def _join(self, at: np.ndarray, right: np.ndarray, group: np.ndarray) -> None:
        left, after = self.prev.take(at).astype(np.int64), self.next.take(right).astype(np.int64)
        # a joined pair's right token is the left neighbour of the next one where they stand together
        self.symbol[right] = _GONE
        left = left[left >= 0]
        left = left[self.symbol.take(left) != _GONE]
        followed = after >= 0
        self.next[at], self.end[at], self.symbol[at] = after, self.end.take(right), group
        self._leave(np.concatenate([left, at, right[followed]]))
        at = at[followed]
        self.prev[after[followed]] = at
        self._enter(np.concatenate([left, at]))


def counted(texts: list[str], accept_reversed: bool = False) -> list[tuple[int, int] | None]:
    """(rules, fragments) of each text as string_repair.repair() has them; None where two texts of one hash met."""
    them = _Texts(texts, accept_reversed)
    them.run()
    return [None if t else (int(r), int(n)) for r, n, t in zip(them.rules, them.left, them.told, strict=True)]


def alike(texts: list[str]) -> bool:
    """Whether texts are sooner counted side by side than one by one."""
    return sum(map(len, texts)) >= LONGEST * max(map(len, texts))


def blocks(sizes: list[int]) -> Iterator[slice]:
    """Neighbours that are counted together: as many as have SYMBOLS symbols, one at least, and no more than have numbers."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > SYMBOLS or i - begin == _TEXTS):
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if sizes:
        yield slice(begin, len(sizes))
