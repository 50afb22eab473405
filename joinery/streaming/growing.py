"""Bounds of strings that grow: a grammar per key as streaming state, better bounds as they are found.

The state of a key is its grammar, not its text: the tokens that are left (a list, of which only the last few are kept at hand),
the rules (a map from two tokens to their joined one) and a few counts. A new symbol joins the last token while a rule says so.
When the tokens have doubled since the last time, or a timer says that the key has rested, Re-Pair runs over the tokens, not over the text,
so the work for a key stays near linear in its length. The number of rules and tokens is a bound that the rules prove at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from joinery.kernels import string_repair
from joinery.runtime import ship

#: The state store that lists, maps and timers need; set it as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tokens at hand, and tokens before the first pass.
AT_HAND, FIRST_PASS = 32, 64
#: Numbers up to here are symbols themselves (Unicode scalars); joined tokens follow.
FIRST_RULE = 0x110000


def compressed(tokens: list[int], joined: dict[tuple[int, int], int], next_id: int) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Re-Pair over tokens: what is left of them and the new rules, numbered from next_id. Rules that are there already are used first."""
    distinct = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    letter = lambda i: chr(i + 1 if i + 1 < 0xD800 else i + 0x801)
    text = "".join(letter(distinct[t]) for t in tokens)
    grammar = string_repair.repair(text)
    of_symbol, new = {}, {}
    back = {letter(i): t for t, i in distinct.items()}
    for symbol, c in grammar.terminals:
        of_symbol[symbol] = back[c]
    for rule in grammar.rules:
        pair = of_symbol[rule.left], of_symbol[rule.right]
        known = joined.get(pair, new.get(pair))
        if known is None:
            known = new[pair] = next_id + len(new)
        of_symbol[rule.id] = known
    return [of_symbol[symbol] for symbol, *_ in grammar.residual], new


class Growing(StatefulProcessor):
    """One key's grammar; rows are emitted when the joins saved against building symbol by symbol have risen."""

    def __init__(self, key: str, symbol: str, order: str, rest_ms: int | None):
        self.key, self.symbol, self.order, self.rest_ms = key, symbol, order, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "length long, rules long, stored long, passed long, best long")
        self.hand = handle.getValueState("hand", "tokens array<long>")
        self.tokens = handle.getListState("tokens", "token long")
        self.rules = handle.getMapState("rules", "a long, b long", "token long")

    def _joined(self, cache: dict, a: int, b: int) -> int | None:
        if (a, b) not in cache:
            cache[a, b] = self.rules.getValue((a, b))[0] if self.rules.containsKey((a, b)) else None
        return cache[a, b]

    def _state(self) -> tuple[list[int], list[int]]:
        counts = list(self.counts.get()) if self.counts.exists() else [0, 0, 0, FIRST_PASS // 2, 0]
        return counts, list(self.hand.get()[0]) if self.hand.exists() else []

    def _pass(self, counts: list[int], hand: list[int]) -> list[int]:
        """Re-Pair over all tokens; they are few enough afterwards to be what the next pass is measured by."""
        all_ = [r[0] for r in self.tokens.get()] + hand
        known = {tuple(k): v[0] for k, v in self.rules.iterator()}
        left, new = compressed(all_, known, FIRST_RULE + counts[1])
        for pair, token in new.items():
            self.rules.updateValue(pair, (token,))
        counts[1] += len(new)
        stored, hand = left[:-AT_HAND], left[-AT_HAND:]
        self.tokens.clear()
        if stored:
            self.tokens.put([(t,) for t in stored])
        counts[2], counts[3] = len(stored), max(len(left), FIRST_PASS // 2)
        return hand

    def _emitted(self, key: tuple, counts: list[int], hand: list[int]) -> Iterator[pd.DataFrame]:
        bound = counts[1] + counts[2] + len(hand) - 1
        saved = counts[0] - 1 - bound
        better = saved > counts[4]
        counts[4] = max(counts[4], saved)
        self.counts.update(tuple(counts))
        self.hand.update((hand,))
        if better:
            yield pd.DataFrame({self.key: [key[0]], "length": [counts[0]], "bound": [bound], "saved": [saved]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts, hand = self._state()
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        cache: dict[tuple[int, int], int | None] = {}
        for c in "".join(batch[self.symbol].dropna()):
            counts[0] += 1
            hand.append(ord(c))
            while len(hand) > 1 and (one := self._joined(cache, hand[-2], hand[-1])) is not None:
                hand[-2:] = [one]
            if counts[2] + len(hand) >= 2 * counts[3]:
                hand = self._pass(counts, hand)
                cache.clear()
        if len(hand) > AT_HAND:
            self.tokens.appendList([(t,) for t in hand[:-AT_HAND]])
            counts[2] += len(hand) - AT_HAND
            hand = hand[-AT_HAND:]
        if self.rest_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.rest_ms)
        yield from self._emitted(key, counts, hand)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts, hand = self._state()
        yield from self._emitted(key, counts, self._pass(counts, hand))

    def close(self) -> None:
        pass


def growing_bounds(stream: DataFrame, key: str, symbol: str, order: str, rest_ms: int | None = None) -> DataFrame:
    """key, length, bound, saved: each time that more joins are saved on a key's string so far (from the first join on).

    Symbols (one or more a row, null as none) of a batch are taken by `order`, batches as they come. rest_ms: a key without
    new symbols for so long has one more pass; such a stream runs batches until it is stopped. The session needs PROVIDER.
    """
    ship(stream.sparkSession)
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("length", "bound", "saved"))])
    return stream.select(key, symbol, order).groupBy(key).transformWithStateInPandas(Growing(key, symbol, order, rest_ms), out, "Update", "None" if rest_ms is None else "ProcessingTime")
