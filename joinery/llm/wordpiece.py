"""Greedy longest-match token counts in one pass, without building pieces.

The vocabulary is a trie. A failure link leads from a node to the node of what is left after the longest tokens at
its front have been popped, and each link knows how many tokens that pops. Reading a word follows trie edges and,
where there is none, failure links; the sum of the popped counts is the number of tokens of the greedy
longest-match-first split. A word with a symbol that no token covers counts as one unknown token.

In a vocabulary with word ends, a word's last byte is a symbol of its own (the byte with the end mark), as the
vocabulary's first 512 tokens have it: each byte as an inner one and as a last one. So every word has a greedy split
into tokens of the vocabulary, and none is made up. Continuation prefixes work too (`inner`).

Defined results: a null or empty text has no words and no tokens.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from public_tokenizers import path
from pyspark.sql import DataFrame

from joinery.llm.rows import added, map_texts

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 500_000
_DEAD = -1


class LongestMatch:
    """Automaton over sequences of symbols."""

    def __init__(self, first: list[tuple], inner: list[tuple] | None = None):
        """first: tokens, as tuples of symbols, that can begin a word; inner: those that can follow (default: the same)."""
        self.edges: list[dict] = [{}]
        self.token = [False]
        self.parent: list[tuple[int, object]] = [(_DEAD, None)]
        for word in first:
            self._add(0, word)
        self.root = 0
        if inner is not None:
            self.root = self._node((_DEAD, None))
            for word in inner:
                self._add(self.root, word)
        self.fail = [_DEAD] * len(self.edges)
        self.popped = [0] * len(self.edges)
        self._link()

    def _node(self, parent) -> int:
        self.edges.append({})
        self.token.append(False)
        self.parent.append(parent)
        return len(self.edges) - 1

    def _add(self, at: int, word: tuple) -> None:
        for symbol in word:
            nxt = self.edges[at].get(symbol)
            if nxt is None:
                nxt = self.edges[at][symbol] = self._node((at, symbol))
            at = nxt
        self.token[at] = True

    def _link(self) -> None:
        """Breadth first: a token pops itself; else pop as the parent does, then go on until the last symbol fits."""
        level = list(dict.fromkeys((0, self.root)))
        while level:
            below = [child for node in level for child in self.edges[node].values()]
            for node in below:
                if self.token[node]:
                    self.fail[node], self.popped[node] = self.root, 1
                    continue
                up, symbol = self.parent[node]
                at, count = self.fail[up], self.popped[up]
                while at != _DEAD and symbol not in self.edges[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at != _DEAD:
                    self.fail[node], self.popped[node] = self.edges[at][symbol], count
            level = below

    def count(self, word) -> int | None:
        """Tokens of the greedy split; None if there is none."""
        at, total, edges, fail, popped = 0, 0, self.edges, self.fail, self.popped
        for symbol in word:
            while symbol not in edges[at]:
                total += popped[at]
                at = fail[at]
                if at == _DEAD:
                    return None
            at = edges[at][symbol]
        while at != self.root and at != 0:
            total += popped[at]
            at = fail[at]
            if at == _DEAD:
                return None
        return total


@lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def marked(data: bytes) -> tuple[int, ...]:
    """A word's symbols: its bytes, the last one with the end mark."""
    return (*data[:-1], 256 + data[-1])


class Counter:
    """Token counts of whole texts by a vocabulary file with word ends over byte symbols."""

    def __init__(self, name: str = VOCABULARY):
        with open(path(name), encoding="utf-8") as file:
            model = json.load(file)
        suffix, special = model["model"]["end_of_word_suffix"], {t["content"] for t in model["added_tokens"]}
        symbol = byte_symbols()
        words = []
        for token in model["model"]["vocab"]:
            if token not in special:
                body = token.removesuffix(suffix)
                found = bytes(map(symbol.__getitem__, body))
                words.append(marked(found) if body != token else tuple(found))
        self.automaton = LongestMatch(words)
        pattern = next(p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        found = self.automaton.count(marked(word.encode("utf-8", "surrogatepass")))
        return 1 if found is None else found

    def counts(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        if not text:
            return 0, 0
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        words = self.split(text.lower())
        known, total = self.known, 0
        try:
            total = sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for word in set(words):
                if word not in known:
                    known[word] = self.word(word)
            total = sum(map(known.__getitem__, words))
        return len(words), total


@lru_cache(maxsize=2)
def counter(name: str = VOCABULARY) -> Counter:
    return Counter(name)


def _counts(name: str):
    def make():
        count = counter(name).counts

        def work(texts: list) -> dict:
            found = np.array([count(t) for t in texts], np.int64).reshape(-1, 2)
            return {"n_words": found[:, 0], "n_tokens": found[:, 1]}

        return work

    return make


def token_counts(rows: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """rows (see rows.map_texts) with n_words and n_tokens."""
    return map_texts(rows, added("n_words long, n_tokens long"), _counts(name))
