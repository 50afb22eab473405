"""Byte-level BPE by prefix dynamic programming.

The BPE encoding of any byte string has exactly one last token for each prefix: the one token that ends there and
is compatible with the last token of the prefix before it. So one table, the last token of each prefix, holds the
encodings of all prefixes. Appending bytes only adds entries, and an edit leaves all entries before it valid; those
behind it are rebuilt only until the table agrees with the old one over the longest token's length.

Two tokens are compatible if BPE does not merge across their border, that is, if the encoding of their joined bytes
is these two tokens. Verdicts are kept by pair.

Defined results: a null text is empty and has no tokens; any text decodes to its own UTF-8 bytes.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256

import numpy as np
import regex
from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame

from joinery.llm.rows import added, map_texts, packed

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct pieces whose ids a worker remembers; when full, it forgets all and starts anew.
REMEMBERED = 400_000


class Vocabulary:
    """Ranked byte tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every end of a token with the rank that it has itself, or -1: a backward walk stops at the first string that is none.
        self.ends = dict.fromkeys((token[i:] for token in ranks for i in range(1, len(token))), -1) | ranks
        #: Verdicts by the pair's ranks, packed into one number.
        self.compatible: dict[int, bool] = {}
        self.stable: dict[int, bool] = {}

    @classmethod
    def load(cls, name: str) -> Vocabulary:
        with open(path(name), "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: join the best-ranked neighbours until none can be joined."""
        rank_of, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [rank_of(data[i : i + 2], none) for i in range(len(data) - 1)]
        while joined and (least := min(joined)) < none:
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = rank_of(parts[at] + parts[at + 1], none)
            if at:
                joined[at - 1] = rank_of(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` can follow `left` in an encoding."""
        pair = left << 32 | right
        known = self.compatible.get(pair)
        if known is None:
            known = self.compatible[pair] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def whole(self, rank: int) -> bool:
        """Whether BPE yields this token for its own bytes; one that it splits ends no encoding."""
        known = self.stable.get(rank)
        if known is None:
            known = self.stable[rank] = self.merged(self.tokens[rank]) == [rank]
        return known

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Add to `last` (the last tokens of data's first prefixes) those of the prefixes up to `stop` bytes."""
        rank_of, known = self.ends.get, self.compatible.get
        for end in range(len(last) + 1, stop + 1):
            start = end - 1
            while start >= 0:
                rank = rank_of(data[start:end])
                if rank is None:
                    start = -1
                    break
                if rank >= 0:
                    if not start:
                        fits = self.whole(rank)
                    else:
                        fits = known(last[start - 1] << 32 | rank)
                        if fits is None:
                            fits = self.fits(last[start - 1], rank)
                    if fits:
                        last.append(rank)
                        break
                start -= 1
            if start < 0:
                raise ValueError(f"no token ends at byte {end}")


@lru_cache(maxsize=4)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary.load(name)


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, data, []
        vocab.extend(data, self.last, len(data))

    def append(self, data: bytes) -> None:
        """Exact append: earlier entries stay."""
        self.data += data
        self.vocab.extend(self.data, self.last, len(self.data))

    def splice(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes start..stop by data; the number of entries that were worked out anew."""
        old, behind = self.last[stop:], start + len(data)
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start:]
        self.vocab.extend(self.data, self.last, behind)
        agree = 0
        for i, was in enumerate(old):
            self.vocab.extend(self.data, self.last, behind + i + 1)
            agree = agree + 1 if self.last[-1] == was else 0
            if agree >= self.vocab.longest:
                self.last += old[i + 1 :]
                return len(data) + i + 1
        return len(data) + len(old)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of `end` bytes (default: all)."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocab.tokens[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """Ids, as little-endian unsigned 32-bit integers, of each piece of text seen."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = np.array(Prefixes(self.vocab, piece.encode("utf-8", "surrogatepass")).ids(), "<u4").tobytes()
        if len(piece) < 100:
            self[piece] = found
        return found


class Encoder:
    """Encodes and decodes whole texts; each match of the pattern is encoded by itself."""

    def __init__(self, name: str = VOCABULARY, pattern: str = PATTERN):
        self.vocab = vocabulary(name)
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.vocab)
        tokens = self.vocab.tokens
        self.token_list = [tokens.get(i, b"") for i in range(max(tokens) + 1)]

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_list.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY) -> Encoder:
    return Encoder(name)


def _digests(name: str):
    def make():
        coder = encoder(name)

        def work(texts: list) -> dict:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                ids = coder.encode_bytes(text or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(sha256(ids).hexdigest())
                out["decoded_sha256"].append(sha256(coder.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            return out

        return work

    return make


def _ids(name: str):
    def make():
        coder = encoder(name)
        return lambda texts: {"ids": [coder.encode(t or "") for t in texts]}

    return make


def encode(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """`_row` (all columns of docs) and ids: array<int>, the tokens of column text."""
    return map_texts(packed(docs), added("ids array<int>"), _ids(name))


def digests(rows: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """rows (see rows.map_texts) with n_tokens and the SHA-256 of the ids and of the bytes that they decode to."""
    return map_texts(rows, added("n_tokens long, ids_sha256 string, decoded_sha256 string"), _digests(name))
