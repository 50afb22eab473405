"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language. A word's features are its affixes, its letter 2- and 3-grams with
word borders, and its entries in lexicons of frequent words; the weights of the features, of the label transitions and
of the first label are learned together by maximum likelihood. To learn switches, training sequences are spliced from
runs of words of documents in different languages. At prediction, forward-backward gives each word's label
probabilities given the whole text; a text's language is the one with the largest sum over its words, the score is
that sum's share.

The model is fitted on the driver on a bounded sample: the ROWS labelled documents of each language that come first by a
hash of doc_id and text; of a text over ROW_CHARS characters it is fitted on a window of that length, placed by that hash.
All languages share DRIVER_CHARS characters: with more than 4 of them the windows are shorter. Every language of the
labelled rows is learned; each step of the fit changes the weights of the features in its batch only. Prediction reads
whole texts; texts of many words go through forward-backward in blocks, so that a task's memory does not grow with the
length of a text.

Defined results: letters are Unicode's categories L*; `und` with score 0 for null texts, texts without letters, and if
there are no labelled rows at all; ties go to the language first in the alphabet; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.llm.rows import added, map_texts, packed, unpacked

ROWS, ROW_CHARS, DRIVER_CHARS = 300, 50_000, 60_000_000
#: Feature weights, training sequences (in all, and at least for each language), runs in a sequence, words in a run.
SPACE, SEQUENCES, OF_EACH, RUNS, RUN_WORDS = 1 << 16, 2400, 24, 4, (4, 40)
LEXICON = 1500
EPOCHS, BATCH, RATE, DECAY = 3, 48, 0.25, 1e-6
SEED = 20240229
#: Distinct words whose scores a worker remembers, and these words times languages; when full, it forgets all and starts anew.
REMEMBERED, REMEMBERED_SCORES = 400_000, 1 << 23
#: Words times languages whose features' weights are summed up together.
SUMMED = 1 << 18
#: Words times languages that go through forward-backward together, about; longer texts go by themselves, in blocks of so many.
TOGETHER = 1 << 22
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    words = _WORDS((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    # numerals that are no digits, as one half or Roman eight, count as word characters, but not as letters
    return [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Numbers of a word's features."""
    framed = f"^{word}$"
    names = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3, 4)]
    names += [f"g{framed[i : i + n]}" for n in (2, 3) for i in range(len(framed) - n + 1)]
    names += [f"l{label}" for label in lexicon.get(word, ())]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % SPACE for n in names]


class Model:
    """Weights: features by label, transitions, first label."""

    def __init__(self, labels: list[str], lexicon: dict[str, tuple[int, ...]]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weight = np.zeros((SPACE, n), np.float32)
        self.move, self.start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        step = max(1, SUMMED // len(self.labels))
        for at in range(0, len(words), step):
            found = [features(w, self.lexicon) for w in words[at : at + step]]
            flat = np.fromiter(chain.from_iterable(found), np.int64)
            np.add.reduceat(self.weight[flat], np.cumsum([0, *map(len, found[:-1])]), axis=0, out=out[at : at + step])
        return out


def marginals(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Label probabilities of each word of sequences that lie one after the other.

    emit: positive factors per word, move and start: positive factors. pairs: also the expected transition counts.
    Both directions advance together, all sequences at once, longest first.
    """
    total, n = emit.shape
    before, after = np.empty((total, n), emit.dtype), np.empty((total, n), emit.dtype)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = first[order], lengths[order]
    last = first + size - 1
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # sequences longer than t
    state = np.ones((2, len(size), n), emit.dtype)
    state[0] = start
    both = np.stack([move, move.T])
    for t, count in enumerate(active.tolist()):
        if count != state.shape[1]:
            state = state[:, :count]
        ahead, back = first[:count] + t, last[:count] - t
        before[ahead], after[back] = state[0], state[1]
        state = np.stack([state[0] * emit[ahead], state[1] * emit[back]]) @ both
        state /= state.sum(axis=2, keepdims=True)
    each = before * emit * after
    each /= each.sum(axis=1, keepdims=True)
    if not pairs:
        return each
    inner = np.ones(total, bool)
    inner[np.cumsum(lengths) - 1] = False
    left = np.flatnonzero(inner)
    one, two = before[left] * emit[left], emit[left + 1] * after[left + 1]
    # a pair's table is one x two times move; only its total is needed by itself, the tables' sum is one product
    return each, move * ((one / ((one @ move) * two).sum(axis=1, keepdims=True)).T @ two)


def long_shares(emit: Callable[[slice], np.ndarray], total: int, move: np.ndarray, start: np.ndarray, block: int) -> np.ndarray:
    """Sum over the words of one sequence of their label probabilities, with the states of one block of words at a time.

    A first pass forward keeps the state at each block's start; then blocks are gone through from the last to the first.
    """
    starts = range(0, total, block)
    heads, state = [], start.astype(np.float64)
    for at in starts:
        heads.append(state)
        for row in emit(slice(at, min(total, at + block))):
            state = (state * row) @ move
            state /= state.sum()
    after, out = np.ones(len(start)), np.zeros(len(start))
    for at, state in zip(reversed(starts), reversed(heads), strict=True):
        rows = emit(slice(at, min(total, at + block)))
        before = np.empty((len(rows), len(start)))
        for i, row in enumerate(rows):
            before[i] = state
            state = (state * row) @ move
            state /= state.sum()
        for i in range(len(rows) - 1, -1, -1):
            each = before[i] * rows[i] * after
            out += each / each.sum()
            after = move @ (rows[i] * after)
            after /= after.sum()
    return out


def _summed(keys: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and for each the sum of its rows (which: the row of each key, else one row a key)."""
    order = np.argsort(keys, kind="stable")
    distinct, heads = np.unique(keys[order], return_index=True)
    across = np.ascontiguousarray(rows.T)  # sums run along memory
    return distinct, np.add.reduceat(across.take(order if which is None else which[order], axis=1), heads, axis=1).T


def fit(samples: list[tuple[str, str]]) -> Model:
    """samples: (text, language)."""
    by: dict[str, list[list[str]]] = {}
    for text, lang in sorted(samples):
        if words := words_of(text):
            by.setdefault(lang, []).append(words)
    labels = sorted(by)
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, lang in enumerate(labels):
        often = Counter(chain.from_iterable(by[lang])).most_common()
        for word, n in sorted(often, key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n > 1:
                lexicon[word] = (*lexicon.get(word, ()), i)
    model = Model(labels, lexicon)
    if len(labels) < 2:
        return model
    random = np.random.default_rng(SEED)
    number: dict[str, int] = {}
    sequences = []
    for _ in range(max(SEQUENCES, OF_EACH * len(labels))):
        ids, tags = [], []
        for _ in range(random.integers(1, RUNS + 1)):
            tag = int(random.integers(len(labels)))
            source = by[labels[tag]][random.integers(len(by[labels[tag]]))]
            n = int(random.integers(*RUN_WORDS))
            at = int(random.integers(max(1, len(source) - n + 1)))
            run = source[at : at + n]
            ids += [number.setdefault(w, len(number)) for w in run]
            tags += [tag] * len(run)
        sequences.append((np.array(ids), np.array(tags)))
    found = [np.array(features(w, lexicon)) for w in number]
    grown = [np.full(a.shape, 1e-6, np.float32) for a in (model.weight, model.move, model.start)]
    for _ in range(EPOCHS):
        order = random.permutation(len(sequences))
        for at in range(0, len(order), BATCH):
            part = [sequences[i] for i in order[at : at + BATCH]]
            ids, tags = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            lengths = np.array([len(p[0]) for p in part])
            own, place = np.unique(ids, return_inverse=True)
            flat, sizes = np.concatenate([found[i] for i in own]), np.array([len(found[i]) for i in own])
            score = np.add.reduceat(model.weight[flat], np.cumsum(sizes) - sizes, axis=0)[place].astype(float)
            emit = np.exp(score - score.max(axis=1, keepdims=True))
            each, moved = marginals(emit, lengths, np.exp(model.move.astype(float)), np.exp(model.start.astype(float)), pairs=True)
            heads = np.cumsum(lengths) - lengths
            inner = np.ones(len(tags), bool)
            inner[np.cumsum(lengths) - 1] = False
            left = np.flatnonzero(inner)
            off = -each
            off[np.arange(len(tags)), tags] += 1
            _, by_word = _summed(place, off.astype(np.float32))
            touched, slope = _summed(flat, by_word, np.repeat(np.arange(len(own)), sizes))
            step = -moved
            np.add.at(step, (tags[left], tags[left + 1]), 1)
            begin = off[heads].sum(axis=0)
            for mine, total, rows, change in zip((model.weight, model.move, model.start), grown, (touched, ..., ...), (slope, step, begin), strict=True):
                was = mine[rows]
                change = (change / len(part)).astype(np.float32) - np.float32(DECAY) * was
                squares = total[rows] + change**2
                total[rows] = squares
                mine[rows] = was + np.float32(RATE) * change / np.sqrt(squares)
    return model


class Labeller:
    """Applies a model to whole texts, many at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.move, self.start = np.exp(model.move), np.exp(model.start)
        self.number: dict[str, int] = {}
        self.emit = np.zeros((0, len(model.labels)), np.float32)

    def _ids(self, texts: list) -> list[np.ndarray]:
        if len(self.number) > min(REMEMBERED, REMEMBERED_SCORES // len(self.start)):
            self.number.clear()
            self.emit = self.emit[:0]
        number, have = self.number, len(self.emit)
        out = []
        for text in texts:
            words = words_of(text)
            try:
                ids = list(map(number.__getitem__, words))
            except KeyError:
                ids = [number.setdefault(w, len(number)) for w in words]
            out.append(np.array(ids, np.int64))
        if len(number) > have:
            score = self.model.word_scores(list(number)[have:])
            self.emit = np.concatenate([self.emit, np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-12)])
        return out

    def word_probabilities(self, text: str) -> np.ndarray:
        ids = self._ids([text])[0]
        return marginals(self.emit[ids], np.array([len(ids)]), self.move, self.start) if len(ids) else np.zeros((0, len(self.start)))

    def label(self, texts: list) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.model.labels:
            return langs, scores
        ids = self._ids(texts)
        block = max(1, TOGETHER // len(self.start))
        part: list[int] = []
        held = 0
        for i in sorted((i for i, x in enumerate(ids) if len(x)), key=lambda i: len(ids[i])):
            held += len(ids[i])
            if part and held > block:
                self._judge(part, self._shares([ids[j] for j in part]), langs, scores)
                part, held = [], len(ids[i])
            if len(ids[i]) > block:
                share = long_shares(lambda s, mine=ids[i]: self.emit[mine[s]], len(ids[i]), self.move, self.start, block) / len(ids[i])
                self._judge([i], share[None], langs, scores)
            else:
                part.append(i)
        if part:
            self._judge(part, self._shares([ids[j] for j in part]), langs, scores)
        return langs, scores

    def _shares(self, ids: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(x) for x in ids])
        each = marginals(self.emit[np.concatenate(ids)], lengths, self.move, self.start)
        return np.add.reduceat(each, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) / lengths[:, None]

    def _judge(self, which: list[int], share: np.ndarray, langs: list[str], scores: list[float]) -> None:
        for i, best, row in zip(which, share.argmax(axis=1), share, strict=True):
            langs[i], scores[i] = self.model.labels[best], float(min(1.0, row[best]))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame) -> Model:
    """Model from the labelled rows of docs (columns doc_id, text, lang) that are not held out.

    A first pass counts the languages; the second one lets through by hash about twice the rows that are wanted of each
    language, so that only those are ranked.
    """
    mine = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    counts = mine.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model([], {})
    range_ = 1 << 30
    wanted = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(range_, 2 * ROWS * range_ // r["n"]))])
    hashed = mine.withColumn("_at", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    drawn = hashed.where(F.pmod("_at", F.lit(range_)) < F.element_at(wanted, F.col("lang")))
    chars = max(1, min(ROW_CHARS, DRIVER_CHARS // (ROWS * len(counts))))
    place = F.pmod(F.shiftright("_at", 20), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    short = drawn.select(F.col("text").substr(place.cast("int"), F.lit(chars)).alias("text"), "lang", F.pmod("_at", F.lit(range_)).alias("_rank"), "_at")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_rank", "_at", "text"))
    rows = short.withColumn("_n", rank).where(F.col("_n") <= ROWS).select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in rows])


def _labels(model: Model):
    def make():
        labeller = Labeller(model)

        def work(texts: list) -> dict:
            langs, scores = labeller.label(texts)
            return {"_lang_pred": langs, "_score": scores}

        return work

    return make


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """rows (see rows.map_texts) with _lang_pred and _score."""
    return map_texts(rows, added("_lang_pred string, _score double"), _labels(model))


def recognised(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of docs with a language, at a score of least_score or more; unchanged and never shuffled.

    Without any labelled row there is no model: then only rows without letters go.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = identify(packed(docs), model)
    kept = rows.where((F.col("_lang_pred") != "und") & (F.col("_score") >= least_score))
    return kept.select(*unpacked(kept))
