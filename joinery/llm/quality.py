"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each text gives counts; the counts give a transformed statistic vector. A (language, source) group's rows are summed up
in cells of a fixed grid over the vector's range (at most CELLS of them, whatever the group's size), with the exact
sums and products of their rows, so a group is a bounded table and its estimate takes one task. Concentration steps
run on it: rank the cells by Mahalanobis distance, keep the nearest share, estimate mean and covariance from the sums
of what is kept, and repeat until the determinant stops falling. They start at the medians and MADs of the entries and
at STARTS seeded subsets; all take FIRST steps, the BEST of them go on to the end, and the least determinant stands.
Reweighting by the chi-square 0.975 bound gives the estimate. A document is an outlier if its squared distance exceeds
CUTOFF, a chi-square quantile.

Statistics that are zero in most documents have no variance in the kept share, and then any other value would be
infinitely far. Only against that FLOOR is added to the covariance; floor_share() tells how much of an estimate it is.

Groups with fewer than MIN_ROWS usable rows are judged by their language's estimate, then by the whole corpus's;
with fewer rows than that in all, no document is an outlier.

Defined results: a null text counts as having no word, and fails the base rule; null languages and sources are
groups of their own; repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.llm.rows import added, map_texts, unpacked
from joinery.runtime import materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Entries of the vector, and the standard deviation that stands in where one has none: word length varies in any group of
#: texts, the others are zero throughout in most.
FLOOR = (0.005, 0.2, 0.75, 0.75)
DIM = len(FLOOR)
#: Cells of the grid: per unit and dimension, and the last cell's number in it; each one's rows keep their exact sums.
GRID, LAST = (64, 4, 4, 4), (255, 18, 18, 18)
CELLS = int(np.prod([x + 1 for x in LAST]))
#: Share of a group's rows that a concentration step keeps, and the most steps of a start.
KEEP, STEPS = 0.75, 30
#: Seeded starts beside the medians and MADs, steps that each of them takes, and how many go on.
STARTS, FIRST, BEST, SEED = 24, 2, 4, 20240611
MIN_ROWS = 50
#: Chi-square quantiles for DIM = 4 degrees of freedom: 0.75, 0.975 and 0.99999.
CHI_KEEP, CHI_REWEIGHT, CUTOFF = 5.385, 11.143, 28.473
#: Consistency of the covariance of the nearest 75 % and 97.5 % (chi-square with 6 against 4 degrees of freedom).
SCALE_KEEP, SCALE_REWEIGHT = 0.75 / 0.5046, 0.975 / 0.9160
#: Words of typical length that every text is taken to have besides its own, so that short texts do not scatter.
PRIOR_WORDS, PRIOR_CHARS = 50, 275
#: Up to this many groups the estimates are broadcast (under 350 bytes each); beyond, they are joined by key.
BROADCAST_GROUPS = 20_000
_SPACE = b" \t\n\x0b\x0c\r"
_OTHER = bytes(range(256)).translate(None, b"#*$%&|<>")
_WIDTH = 5


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, _SPACE))
    symbols = len(data.translate(None, _OTHER))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated(words), len(lines)


def repeated(words: list[bytes], width: int = _WIDTH) -> int:
    """Number of words in windows of `width` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) ** width < 1 << 63:
        key = ids[:n].copy()
        for i in range(1, width):
            key = key * len(number) + ids[i : n + i]
    else:  # pairs of ranks keep exact identity
        key = ids[:n]
        for i in range(1, width):
            key = np.unique(key * len(number) + ids[i : n + i], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _counter():
    def work(texts: list) -> dict:
        found = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return {f"_{c}": found[:, i] for i, c in enumerate(COUNTS)}

    return work


def with_counts(rows: DataFrame) -> DataFrame:
    """rows (see rows.map_texts) and COUNTS with a leading underscore."""
    return map_texts(rows, added(", ".join(f"_{c} long" for c in COUNTS)), _counter)


def base_failed() -> Column:
    return (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))


def vector() -> Column:
    """The transformed statistics: mean word length, and shares of symbols, repeated lines and repeated words."""
    words, chars = F.col("_n_words") + PRIOR_WORDS, F.col("_word_chars") + PRIOR_CHARS
    return F.array(
        F.log(chars / words),
        F.log1p(100 * F.col("_n_symbols") / chars),
        F.log1p(100 * F.col("_n_dup_lines") / (F.col("_n_lines") + 5)),
        F.log1p(100 * F.col("_n_repeat_words") / words),
    )


def _name(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


class Cells:
    """A group's cells: number of rows n, their sums and the sums of their entries' products."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray):
        self.n, self.sums, self.products = n.astype(float), sums, products
        self.mean = sums / self.n[:, None]
        self.total = self.n.sum()

    def moments(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[kept].sum()
        centre = self.sums[kept].sum(axis=0) / n
        upper = self.products[kept].sum(axis=0) / n
        scatter = np.zeros((DIM, DIM))
        scatter[np.triu_indices(DIM)] = upper
        scatter = scatter + np.triu(scatter, 1).T - np.outer(centre, centre)
        return centre, scatter

    def distances(self, centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
        off = self.mean - centre
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off)

    def nearest(self, distance: np.ndarray) -> np.ndarray:
        """The fewest cells in order of distance that hold the share KEEP of the rows."""
        order = np.argsort(distance, kind="stable")
        return order[: 1 + np.searchsorted(np.cumsum(self.n[order]), KEEP * self.total)]

    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """Median and MAD of each entry, by the cells' means."""
        centre, spread = np.zeros(DIM), np.array(FLOOR)
        for i in range(DIM):
            centre[i] = self._median(self.mean[:, i])
            spread[i] = max(FLOOR[i], 1.4826 * self._median(np.abs(self.mean[:, i] - centre[i])))
        return centre, np.diag(spread**2)

    def _median(self, values: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return values[order][np.searchsorted(np.cumsum(self.n[order]), self.total / 2)]


def _floored(scatter: np.ndarray, scale: float) -> np.ndarray:
    return scatter * scale + np.diag(np.square(FLOOR))


def concentrate(cells: Cells, centre: np.ndarray, scatter: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Determinant, mean and covariance after up to `steps` concentration steps; they end when the determinant stops falling."""
    least = np.inf
    for _ in range(steps):
        mean, found = cells.moments(cells.nearest(cells.distances(centre, scatter)))
        found = _floored(found, SCALE_KEEP)
        size = np.linalg.det(found)
        if not size < least * (1 - 1e-12):
            break
        least, centre, scatter = size, mean, found
    return least, centre, scatter


def minimum_determinant(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the share KEEP of least determinant over all starts, reweighted."""
    random = np.random.default_rng(SEED)
    starts = [cells.middle()]
    for _ in range(STARTS):
        some = random.choice(len(cells.n), size=DIM + 1, p=cells.n / cells.total)
        starts.append((cells.mean[some].mean(axis=0), _floored(np.cov(cells.mean[some].T, bias=True), 1.0)))
    tried = sorted((concentrate(cells, *start, FIRST) for start in starts), key=lambda x: x[0])
    _, centre, scatter = min((concentrate(cells, c, s, STEPS) for _, c, s in tried[:BEST]), key=lambda x: x[0])
    near = np.flatnonzero(cells.distances(centre, scatter) <= CHI_REWEIGHT)
    if len(near):
        centre, scatter = cells.moments(near)
        scatter = _floored(scatter, SCALE_REWEIGHT)
    return centre, scatter


def floor_share(scatter: np.ndarray) -> np.ndarray:
    """The share of each variance of an estimate that the floor makes up."""
    return np.square(FLOOR) / np.diag(scatter)


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(_CELL, kind="stable")
    centre, scatter = minimum_determinant(Cells(rows["n"].to_numpy(), rows[_SUMS].to_numpy(), rows[_PRODUCTS].to_numpy()))
    return pd.DataFrame({"g": [key[0]], "mu": [centre.tolist()], "inv": [np.linalg.inv(scatter).ravel().tolist()]})


_CELL, _SUMS = [f"c{i}" for i in range(DIM)], [f"s{i}" for i in range(DIM)]
_PRODUCTS = [f"p{i}{j}" for i in range(DIM) for j in range(i, DIM)]
_ESTIMATE = "g string, mu array<double>, inv array<double>"


def distance() -> Column:
    """Squared Mahalanobis distance of column x from the estimate (mu, inv)."""
    off = [F.col("x")[i] - F.col("mu")[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(DIM):
            total = total + off[i] * off[j] * F.col("inv")[i * DIM + j]
    return total


def _joined(rows: DataFrame, small: DataFrame, on: str, groups: int) -> DataFrame:
    return rows.join(F.broadcast(small) if groups <= BROADCAST_GROUPS else small, on, "left")


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """(_lang, _source) with the estimate (mu, inv) that judges them; the number of such rows.

    stats: rows with _lang, _source (see _name), x and _base_failed.
    """
    cell = [F.greatest(F.lit(0), F.least(F.lit(LAST[i]), F.floor(F.col("x")[i] * GRID[i]).cast("int"))).alias(_CELL[i]) for i in range(DIM)]
    usable = (~F.col("_base_failed")).cast("int")
    sums = [F.sum(F.col("x")[i] * usable).alias(_SUMS[i]) for i in range(DIM)]
    sums += [F.sum(F.col("x")[i] * F.col("x")[j] * usable).alias(f"p{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    cells = materialise(stats.groupBy("_lang", "_source", *cell).agg(F.sum(usable).alias("n"), *sums), "cells")
    sizes = cells.groupBy("_lang", "_source").agg(F.sum("n").alias("n"))
    by_lang = sizes.groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    level = F.when(F.col("n") >= MIN_ROWS, F.concat_ws("\x00", "_lang", "_source")).when(F.col("n_lang") >= MIN_ROWS, F.col("_lang")).otherwise("*")
    named = materialise(sizes.join(by_lang, "_lang").select("_lang", "_source", level.alias("g")), "named")
    groups = named.count()
    # a cell also counts for its language and the corpus, if those judge some group
    levels = cells.where("n > 0").withColumn("g", F.explode(F.array(F.concat_ws("\x00", "_lang", "_source"), F.col("_lang"), F.lit("*"))))
    judging = named.select("g").distinct()
    asked = levels.join(F.broadcast(judging) if groups <= BROADCAST_GROUPS else judging, "g", "left_semi")
    summed = asked.groupBy("g", *_CELL).agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS, *_PRODUCTS)])
    enough = summed.groupBy("g").applyInPandas(_fit, _ESTIMATE)
    few = sizes.agg(F.sum("n")).first()[0] or 0
    estimate = enough if few >= MIN_ROWS else enough.where(F.lit(False))
    return materialise(named.join(F.broadcast(estimate) if groups <= BROADCAST_GROUPS else estimate, "g", "left").select("_lang", "_source", "mu", "inv"), "estimates"), groups


def statistics(docs: DataFrame, keep: list[str], texts: bool = False) -> DataFrame:
    """_row (of the columns `keep`), the counts, _lang, _source, x and _base_failed of each row. texts: `keep` has the text."""
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), *[] if texts else [F.col("text").alias("_text")], _name("lang").alias("_lang"), _name("source").alias("_source"))
    return with_counts(ready).withColumns({"x": vector(), "_base_failed": base_failed()})


def judge(stats: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """stats with _distance (null where no estimate exists) and _kept."""
    key = F.concat_ws("\x00", "_lang", "_source")
    small = estimates.select(key.alias("_key"), "mu", "inv")
    joined = _joined(stats.withColumn("_key", key), small, "_key", groups).withColumn("_distance", distance())
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_distance") <= CUTOFF, F.lit(True)))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_row (of the small columns `keep`), the counts, _base_failed, _distance and _kept of each row; texts are read once."""
    stats = materialise(statistics(docs, keep), "statistics")
    return judge(stats, *fit(stats))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, unchanged; texts are read twice and never shuffled."""
    stats = materialise(statistics(docs, ["doc_id"]), "statistics")
    rows = judge(statistics(docs, docs.columns, texts=True), *fit(stats)).where("_kept")
    return rows.select(*unpacked(rows))
