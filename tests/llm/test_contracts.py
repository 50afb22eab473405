"""What the queries' contracts fix, and estimates against plain versions, row by row."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from joinery.llm import crf, quality, queries, wordpiece


def test_base_phrases_without_ansi(spark, edge_docs, saved):
    docs = edge_docs.unionByName(edge_docs.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit("Released under the MIT license. CC BY-NC")}))
    folder, got = saved(documents=docs), {}
    before = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            got[ansi] = sorted(map(tuple, queries.queries()["op2_licenses"](spark, folder).collect()), key=str)
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)
    assert got["true"] == got["false"]
    assert {r[0]: r[2] for r in got["false"]}[77] == 2 and all(r[2] == 0 for r in got["false"] if r[0] != 77)


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ ⅳ", "42 - 17", "٣٤", "_ _"])
def test_numerals_are_no_letters(text):
    model = crf.fit([("ein wort und noch eins", "de"), ("one word and one more", "en")])
    assert crf.Labeller(model).label([text, f"{text} word"]) [0] == ["und", "en"]


def test_forward_backward_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    emit, move, start = rng.random((61, 4)), rng.random((4, 4)), rng.random(4)
    want = crf.marginals(emit, np.array([61]), move, start).sum(axis=0)
    for block in (1, 7, 61, 100):
        assert np.allclose(want, crf.long_shares(lambda s: emit[s], 61, move, start, block))
    random.seed(4)
    word = lambda letters: "".join(random.choice(letters) for _ in range(5))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    model = crf.fit([(text(x, 30), x) for x in ("abcdef", "uvwxyz") for _ in range(10)])
    texts = [text("abcdef", 200), None, text("uvwxyz", 3), text("uvwxyz", 70) + text("abcdef", 20), "", text("abcdef", 9)]
    whole = crf.Labeller(model).label(texts)
    monkeypatch.setattr(crf, "TOGETHER", 40)
    langs, scores = crf.Labeller(model).label(texts)
    assert langs == whole[0] and np.allclose(scores, whole[1], atol=1e-5)


def test_every_language_is_learned_from_the_same_rows(spark, monkeypatch):
    rows = [(i, f"wort{i} eins zwei", f"l{i % 230}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = []
    monkeypatch.setattr(crf, "fit", lambda samples: drawn.append(sorted(samples)))
    monkeypatch.setattr(crf, "ROWS", 4)
    crf.train(docs.repartition(5))
    crf.train(docs.orderBy(F.desc("doc_id")).repartition(2))
    assert drawn[0] == drawn[1]
    counts = np.unique([lang for _, lang in drawn[0]], return_counts=True)
    assert len(counts[0]) == 230 and counts[1].max() <= 4


def test_an_unlabelled_corpus_keeps_its_documents(spark, edge_docs):
    docs = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").where("doc_id is not null").collect())
    assert kept == [3, 5, 5, 5, 6, 7, 8, 9, 10]
    assert corpus_pipeline.language(spark, docs, "").columns == docs.columns


def test_token_counts_as_greedy_over_the_vocabulary():
    count, vocabulary = wordpiece.counter(), set()
    import json

    from public_tokenizers import path

    with open(path(wordpiece.VOCABULARY), encoding="utf-8") as file:
        model = json.load(file)["model"]
    symbol = wordpiece.byte_symbols()
    for token in model["vocab"]:
        if token not in ("<|startoftext|>", "<|endoftext|>"):
            vocabulary.add((bytes(map(symbol.__getitem__, token.removesuffix("</w>"))), token.endswith("</w>")))

    def greedy(data):
        at, n = 0, 0
        while at < len(data):
            at = next(stop for stop in range(len(data), at, -1) if (data[at:stop], stop == len(data)) in vocabulary)
            n += 1
        return n

    random.seed(21)
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randrange(1, 14))) for _ in range(2000)]
    words += [random.choice(["un", "re", "the", "ing"]) + w + random.choice(["ing", "tion", "s", "é", "ß", "中", "😀"]) for w in words[:1000]]
    words += [bytes(t).decode() for t, _ in list(vocabulary)[:8000] if t.isascii() and t]
    assert [count.word(w) for w in words] == [greedy(w.encode()) for w in words]


def single(x):
    """Cells of one row each."""
    i, j = np.triu_indices(quality.DIM)
    return quality.Cells(np.ones(len(x)), x, x[:, i] * x[:, j])


def test_least_determinant_of_all_subsets():
    rng = np.random.default_rng(5)
    for _ in range(6):
        x = rng.normal(0, 1, (12, 4)) @ rng.normal(0, 1, (4, 4))
        x[:3] += 40
        cells, least = single(x), np.inf
        for kept in combinations(range(12), 9):
            least = min(least, np.linalg.det(quality._floored(cells.moments(np.array(kept))[1], quality.SCALE_KEEP)))
        found = min(quality.concentrate(cells, *s, quality.STEPS)[0] for s in [cells.middle(), *starts(cells)])
        assert found == pytest.approx(least)


def starts(cells):
    rng = np.random.default_rng(quality.SEED)
    for _ in range(quality.STARTS):
        some = rng.choice(len(cells.n), size=quality.DIM + 1, p=cells.n / cells.total)
        yield cells.mean[some].mean(axis=0), quality._floored(np.cov(cells.mean[some].T, bias=True), 1.0)


def test_verdicts_as_by_the_plain_method(spark):
    """Every row's distance and verdict, for groups of their own, of a language and of the corpus; no row is left out."""
    random.seed(22)
    word = lambda: "".join(random.choice("aeioustrnl") for _ in range(random.randrange(2, 9)))
    rows = []
    for i in range(700):
        lang, source = ("en", "a") if i < 300 else ("en", f"s{i % 30}") if i < 450 else ("de", f"s{i % 9}") if i < 690 else (None, "z")
        text = " ".join(word() for _ in range(random.randrange(5, 200))) + random.choice(["", "", " #", "\nline\nline"])
        rows.append((i, text + " ***" * (40 if i % 17 == 0 else 0), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["_row"]["doc_id"]: (r["_distance"], r["_kept"]) for r in quality.judged(docs, ["doc_id"]).collect()}
    n, chars, symbols, dup, rep, lines = np.array([quality.counts(r[1]) for r in rows], float).T
    x = np.c_[np.log((chars + quality.PRIOR_CHARS) / (n + quality.PRIOR_WORDS)), np.log1p(100 * symbols / (chars + quality.PRIOR_CHARS)), np.log1p(100 * dup / (lines + 5)), np.log1p(100 * rep / (n + quality.PRIOR_WORDS))]
    use = ~((n < 10) | (100 * rep > 20 * n))
    langs, sources = np.array([str(r[2]) for r in rows]), np.array([r[3] for r in rows])

    def estimate(mine):
        number = np.clip(np.floor(x[mine] * quality.GRID), 0, quality.LAST).astype(int)
        cell, at = np.unique(number, axis=0, return_inverse=True)
        i, j = np.triu_indices(quality.DIM)
        sums, products = np.zeros((len(cell), 4)), np.zeros((len(cell), 10))
        np.add.at(sums, at.ravel(), x[mine])
        np.add.at(products, at.ravel(), x[mine][:, i] * x[mine][:, j])
        return quality.minimum_determinant(quality.Cells(np.bincount(at.ravel()), sums, products))

    for lang, source in set(zip(langs, sources, strict=True)):
        own = (langs == lang) & (sources == source)
        wide = next(m for m in (own & use, (langs == lang) & use, use) if m.sum() >= quality.MIN_ROWS or m is use)
        centre, scatter = estimate(wide)
        for k in np.flatnonzero(own):
            want = (x[k] - centre) @ np.linalg.inv(scatter) @ (x[k] - centre)
            assert got[k][0] == pytest.approx(want, rel=1e-6, abs=1e-9)
            assert got[k][1] == bool(use[k] and want <= quality.CUTOFF)
    assert {k for k, (_, kept) in got.items() if kept} != {k for k in got if use[k]}


def test_word_length_is_judged_by_its_own_variance(spark):
    """The floor is a small part of the variance of word lengths, which no group of texts lacks."""
    random.seed(23)
    word = lambda: "".join(random.choice("aeioustrnl") for _ in range(random.randrange(2, 9)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(random.randrange(20, 400))), "en", "a") for i in range(500)], "doc_id long, text string, lang string, source string")
    estimate = quality.fit(quality.statistics(docs, ["doc_id"]))[0].first()
    scatter = np.linalg.inv(np.array(estimate["inv"]).reshape(4, 4))
    assert quality.floor_share(scatter)[0] < 0.1


def test_few_rows_have_no_outliers(spark):
    docs = spark.createDataFrame([(i, "some words " * 2 + "of a short text that goes on " + "#" * (300 * (i == 3)), "en", "a") for i in range(20)], "doc_id long, text string, lang string, source string")
    assert all(r["_kept"] and r["_distance"] is None for r in quality.judged(docs, ["doc_id"]).collect())


def test_passes_hold_all_shards():
    from joinery.llm import cascade

    for most in (0, 5, 12, 1000):
        runs = cascade.passes([(i, 1 + i % 7) for i in range(50)], most)
        assert sorted(s for r in runs for s in r) == list(range(50))
        assert all(len(r) == 1 or sum(1 + s % 7 for s in r) <= most for r in runs)


def test_membership_joins_nothing(spark, saved):
    """Lists with keys that no row has, null-free plans without any join, at one pass and at many."""
    from joinery.llm import cascade

    rows = spark.createDataFrame([(i, f"h{i % 90}", "x") for i in range(900)], "page long, host string, listed_before string")
    listed = spark.createDataFrame([(f"h{i}",) for i in range(0, 300, 7)] * 2, "key string")
    made = cascade.with_membership(rows, F.col("host"), listed)
    assert "Join" not in made._jdf.queryExecution().toString()
    assert {r["page"]: r["listed"] for r in made.collect()} == {i: i % 90 % 7 == 0 for i in range(900)}
