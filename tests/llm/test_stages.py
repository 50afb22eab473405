"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import random

import numpy as np
import pytest

import corpus_pipeline
from joinery.llm import crf, packing, quality, simhash, wordpiece

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_are_the_ones_asked_for(stages):
    assert [s[0] for s in stages] == ["language ID", "quality rules", "SimHash near-dedup", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema.simpleString() == before.schema.simpleString()


def test_language_stage(spark, stages):
    _, before, after = stages[0]
    labeller = crf.Labeller(crf.train(before))
    rows = before.select("doc_id", "text").collect()
    langs, scores = labeller.label([r["text"] for r in rows])
    assert ids(after) == sorted(r["doc_id"] for r, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE)


def test_quality_stage(spark, stages):
    _, before, after = stages[1]
    kept = {r["_row"]["doc_id"] for r in quality.judged(before, ["doc_id"]).where("_kept").collect()}
    assert ids(after) == sorted(kept)
    for r in before.collect():
        n, _, _, _, repeats, _ = quality.counts(r["text"])
        if n < 10 or 100 * repeats > 20 * n:
            assert r["doc_id"] not in kept


def test_dedup_stage(spark, stages):
    _, before, after = stages[2]
    """Plain similarity of whole sets of five-word shingles, whatever the fingerprints say, and op8's own links."""
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"]), set(simhash.shingle_set(r["text"]).tolist())) for r in before.select("doc_id", "text").collect())
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y) > 0
    label = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a, x in rows:
            for j, b, y in rows:
                if label[j] < label[i] and ((a ^ b).bit_count() <= 2 or similar(x, y)):
                    label[i], changed = label[j], True
    assert ids(after) == sorted(i for i, l in label.items() if i == l)


def test_packing_stage(spark, stages):
    _, before, after = stages[3]
    count = wordpiece.counter().counts
    want = {r["doc_id"]: count(r["text"])[1] for r in before.select("doc_id", "text").collect()}
    rows = after.collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == want
    bins = {}
    for r in rows:
        if r["bin"] is not None:
            bins.setdefault((r["pool"], r["bin"]), []).append(r)
    for inside in bins.values():
        total = sum(r["n_tokens"] for r in inside)
        assert inside[0]["bin_length"] == min(x for x in packing.LENGTHS if x >= total)


def test_run_equals_the_stages(spark, stages):
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(stages[-1][2])


def test_estimates_against_plain_concentration(spark):
    """One group: distances as those of concentration steps on exact ranks."""
    random.seed(16)
    word = lambda: "".join(random.choice("aeioustrnl") for _ in range(random.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(random.randrange(20, 300))) + random.choice(["", " #", " | |"]) for _ in range(300)]
    texts += [" ".join(f"{word()}***" for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = sorted(quality.judged(docs, ["doc_id"]).collect(), key=lambda r: r["_row"]["doc_id"])
    n, chars, symbols, dup, rep, lines = np.array([quality.counts(t) for t in texts], float).T
    x = np.c_[np.log((chars + quality.PRIOR_CHARS) / (n + quality.PRIOR_WORDS)), np.log1p(100 * symbols / (chars + quality.PRIOR_CHARS)), np.log1p(100 * dup / (lines + 5)), np.log1p(100 * rep / (n + quality.PRIOR_WORDS))]
    use = ~((n < 10) | (100 * rep > 20 * n))
    mine = x[use]
    centre = np.median(mine, axis=0)
    scatter = np.diag(np.maximum(quality.FLOOR, 1.4826 * np.median(np.abs(mine - centre), axis=0)) ** 2)
    square = lambda v: np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(scatter), v - centre)
    for step in range(quality.STEPS + 1):
        d = square(mine)
        near = mine[d <= quality.CHI_REWEIGHT] if step == quality.STEPS else mine[np.argsort(d, kind="stable")[: int(np.ceil(quality.KEEP * len(mine)))]]
        scale = quality.SCALE_REWEIGHT if step == quality.STEPS else quality.SCALE_KEEP
        centre, scatter = near.mean(axis=0), np.cov(near.T, bias=True) * scale + np.diag(np.square(quality.FLOOR))
    want = square(x)
    got = np.array([r["_distance"] for r in rows])
    assert np.allclose(got, want, rtol=0.15, atol=0.3)
    sure = np.abs(want / quality.CUTOFF - 1) > 0.2
    assert [r["_kept"] for r, s in zip(rows, sure, strict=True) if s] == (use & (want <= quality.CUTOFF))[sure].tolist()
    assert not any(r["_kept"] for r in rows[300:])
