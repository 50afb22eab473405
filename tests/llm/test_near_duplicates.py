"""Near-duplicate groups against brute force, on whole tables and on planted runs."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from joinery.llm import queries, simhash

DATA = "/root/testdata/sf0.001"


def joined(n, left, right):
    return simhash.merge(np.arange(n), np.array(left, np.int64), np.array(right, np.int64))


@pytest.mark.parametrize("bucket, piece", [(4096, 16_384), (16, 8)])
def test_op8_as_brute_force(spark, monkeypatch, bucket, piece):
    """The query's components on the whole table; small buckets are cut into pieces."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(simhash, "PIECE_ROWS", piece)
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    prints = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    label = joined(len(rows), near[:, 1], near[:, 0])
    want = {rows[i][0]: (f"{int(prints[i]):016x}", rows[label[i]][0]) for i in range(len(rows))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.queries()["op8_simhash"](spark, DATA).collect()}
    assert got == want and len(set(label.tolist())) < len(rows)


def test_the_tree_answers_searches(spark):
    """Most pairs of a bucket of real fingerprints are dropped in groups, far from all are compared."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    prints = np.unique(np.array([simhash.fingerprint(t) for t in texts], np.uint64))
    index = simhash.GrayIndex(prints)
    left, right = index.links(2)
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    assert (simhash.merge(np.arange(len(prints)), left, right) == joined(len(prints), near[:, 1], near[:, 0])).all()
    assert index.compared < 0.3 * len(prints) * (len(prints) - 1) / 2


def test_masks_of_few_bits_meet_every_near_pair():
    rng = random.Random(41)
    for radius in (0, 1, 2, 3):
        for bits in (0, 3, 64):
            masks = simhash.masks(radius, bits)
            assert all(m.bit_count() <= bits for m in masks)
            for _ in range(300):
                a = rng.getrandbits(64)
                b = a ^ sum(1 << i for i in rng.sample(range(64), radius))
                assert any(a & m == b & m for m in masks)


def test_band_keys_meet_at_their_similarity():
    rng = np.random.default_rng(42)
    met = Counter()
    for similarity in (0.8, 0.3):
        for _ in range(200):
            common = rng.integers(0, 1 << 63, int(300 * similarity), dtype=np.uint64)
            own = [rng.integers(0, 1 << 63, int(150 * (1 - similarity)), dtype=np.uint64) for _ in range(2)]
            keys = [set(simhash.band_keys(np.unique(np.concatenate([common, x]))).tolist()) for x in own]
            assert len(keys[0]) == simhash.BANDS
            met[similarity] += bool(keys[0] & keys[1])
    assert met[0.8] == 200 and met[0.3] < 150


def test_recall_of_similar_pairs(spark):
    """Of all pairs of different texts of sf0.01 whose sets of five-word shingles are similar at 0.8, found by an inverted list."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    texts = {r["text"]: r["doc_id"] for r in rows}
    sets = {i: set(simhash.shingle_set(t).tolist()) for t, i in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter(pair for h in holders.values() if len(h) > 1 for pair in combinations(sorted(h), 2))
    pairs = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    group = {r["doc_id"]: r["group"] for r in simhash.similar_groups(docs, estimate=False).collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) >= 5 and found >= 0.9 * len(pairs)


def test_a_run_of_thousands_of_near_copies(spark, monkeypatch):
    """Near copies that all share keys: one group, in one run or cut into pieces; no clean text is in it."""
    rng = random.Random(43)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, texts = [word() for _ in range(120)], []
    for i in range(2300):
        words = list(base)
        at = rng.randrange(115)
        words[at : at + 3] = [word() for _ in range(3)]
        texts.append(" ".join(words))
    clean = [" ".join(word() for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, *clean])), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(simhash, "MEETING_ROWS", 700)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, *range(2300, 2340)]


def test_repeated_rows_of_kept_documents(spark):
    text = lambda seed: " ".join(str(random.Random(seed + i).random()) for i in range(30))
    rows = [(1, text(1), "a"), (1, text(1), "b"), (2, text(1), "c"), (3, text(99), "d"), (None, text(1), "e"), (None, text(1), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string")
    kept = [(r["doc_id"], r["_doc"]) for r in simhash.one_of_each(docs).collect()]
    assert sorted(k for k in kept if k[0] is None) == [(None, "e"), (None, "f")]
    assert sorted(k[0] for k in kept if k[0] is not None) == [1, 3]


def test_streamed_runs_are_linked_as_whole_ones():
    import pyarrow as pa

    rng = np.random.default_rng(44)
    run = np.sort(rng.integers(0, 40, 900))
    wide = rng.integers(0, 1 << 63, (30, 8), dtype=np.uint64)[rng.integers(0, 30, 900)]
    wide[:, 0] ^= rng.integers(0, 64, 900).astype(np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(run), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(np.arange(900))], ["run", "wide", "node"])
    for size in (900, 7, 100):
        out = list(simhash._near(20, 60)(batch.slice(at, size) for at in range(0, 900, size)))
        u, v = (np.concatenate([b.column(c).to_numpy() for b in out if b.num_rows and b.column("near")[0].as_py()]) for c in ("u", "v"))
        got = simhash.merge(np.arange(900), u, v)
        want = joined(900, *simhash.near_runs(run, wide, np.arange(900), 20))
        assert (got == want).all()
