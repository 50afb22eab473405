"""Content sort, divergence of sources and importance resampling against plain versions, row by row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinery.llm import contentsort, divergence, licenses, queries, resampling

NAMES = ["op11_content_sort", "op12_divergence", "op13_resampling"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def copies_by_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, sha) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["4", "40"])
def test_content_sort_cuts_hot_texts(spark, saved, parts):
    rng = random.Random(5)
    hot = ["a hot  text\n", "a hot text ", "another\thot one"]
    rows = [(i, rng.choice(hot) if rng.random() < 0.6 else f"text {rng.randrange(300)} " * rng.randrange(1, 4)) for i in range(3000)]
    rows += [(i, "w" * 32 + str(i % 7)) for i in range(3000, 3100)]  # texts with one head
    rows += [(None, hot[0]), (None, hot[0]), (7, "a hot text "), (7, "a hot text "), (8, None), (9, ""), (10, "\n"), (11, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        prepared = docs.select(F.xxhash64(contentsort.normalised(F.col("text"))).alias("_hash"))
        assert max(r["_parts"] for r in contentsort.hot_texts(prepared).collect()) > 1
        got = rows_of(queries.queries()["op11_content_sort"](spark, saved(documents=docs)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == copies_by_force(rows)


def test_content_sort_keeps_rows_as_they_are(spark, edge_docs):
    kept = contentsort.one_of_each_text(edge_docs)
    assert kept.columns == edge_docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    want = [g[0] for g in copies_by_force([(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]) if g[3]]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def audit_by_force(rows, least_docs, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        in_docs = Counter(t for _, _, words in mine for t in set(words))
        kept = sorted(t for t, n in in_docs.items() if n >= least_docs)
        counts = {s: Counter(t for _, x, words in mine if x == s for t in words if in_docs[t] >= least_docs) for s in {r[1] for r in mine}}
        total = sum(counts.values(), Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(total)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_divergence_by_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(2)
    words = ["alpha", "Beta", "été", "ß", "x1y", "naïve", "tie", "eit", "ÉTÉ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", None])) for _ in range(300)]
    rows += [(None, "only", "one"), (None, "none", "x"), ("few words", "none", "y"), (None, None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "p": F.lit("clash"), "entries": F.lit("clash")})
    got = rows_of(divergence.audit(docs), "lang", "source", "part", "item", "value", "rank")
    assert got == audit_by_force(rows, 10, 10)


def test_divergence_counts_beyond_32_bits(spark):
    count, whole = 3 * 10**14, 10**15
    df = spark.createDataFrame([(count, whole)], "c long, w long").select(divergence.probability(F.col("c"), F.col("w")))
    assert df.first()[0] == 1 + 10**9 * (count + 2) // whole


def resampled_by_force(docs, target, seed, percent, longest, buckets, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(words(t)))
    t = Counter(bucket(g) for x in target for g in grams(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc_id, text in docs:
        found = grams(words(text))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in found)
        rows.append((doc_id, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    part = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for i, r in enumerate(part[: percent * len(part) // 100]):
        ranks[r].append(i + 1)
    return sorted((r + ((ranks[r].pop() if ranks[r] else None),) for r in rows), key=repr)


@pytest.mark.parametrize(("longest", "remembered"), [(1, 10**6), (3, 10**6), (2, 40)])
def test_resampling_by_force(spark, monkeypatch, longest, remembered):
    monkeypatch.setattr(resampling, "REMEMBERED", remembered)
    monkeypatch.setattr(resampling, "SLICE_CHARS", 500)
    rng = random.Random(8)
    words = ["one", "Two", "ÉTÉ", "ß", "4x", "½"] + [f"w{i}" for i in range(60)]
    text = lambda: ", ".join(rng.choices(words, k=rng.randrange(0, 60)))
    docs = [(i, text()) for i in range(400)] + [(401, None), (402, ""), (5, "w1 " * 25), (5, "w1 " * 25), (None, "w2 " * 5000)]
    target = [text() for _ in range(20)] + [None, "w1 w2 w3 " * 30]
    got = resampling.resampled(
        spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "_text": F.lit("clash"), "rank": F.lit(1)}),
        spark.createDataFrame([(t,) for t in target], "text string"), 2024, 10, longest, 100, 20,
    )
    assert rows_of(got, "doc_id", "n_words", "n_features", "weight", "score", "rank") == resampled_by_force(docs, target, 2024, 10, longest, 100, 20)


def test_a_tuple_is_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(resampling.Hasher, "hashed", lambda self, gram: hashed.append(gram) or zlib.crc32(gram) % self.buckets)
    hasher = resampling.Hasher(2, 50)
    for at, found in hasher.grams([b"a", b"b", b"a", b"b", b"a"], np.array([3, 2])):
        assert len(at) == len(found)
    assert sorted(hashed) == [b"a", b"a b", b"b", b"b a"]


@pytest.mark.parametrize("name", NAMES)
def test_edges_and_empty_tables(spark, edge_docs, no_docs, saved, name):
    bench = spark.createDataFrame([(0, "the same text here again"), (1, None)], "item_id long, text string")
    got = queries.queries()[name](spark, saved(documents=edge_docs, benchmark=bench))
    if name == "op12_divergence":
        plain = [tuple(r) for r in edge_docs.select("text", "lang", "source").collect()]
        assert rows_of(got, "lang", "source", "part", "item", "value", "rank") == audit_by_force(plain, 10, 10)
    else:
        want = sorted((r["doc_id"] for r in edge_docs.select("doc_id").collect()), key=str)
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == want
    assert queries.queries()[name](spark, saved(documents=no_docs, benchmark=bench.limit(0))).collect() == []


def test_content_sort_has_no_python(spark, edge_docs, saved):
    docs = spark.read.parquet(saved(documents=edge_docs) + "/documents.parquet")
    plan = contentsort.sorted_runs(docs, ["doc_id"], "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "rangepartitioning" in plan
    # of the sampled texts' counts only: runs and their sizes are found in the ranges as they are
    assert plan.count("hashpartitioning") == 1


def test_long_license_dumps(spark):
    from test_methods import scan_by_force

    rng = random.Random(6)
    parts = ["Released under the MIT License", "Apache License, Version 2.0", "CC BY-NC-SA 4.0", "GNU GPL v3", "all rights reserved", "SPDX-License-Identifier: BSD-3-Clause", "licensed under the terms of the GNU Lesser General Public License version 2.1", "word"]
    long = ". ".join(rng.choices(parts, k=3000))
    docs = spark.createDataFrame([(0, long), (1, long * 8), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: sorted((d["at"], d["stop"], d["label"]) for d in r["detections"]) for r in licenses.scanned(docs).collect()}
    want = scan_by_force(long)
    assert len(want) > 2000 and got[0] == want and got[2] == []
    assert len(long) * 8 > 700_000 and 8 * len(want) - 8 <= len(got[1]) <= 8 * len(want) + 8
