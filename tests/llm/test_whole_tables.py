"""Queries over whole tables against plain versions, where SQL has none."""

import hashlib
import json
import random
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from joinery.llm import crf, packing, queries, wordpiece

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, data=DATA):
    return queries.queries()[name](spark, data).collect()


def test_encoded_digests_of_a_whole_table(spark, texts):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(spark, "op4_bpe")
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = coder.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_shards_of_a_whole_table(spark, texts):
    got = rows_of(spark, "op7_shards")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots, where, load = defaultdict(list), {}, Counter()
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert 0 <= r["shard"] < 40 and where.setdefault(data, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # no shard is over the mean by more than its largest group of equal texts
    groups = Counter()
    for r in got:
        groups[texts[r["doc_id"]] or ""] += r["size"]
    assert max(load.values()) <= sum(load.values()) / 40 + 2 * max(groups.values())


def test_packing_of_a_whole_table(spark, texts):
    counts = {r["doc_id"]: r["n_tokens"] for r in rows_of(spark, "op5_token_counts")}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op9_packing"):
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        if r["bin"] is not None:
            bins[r["pool"], r["bin"], r["bin_length"]].append((r["bin_offset"], r["n_tokens"]))
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():  # each token of each document once
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at == counts[doc]
    assert len({b[:2] for b in bins}) == len(bins)
    for (_, _, length), found in bins.items():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert length == next(x for x in packing.LENGTHS if x >= at)


def test_token_counts_of_whole_texts(spark, texts):
    """Each word's pieces spelled out: the longest token that begins what is left; a word that cannot be split counts as one."""
    with open(public_tokenizers.path(wordpiece.VOCABULARY), encoding="utf-8") as file:
        model = json.load(file)
    end = model["model"]["end_of_word_suffix"]
    vocabulary = set(model["model"]["vocab"]) - {t["content"] for t in model["added_tokens"]}
    shown = {b: c for c, b in wordpiece.byte_symbols().items()}

    def pieces(word):
        rest, n = [shown[b] for b in word.encode()], 0
        rest[-1] += end
        while rest:
            hold = [j for j in range(len(rest), 0, -1) if "".join(rest[:j]) in vocabulary]
            if not hold:
                return 1
            rest, n = rest[hold[0] :], n + 1
        return n

    known = {}
    split = wordpiece.counter().split
    for r in rows_of(spark, "op5_token_counts"):
        words = split(unicodedata.normalize("NFC", texts[r["doc_id"]] or "").lower())
        for word in words:
            if word not in known:
                known[word] = pieces(word)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_held_out_languages(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows_of(spark, "op3_langid", "/root/testdata/sf0.01") if r["held_out"] and langs[r["doc_id"]]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert len(held) > 50 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.95


def test_many_languages_are_fitted():
    rng = random.Random(3)

    def words():
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 12)
        return ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(150)]

    known = [words() for _ in range(60)]
    text = lambda i, n: " ".join(rng.choices(known[i], k=n))
    model = crf.fit([(text(i, 60), f"l{i:02}") for i in range(60) for _ in range(20)])
    asked = [(text(i, 40), f"l{i:02}") for i in range(60) for _ in range(3)]
    got = crf.Labeller(model).label([t for t, _ in asked])[0]
    assert np.mean([a == b for a, (_, b) in zip(got, asked, strict=True)]) > 0.9


def test_steps_sum_by_key():
    rng = np.random.default_rng(2)
    keys, rows = rng.integers(0, 9, 40), rng.random((40, 3))
    distinct, sums = crf._summed(keys, rows)
    assert np.allclose(sums, [rows[keys == k].sum(axis=0) for k in distinct])
    which = rng.integers(0, 40, 40)
    assert np.allclose(crf._summed(keys, rows, which)[1], [rows[which[keys == k]].sum(axis=0) for k in distinct])


def test_all_languages_share_the_drivers_budget(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'abcd'[i % 4]}x " * 500, "abcd"[i % 4]) for i in range(80)], "doc_id long, text string, lang string")
    drawn = []
    monkeypatch.setattr(crf, "fit", lambda samples: drawn.extend(samples))
    monkeypatch.setattr(crf, "ROWS", 5)
    monkeypatch.setattr(crf, "DRIVER_CHARS", 4000)
    crf.train(docs)
    assert {lang for _, lang in drawn} == set("abcd") and sum(len(t) for t, _ in drawn) <= 4000
