"""Each method against brute force."""

import base64
import random
import re
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from joinery.llm import bpe, cascade, crf, licenses, packing, pivots, quality, sharding, simhash, wordpiece


def test_fingerprint_by_definition():
    random.seed(5)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(random.choice(["A", "b", "été", "Zoë", "x1"]) for _ in range(n))
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_gray_rank_is_the_sequence():
    code = [i ^ (i >> 1) for i in range(64)]
    assert simhash.gray_rank(np.array(code, np.uint64)).tolist() == list(range(64))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_index_links_as_brute_force(radius):
    rng = np.random.default_rng(radius)
    for _ in range(12):
        values = set()
        for centre in rng.integers(0, 1 << 63, 4, dtype=np.uint64):
            for _ in range(int(rng.integers(1, 150))):
                flips = rng.integers(0, 64, int(rng.integers(0, radius + 3)))
                values.add(int(centre) ^ sum({1 << int(b) for b in flips}))
        values = np.array(sorted(values), np.uint64)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
        label = np.arange(len(values))
        while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
            label = new
        left, right = simhash.GrayIndex(values).links(radius)
        got = simhash.merge(np.arange(len(values)), left, right)
        assert len(set(zip(label, got, strict=True))) == len(set(label)) == len(set(got))
        assert len(simhash.GrayIndex(values).search(values, radius)[0]) == near.sum()


def test_masks_meet_every_near_pair():
    random.seed(1)
    for radius in (1, 2, 3):
        for _ in range(500):
            a = random.getrandbits(64)
            b = a ^ sum(1 << i for i in random.sample(range(64), radius))
            assert any(a & m == b & m for m in simhash.masks(radius))


def test_groups_as_brute_force(spark):
    random.seed(3)
    base = " ".join(random.choice("abcdefghij") + str(random.randrange(50)) for _ in range(400))
    texts = [base, base.upper(), base + " end", "other words here " * 3, "", None, base.replace("a1 ", "a2 "), base, "unlike all of these"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(texts))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(label))


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) if i % 2 else (i + 1, i) for i in range(n)] + [(1000, 1001)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[1001] == 1000


@pytest.fixture(scope="module")
def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(reference_encoding):
    coder = bpe.encoder()
    random.seed(2)
    parts = ["the", " The", "ing", "é", "ß", "😀", "\n", "  ", "\t", "123", "'s", "<|endoftext|>", "ø" * 9, "a" * 40, "\u2028", "\x1c", "—"]
    for _ in range(300):
        text = "".join(random.choice(parts) for _ in range(random.randrange(60)))
        ids = coder.encode(text)
        assert ids == reference_encoding.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_appends_and_edits():
    vocab = bpe.vocabulary()
    random.seed(4)
    for _ in range(40):
        data = bytes(random.choice(b"abcdething ") for _ in range(300))
        table = bpe.Prefixes(vocab, data[:100])
        table.append(data[100:])
        assert table.ids() == vocab.merged(data) and table.ids(57) == vocab.merged(data[:57])
        start = random.randrange(250)
        stop = start + random.randrange(20)
        new = bytes(random.choice(b"abcdething ") for _ in range(random.randrange(12)))
        table.splice(start, stop, new)
        assert table.data == data[:start] + new + data[stop:]
        assert table.ids() == vocab.merged(table.data)


def greedy(word, first, inner):
    at, count = 0, 0
    while at < len(word):
        pool = first if at == 0 else inner
        size = next((n for n in range(len(word) - at, 0, -1) if tuple(word[at : at + n]) in pool), None)
        if size is None:
            return None
        at, count = at + size, count + 1
    return count


def test_longest_match_as_greedy():
    random.seed(6)
    for _ in range(60):
        some = lambda: {tuple(random.choice("abc") for _ in range(random.randrange(1, 5))) for _ in range(random.randrange(1, 12))}
        first, inner = some(), some()
        same, split = wordpiece.LongestMatch(sorted(first)), wordpiece.LongestMatch(sorted(first), sorted(inner))
        for n in range(1, 7):
            for word in product("abc", repeat=n):
                assert same.count(word) == greedy(word, first, first)
                assert split.count(word) == greedy(word, first, inner)


def test_token_counts_of_texts():
    count = wordpiece.counter()
    words, tokens = count.counts("The quick brown fox, isn't it? Zürich 2024 😀")
    assert words == len(count.split("the quick brown fox, isn't it? zürich 2024 😀")) and tokens >= words
    assert count.counts("a b") == (2, 2) and count.counts("") == count.counts(None) == (0, 0)


def test_quality_counts_by_definition():
    random.seed(7)
    for _ in range(200):
        text = "".join(random.choice(["a", "b ", " ", "\n", "a b c d e ", "#", "x|y ", "é ", "\x0b", "\u00a0"]) for _ in range(random.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))
        assert quality.counts(text) == want


def test_repeats_with_a_large_vocabulary():
    words = [str(i).encode() for i in range(9000)]
    assert quality.repeated(words) == 0
    assert quality.repeated(words + words[100:107]) == 14


def test_outliers_are_found_and_clean_texts_kept(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("aeioustrnl") for _ in range(random.randrange(2, 9)))
    clean = [" ".join(word() for _ in range(random.randrange(15, 400))) for _ in range(400)]
    junk = ["#$% " + " ".join(f"{word()}{random.choice(['***', '$$$', '|||'])}" for _ in range(80)) for _ in range(20)]
    rows = [(i, t, "en", ["hot", "hot", f"s{i % 40}"][i % 3]) for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["_row"]["doc_id"]: r["_kept"] for r in quality.judged(docs, ["doc_id"]).collect()}
    assert all(kept[i] for i in range(len(clean))) and not any(kept[i] for i in range(len(clean), len(rows)))
    assert {r["doc_id"] for r in quality.passing(docs).collect()} == {i for i, k in kept.items() if k}


def test_marginals_as_enumeration():
    rng = np.random.default_rng(0)
    emit, move, start, lengths = rng.random((9, 3)), rng.random((3, 3)), rng.random(3), np.array([3, 1, 5])
    got, pairs = crf.marginals(emit, lengths, move, start, pairs=True)
    at, expected, moved = 0, [], np.zeros((3, 3))
    for n in lengths:
        each, joint, total = np.zeros((n, 3)), np.zeros((3, 3)), 0
        for y in product(range(3), repeat=int(n)):
            w = start[y[0]] * np.prod([emit[at + i, y[i]] for i in range(n)]) * np.prod([move[y[i], y[i + 1]] for i in range(n - 1)])
            total += w
            for i in range(n):
                each[i, y[i]] += w
            for i in range(n - 1):
                joint[y[i], y[i + 1]] += w
        expected.append(each / total)
        moved += joint / total
        at += n
    assert np.allclose(got, np.concatenate(expected)) and np.allclose(pairs, moved)


def test_language_of_held_out_texts():
    random.seed(9)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "er"], "cc": ["eau", "oi", "ment", "re"]}
    text = lambda lang, n=40: " ".join("".join(random.choice(parts[lang]) for _ in range(random.randrange(1, 4))) for _ in range(n))
    model = crf.fit([(text(lang), lang) for lang in parts for _ in range(30)])
    labeller = crf.Labeller(model)
    tests = [(text(lang, n), lang) for lang in parts for n in (3, 30) for _ in range(20)]
    langs, scores = labeller.label([t for t, _ in tests])
    assert np.mean([a == b for a, (_, b) in zip(langs, tests, strict=True)]) > 0.95
    mixed = labeller.word_probabilities(f"{text('aa', 20)} {text('cc', 20)}")
    assert (mixed[:18].argmax(axis=1) == 0).all() and (mixed[22:].argmax(axis=1) == 2).all()
    assert labeller.label([None, "", "12 .", "ka"])[0][:3] == ["und"] * 3 and all(0 <= s <= 1 for s in scores)
    assert crf.Labeller(crf.fit([])).label(["x"]) == (["und"], [0.0])


def least_by_force(sizes, shards):
    def best(at, left):
        if left == 1:
            return sum(sizes[at:])
        return min(max(sum(sizes[at:i]), best(i, left - 1)) for i in range(at, len(sizes) + 1))

    return best(0, shards)


def test_minimax_partition_as_brute_force():
    random.seed(10)
    for _ in range(150):
        sizes = np.array([random.choice([1, 2, 3, 50]) for _ in range(random.randrange(1, 9))])
        shards = random.randrange(1, 5)
        cuts = [0, *sharding.partition(sizes, shards).tolist(), len(sizes)]
        assert cuts == sorted(cuts) and len(cuts) == shards + 1
        assert max(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:], strict=False)) == sharding.least_capacity(sizes, shards) == least_by_force(sizes.tolist(), shards)


def test_even_cuts_beside_a_large_group():
    sizes = np.array([1] * 300 + [600] + [1] * 300)
    cuts = [0, *sharding.partition(sizes, 10).tolist(), len(sizes)]
    loads = sorted(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:], strict=False))
    assert loads[-1] <= 660 and loads[0] > 0


def test_packing_holds_and_is_cheap():
    random.seed(11)
    for _ in range(60):
        sizes = sorted((random.randrange(1, 65) for _ in range(random.randrange(1, 40))), reverse=True)
        lengths = (16, 32, 64)
        bins, offsets, closed = packing.plan(sizes, lengths)
        fill = {}
        for b, o, s in zip(bins, offsets, sizes, strict=True):
            assert o == fill.get(b, 0)
            fill[b] = o + s
        assert all(fill[b] <= closed[b] and closed[b] == min(x for x in lengths if x >= fill[b]) for b in fill)
        cost = sum(map(packing.price, closed))
        assert all(cost <= sum(map(packing.price, packing.best_fit(sizes, lengths, p)[2])) for p in lengths)
        assert cost <= sum(packing.price(min(x for x in lengths if x >= s)) for s in sizes)


def test_best_fit_takes_the_tightest_bin():
    # by hand: 40 | 30 | 24 joins 40 | 20 joins 30 | 14 joins 30 + 20
    bins, offsets, closed = packing.best_fit([40, 30, 24, 20, 14], (64,), 64)
    assert bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 40, 30, 50] and closed == [64, 64]


def test_packing_near_the_optimum_on_small_pools():
    random.seed(12)

    def optimum(sizes, lengths):
        best = [float("inf")]

        def place(i, fill):
            if i == len(sizes):
                best[0] = min(best[0], sum(packing.price(min(x for x in lengths if x >= f)) for f in fill))
                return
            for b in range(len(fill)):
                if fill[b] + sizes[i] <= lengths[-1]:
                    fill[b] += sizes[i]
                    place(i + 1, fill)
                    fill[b] -= sizes[i]
            place(i + 1, [*fill, sizes[i]])

        place(0, [])
        return best[0]

    for _ in range(25):
        sizes = sorted((random.randrange(100, 1000) for _ in range(6)), reverse=True)
        got = sum(map(packing.price, packing.plan(sizes, (256, 512, 1024))[2]))
        assert optimum(sizes, (256, 512, 1024)) <= got <= 1.35 * optimum(sizes, (256, 512, 1024))


def test_long_documents_are_cut_whole(spark):
    docs = spark.createDataFrame([(1, "word " * 20_001), (2, "short one"), (3, "")], "doc_id long, text string")
    rows = packing.packed(docs).collect()
    mine = sorted((r["start"], r["n_tokens"], r["bin_length"]) for r in rows if r["doc_id"] == 1)
    assert [m[:2] for m in mine] == [(0, 8192), (8192, 8192), (16384, 3617)]
    used = {}
    for r in rows:
        if r["bin"] is not None:
            used.setdefault((r["pool"], r["bin"]), []).append((r["bin_offset"], r["n_tokens"], r["bin_length"]))
    for pieces in used.values():
        at = 0
        for offset, n, length in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length


@pytest.mark.parametrize("listed, unlisted", [(0, 50), (50, 0), (200, 5000), (3000, 300)])
def test_cascade_is_exact(listed, unlisted):
    yes, no = [f"y{i}" for i in range(listed)], [f"n{i}" for i in range(unlisted)]
    made = cascade.Cascade.unpack(cascade.Cascade.build(yes, no).pack())
    assert made.test(yes).all() and not made.test(no).any()


def test_cogrouped_cascades_agree(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"h{i % 50}") for i in range(400)], "page long, host string")
    listed = spark.createDataFrame([(f"h{i}",) for i in range(0, 70, 7)], "key string")
    monkeypatch.setattr(cascade, "SHARD_KEYS", 10)
    want = {i: i % 50 % 7 == 0 for i in range(400)}
    assert {r["page"]: r["listed"] for r in cascade.with_membership(rows, F.col("host"), listed).collect()} == want
    monkeypatch.setattr(cascade, "BROADCAST_BYTES", 0)
    assert {r["page"]: r["listed"] for r in cascade.with_membership(rows, F.col("host"), listed).collect()} == want


def test_pivot_search_is_exact():
    rng = np.random.default_rng(13)
    for dim, spread in ((2, 3), (16, 90)):
        vectors = np.floor(rng.normal(0, spread, (700, dim)))
        vectors[100:300] = vectors[100]
        ids, queries = np.arange(700), vectors[::50]
        largest = float((vectors**2).sum(axis=1).max())
        chosen = pivots.pick(vectors[:64], largest)
        table = pivots.distances(vectors, np.sqrt(np.maximum(0, largest - (vectors**2).sum(axis=1))), chosen)
        q, x, score, looked = pivots.search(ids, vectors, table, ids[::50], queries, pivots.distances(queries, np.zeros(len(queries)), chosen), largest, 5)
        for i in range(len(queries)):
            exact = sorted(((-float(vectors[j] @ queries[i]), j) for j in ids if j != i * 50))[:5]
            assert [(-s, j) for s, j in zip(score[q == i], x[q == i], strict=True)] == exact
        if dim == 2:
            assert looked < 0.6 * len(queries) * len(ids)


def test_pivot_cells_eliminate_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (12, 16))
    near = (centres[np.r_[np.zeros(800, int), rng.integers(0, 12, 1600)]] + rng.integers(-9, 10, (2400, 16))).astype(int)
    rows = [(i, v.tolist()) for i, v in enumerate(near)] + [(7, near[7].tolist())] * 2 + [(40, near[40].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 200)
    monkeypatch.setattr(pivots, "BLOCK_QUERIES", 10)
    asked = []
    monkeypatch.setattr(pivots, "_searched", lambda r, q, g, f, real=pivots._searched: asked.append((r.select("b").distinct().count(), q.count())) or real(r, q, g, f))
    got = sorted(map(tuple, pivots.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5).collect()))
    matrix = np.array([v for _, v in rows])
    want = []
    for i, q in rows:
        if i % 20 == 0:
            score = matrix @ np.array(q)
            best = sorted((-int(s), j) for s, (j, _) in zip(score, rows, strict=True) if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    (blocks, queries), (_, met) = asked
    assert queries == 120 and met < 0.5 * queries * (blocks - 1)


def scan_by_force(text):
    line = " " + " ".join(re.findall(licenses.WORD, text.translate(str.maketrans(licenses._UPPER, licenses._LOWER)))) + " "
    found = [(r["priority"], m.end() - m.start(), -r["number"], m.start(), m.end(), r["label"]) for r in licenses.rules() for m in re.finditer(f"(?<= )(?:{r['pattern']})(?= )", line)]
    return sorted((d[3], d[4], d[5]) for d in found if not any(e[3] <= d[3] and e[4] >= d[4] and e[:3] > d[:3] for e in found))


def test_scans_as_brute_force(spark):
    random.seed(14)
    parts = ["Released under the MIT License", "Apache License, Version 2.0", "CC BY-NC-SA 4.0", "cc by nc", "GNU GPL v3", "SPDX-License-Identifier: BSD-3-Clause", "all rights reserved", "the unlicense", "Copyright (c) 1999-2004", "licensed under the terms of the GNU Lesser General Public License version 2.1", "public domain", "word", "İK", "released under the gpl 2", "provided under zlib"]
    texts = [" ".join(random.choice(parts) for _ in range(random.randrange(8))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: sorted((d["at"], d["stop"], d["label"]) for d in r["detections"]) for r in licenses.scanned(docs).collect()}
    assert got == {i: scan_by_force(t) for i, t in enumerate(texts)}
    assert 200 <= len(licenses.rules())


def sample(tree, rng):
    """A string that a parsed regular expression matches."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op in ("NOT_LITERAL", "ANY"):
            out += "q"
        elif op == "IN":
            kind, what = rng.choice(value)
            out += {"LITERAL": lambda: chr(what), "RANGE": lambda: chr(what[0]), "NEGATE": lambda: "q"}[str(kind)]()
        elif op == "MAX_REPEAT":
            low, high, part = value
            out += "".join(sample(part, rng) for _ in range(rng.choice([low, min(high, low + 1)])))
        elif op == "SUBPATTERN":
            out += sample(value[3], rng)
        else:
            assert op == "BRANCH"
            out += sample(rng.choice(value[1]), rng)
    return out


def test_gates_let_every_rule_through():
    from re import _parser

    rng = random.Random(15)
    for rule in licenses.rules():
        tree = _parser.parse(rule["pattern"])
        for _ in range(60):
            text = sample(tree, rng)
            assert re.fullmatch(rule["pattern"], text)
            assert re.search(licenses.GATE, f"x {text} y") and any(k in text for k in rule["keyword"].split("|")), (rule, text)
    assert all(re.search(licenses.GATE, phrase) for phrase in licenses.BASE)


def test_wide_fingerprints_measure_similarity():
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    near, far = [], []
    for _ in range(60):
        words = [word() for _ in range(300)]
        for changes, out in ((4, near), (30, far)):
            other = list(words)
            for i in rng.sample(range(300), changes):
                other[i] = word()
            a, b = (int.from_bytes(simhash.wide_fingerprint(" ".join(w))) for w in (words, other))
            out.append((a ^ b).bit_count())
    assert sum(d <= simhash.most_differing() for d in near) >= 58 and not any(d <= simhash.most_differing() for d in far)
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" ") == bytes(simhash.WIDE_BITS // 8)


def test_tables_find_near_pairs():
    rng = np.random.default_rng(18)
    cut = simhash.tables(1000)
    found = 0
    for _ in range(400):
        differ = np.zeros(simhash.WIDE_BITS, bool)
        differ[rng.permutation(simhash.WIDE_BITS)[: simhash.most_differing()]] = True
        found += any(not differ[c].any() for c in cut)
    assert found >= 0.9 * 400


def test_runs_are_linked(monkeypatch):
    rng = np.random.default_rng(19)
    centre = rng.integers(0, 1 << 62, (3, 8)).astype(np.uint64)
    which = rng.integers(0, 3, 500)
    wide = centre[which].copy()
    for row in wide:
        row[rng.integers(0, 8)] ^= np.uint64(1 << int(rng.integers(0, 60)))
    key, node = np.where(np.arange(500) < 40, np.arange(500) % 7, 99), np.arange(500) * 10
    for exact in (2048, 16):
        monkeypatch.setattr(simhash, "EXACT_RUN", exact)
        u, v = simhash.near_runs(key, wide, node, 20)
        label = simhash.merge(np.arange(500), u // 10, v // 10)
        for a in range(500):
            for b in range(a):
                if key[a] == key[b]:
                    assert (label[a] == label[b]) == (which[a] == which[b])


def test_long_runs_link_chains():
    """Rows that are near a leader still link what only they are near to; as all pairs do."""
    rng = np.random.default_rng(23)
    rows = []
    for c in range(12):  # chains of steps of 60 bits, whose ends are far beyond the limit of 89, with dense copies around
        bits = rng.integers(0, 2, simhash.WIDE_BITS).astype(np.uint8)
        where = rng.permutation(simhash.WIDE_BITS)
        for step in range(1 + c % 5):
            bits = bits.copy()
            bits[where[60 * step : 60 * (step + 1)]] ^= 1
            for _ in range(60):
                row = bits.copy()
                row[rng.integers(0, simhash.WIDE_BITS, 3)] ^= 1
                rows.append(row)
    wide = np.packbits(np.array(rows)[rng.permutation(len(rows))], axis=1).view(np.uint64)
    wide = np.concatenate([wide, rng.integers(0, 1 << 63, (simhash.EXACT_RUN, 8)).astype(np.uint64)])
    u, v = simhash.near_runs(np.zeros(len(wide), np.int64), wide, np.arange(len(wide)), 89)
    got = simhash.merge(np.arange(len(wide)), u, v)
    a, b = zip(*[(np.full(len(near), i), i + 1 + near) for i in range(len(wide)) if len(near := np.flatnonzero(np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(axis=1) <= 89))], strict=True)
    want = simhash.merge(np.arange(len(wide)), np.concatenate(a), np.concatenate(b))
    assert (got == want).all()


def changed(rng, words, share):
    """Words with runs of new ones, so that about this share of the five-word shingles stays common to both."""
    words, n = list(words), round(len(words) * (1 - share) / (1 + share))
    at = rng.randrange(len(words) - n)
    return words[:at] + ["".join(rng.choice("klmnop") for _ in range(6)) for _ in range(n)] + words[at + n :]


def test_similar_sets_are_linked_as_by_brute_force(monkeypatch):
    rng = random.Random(31)
    texts = []
    for _ in range(12):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randrange(20, 90))]
        texts += [" ".join(words), *[" ".join(changed(rng, words, s)) for s in (0.9, 0.82, 0.79, 0.7)]]
    sets = [simhash.shingle_set(t) for t in [*texts, "", None, "word"]]
    group = np.arange(len(sets)) * 7
    u, v = simhash.similar_links(group, sets, 0.8)
    got = simhash.merge(np.arange(len(sets)), u // 7, v // 7)
    plain = [set(simhash._shingles(simhash.words_of(t), 5)) for t in texts]
    a, b = zip(*[(i, j) for i in range(len(plain)) for j in range(i) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])], strict=True)
    want = simhash.merge(np.arange(len(sets)), np.array(a), np.array(b))
    assert (got == want).all() and len(set(want.tolist())) < len(sets)


def far_pairs(count):
    """Pairs of texts similar at 0.8 or more whose wide fingerprints differ in more bits than most_differing()."""
    rng, out = random.Random(32), []
    while len(out) < count:
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
        other = changed(rng, words, 0.87)
        x, y = (set(simhash._shingles([w.encode() for w in p], 5)) for p in (words, other))
        a, b = (int.from_bytes(simhash.wide_fingerprint(" ".join(p))) for p in (words, other))
        if 5 * len(x & y) >= 4 * len(x | y) and simhash.most_differing() < (a ^ b).bit_count() <= simhash.most_differing(deviations=simhash.CANDIDATE_SD):
            out.append((" ".join(words), " ".join(other)))
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_similar_texts_of_far_fingerprints_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    pairs = far_pairs(12)
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert kept == list(range(0, 24, 2))
    groups = {r["doc_id"]: r["group"] for r in simhash.similar_groups(docs, estimate=False).collect()}
    assert len(set(groups.values())) == 12 and all(groups[2 * i] == groups[2 * i + 1] for i in range(12))


def test_clashing_doc_ids_keep_their_texts(spark):
    text = lambda seed: " ".join(str(random.Random(seed + i).random()) for i in range(40))
    rows = [(1, text(100)), (5, text(100)), (5, text(200)), (5, text(200)), (6, text(300)), (6, text(400)), (7, text(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == sorted({(1, text(100)), (5, text(200)), (6, text(300)), (6, text(400))})


def test_languages_of_long_texts_are_learned(spark):
    rng = random.Random(33)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, text("abcdefg", 40), "aa") for i in range(40)] + [(100 + i, text("uvwxyz", 8000), "uu") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(r[1]) for r in rows[40:]) > crf.ROW_CHARS
    model = crf.train(docs)
    assert sorted(model.labels) == ["aa", "uu"]
    assert crf.Labeller(model).label([text("uvwxyz", 30), text("abcdefg", 30)])[0] == ["uu", "aa"]
