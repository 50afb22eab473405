"""Every operator on null, empty, very long, tied and repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from joinery.llm import crf, licenses, packing, quality, queries, sharding, simhash

BY_DOCUMENTS = ["op2_licenses", "op3_langid", "op4_bpe", "op5_token_counts", "op6_quality", "op7_shards", "op8_simhash"]


@pytest.mark.parametrize("name", BY_DOCUMENTS)
def test_one_row_per_document(spark, edge_docs, saved, name):
    rows = queries.queries()[name](spark, saved(documents=edge_docs)).collect()
    want = sorted((r["doc_id"] for r in edge_docs.select("doc_id").collect()), key=str)
    assert sorted((r["doc_id"] for r in rows), key=str) == want


@pytest.mark.parametrize("name", [*BY_DOCUMENTS, "op9_packing"])
def test_empty_table(spark, no_docs, saved, name):
    assert queries.queries()[name](spark, saved(documents=no_docs)).collect() == []


def test_packing_takes_every_row(spark, edge_docs):
    rows = packing.packed(edge_docs).collect()
    assert sum(r["piece"] == 0 for r in rows) == edge_docs.count()
    assert all((r["bin"] is None) == (r["n_tokens"] == 0) for r in rows)


def test_null_and_empty_texts(spark, edge_docs, saved):
    folder = saved(documents=edge_docs)
    row = lambda name, i: next(r for r in queries.queries()[name](spark, folder).collect() if r["doc_id"] == i)
    for i in (0, 1, 2):
        assert row("op3_langid", i)["lang_pred"] == "und"
        assert row("op8_simhash", i)["fingerprint"] == "0" * 16 and row("op8_simhash", i)["component_id"] == 0
        assert not row("op6_quality", i)["kept"] and row("op6_quality", i)["base_failed"]
    assert row("op4_bpe", 0)["n_tokens"] == row("op4_bpe", 1)["n_tokens"] == 0
    assert row("op7_shards", 0)["size"] == 16 and row("op7_shards", 0)["text_crc32"] == 0
    assert row("op2_licenses", 0)["labels"] == "" and row("op2_licenses", 0)["first_word"] is None


def test_stages_keep_columns(spark, edge_docs):
    for kept in (crf.recognised(edge_docs, 0.4), quality.passing(edge_docs), simhash.one_of_each(edge_docs)):
        assert kept.columns == edge_docs.columns
        kept.collect()


def test_one_of_each_group_stays(spark, edge_docs):
    kept = [r["doc_id"] for r in simhash.one_of_each(edge_docs).collect() if r["doc_id"] is not None]
    assert sorted(kept) == sorted(set(kept)) and 5 in kept and 6 not in kept and 0 in kept and 1 not in kept


def test_shards_number_repeated_rows(spark, edge_docs):
    rows = sharding.sharded(edge_docs, 4).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] in (5, 6)}) == 1


def test_scan_of_a_long_text(spark):
    docs = spark.createDataFrame([(1, "filler " * 30_000 + "released under the MIT License")], "doc_id long, text string")
    assert [d["label"] for d in licenses.scanned(docs).first()["detections"]] == ["mit"]


def test_pages_edges(spark, saved):
    from joinery.llm import op10_urls

    urls = [None, "", "nothing", "http://", "HTTP://Spam-Farm.Example.ORG/en/1?x", "x://a.com/fr/b#c", "://h", "a://b://c/d", "http://spam.net", "http://spam.net", "http://example.org/en/1", "http://org/x"]
    rows = [(i, u, None) for i, u in enumerate(urls)]
    pages = spark.createDataFrame([*rows, rows[4], (None, "http://casino.net/", None)], "page_id long, url string, html string").withColumn("listed", F.lit(1))
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in op10_urls.query(spark, saved(pages=pages)).collect()}
    assert got[0, "", ""] == got[2, "", ""] == (None, "allow")
    assert got[4, "spam-farm.example.org", "/en/1"] == ("example.org/en/1", "block")
    assert got[5, "a.com", "/fr/b"] == ("com/fr/", "allow")
    assert got[7, "b:", "//c/d"] == (None, "allow")
    assert got[8, "spam.net", ""] == (None, "block") and got[None, "casino.net", "/"] == (None, "block")
    assert got[11, "org", "/x"] == ("org/", "allow")
    assert op10_urls.query(spark, saved(pages=pages.limit(0))).count() == 0


def test_embeddings_edges(spark, saved):
    from joinery.llm import op01_pivots

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 0.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5]), (2, [1.0, 0.0]), (100, []), (0, [1.0, 0.0])]
    table = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in op01_pivots.query(spark, saved(embeddings=table)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 50, 100]
    assert sorted(got[0]) == sorted(2 * [(1, 1, 65536), (2, 2, 65536), (3, 2, 65536), (4, 7, 32768), (5, 50, 0)])  # query 0 is there twice
    assert [v for _, v, _ in sorted(got[100])] == [0, 0, 1, 2, 2]
    assert op01_pivots.query(spark, saved(embeddings=table.limit(0))).count() == 0


def test_encoded_ids_travel_with_rows(spark, edge_docs):
    from joinery.llm import bpe

    rows = bpe.encode(edge_docs).collect()
    coder = bpe.encoder()
    assert len(rows) == edge_docs.count()
    assert all(coder.decode(r["ids"]) == (r["_row"]["text"] or "").encode() for r in rows)
