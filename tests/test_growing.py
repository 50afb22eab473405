"""Bounds of growing strings: a grammar as streaming state."""

import random
import time

import pytest

from joinery.kernels.string_repair import repair
from joinery.streaming import growing


def expanded(token, rules):
    """The text of a token."""
    return chr(token) if token < growing.FIRST_RULE else "".join(expanded(t, rules) for t in rules[token])


def test_compressed_tokens_spell_the_text():
    rng = random.Random(2)
    for n in (1, 5, 80, 400):
        text = "".join(rng.choices("abc", k=n))
        rules = {}
        tokens = [ord(c) for c in text]
        for _ in range(3):
            tokens, new = growing.compressed(tokens, {v: k for k, v in rules.items()}, growing.FIRST_RULE + len(rules))
            rules |= {token: pair for pair, token in new.items()}
        assert "".join(expanded(t, rules) for t in tokens) == text
        assert len(rules) + len(tokens) - 1 <= max(repair(text).bound, 0)


@pytest.fixture
def batches(spark, tmp_path):
    """Three files of shuffled rows of two keys, and each key's text."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", growing.PROVIDER)
    rng = random.Random(7)
    text = {"x": "", "y": ""}
    for b in range(3):
        rows = [(k, b * 100 + i, rng.choice(["abra", "cadabra", "xyz"]) if rng.random() < 0.9 else None) for k in ("x", "y") for i in range(30)]
        for k, _, piece in rows:
            text[k] += piece or ""
        rng.shuffle(rows)
        spark.createDataFrame(rows, "key string, at long, piece string").coalesce(1).write.parquet(f"{tmp_path}/in/b{b}")
        time.sleep(1.1)  # files are taken by their times
    stream = spark.readStream.schema("key string, at long, piece string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    yield stream, text
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def started(df, name, folder, **trigger):
    return df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{folder}/{name}").trigger(**trigger).start()


def test_grammars_grow_over_batches(spark, tmp_path, batches):
    stream, text = batches
    query = started(growing.growing_bounds(stream, "key", "piece", "at"), "grown", tmp_path, availableNow=True)
    assert query.awaitTermination(120)
    rows = spark.table("grown").collect()
    for k in ("x", "y"):
        mine = sorted((r for r in rows if r["key"] == k), key=lambda r: r["length"])
        assert [r["saved"] for r in mine] == sorted({r["saved"] for r in mine}) and len(mine) == 3
        last = mine[-1]
        assert last["length"] == len(text[k]) and last["bound"] == last["length"] - 1 - last["saved"]
        assert last["bound"] < len(text[k]) // 2


def test_a_key_that_rests_has_one_more_pass(spark, tmp_path, batches):
    stream, text = batches
    query = started(growing.growing_bounds(stream, "key", "piece", "at", rest_ms=1), "rested", tmp_path, processingTime="0 seconds")
    try:
        for _ in range(120):
            done = {r["key"]: r["best"] for r in spark.table("rested").groupBy("key").agg({"bound": "min", "length": "max"}).toDF("key", "best", "length").collect() if r["length"] == len(text[r["key"]])}
            counts = spark.table("rested").groupBy("key", "length").count().where("count > 1").count()
            if len(done) == 2 and counts:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert set(done) == {"x", "y"} and counts
