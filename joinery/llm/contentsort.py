"""Exact deduplication by content sort; DataFrame functions only.

Rows are dealt by sampled splitters over (head of the normalised text, hash of all of it, part), so that equal texts meet.
Inside a range an external sort puts equal texts next to each other; each row is compared in full with its neighbour, and
a run of equal texts keeps its smallest identifier.

The range key has a bounded length: splitters are sent to the driver, and whole texts could be of any size. A text that a
bounded sample finds often is cut into parts by identifier, so that no range is much larger than others whatever share of
the rows it has; the few parts' results meet by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.llm.rows import unpacked
from joinery.runtime import materialise

#: White space that is not yet one space; what it leaves alone needs no change.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Characters of the text in a range key.
HEAD = 32
#: Rows sampled per shuffle partition, and how many of them make a text a hot one. At most SAMPLED / HOT texts a partition are hot.
SAMPLED, HOT = 32, 8


def normalised(text: Column) -> Column:
    """text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def hot_texts(rows: DataFrame) -> DataFrame:
    """_hash, _parts: texts that hold more than about a quarter of a partition's rows, and into how many parts to cut them."""
    want = SAMPLED * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.sample(min(1.0, want / max(1, rows.count())), seed=11).groupBy("_hash").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") >= HOT).select("_hash", F.ceil(F.col("n") / HOT).cast("int").alias("_parts"))


def sorted_runs(docs: DataFrame, carry: list[str], key: str, text: str) -> DataFrame:
    """_row, _id, _sha, _part, _place, _first, _n: each row with its place, the least identifier and the size of its run."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col(f"`{key}`").alias("_id"), normalised(F.col(f"`{text}`")).alias("_norm"))
    rows = rows.withColumn("_hash", F.xxhash64("_norm"))
    rows = rows.join(F.broadcast(hot_texts(rows)), "_hash", "left")
    part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_id"), F.col("_parts"))).cast("int")
    rows = rows.select("_row", "_id", "_norm", "_hash", F.left("_norm", F.lit(HEAD)).alias("_head"), part.alias("_part"))
    ranges = ["_head", "_hash", "_part"]
    dealt = rows.repartitionByRange(*ranges)
    w = Window.partitionBy(*ranges).orderBy("_norm", F.col("_id").asc_nulls_last())
    starts = ~F.coalesce(F.lag("_norm").over(w) == F.col("_norm"), F.lit(False))
    runs = dealt.withColumn("_starts", starts.cast("long")).withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.select("_row", "_id", F.sha2("_norm", 256).alias("_sha"), *ranges, "_run")
    run = Window.partitionBy(*ranges, "_run")
    place = F.row_number().over(run.orderBy(F.col("_id").asc_nulls_last()))
    placed = runs.withColumn("_place", place).withColumn("_first", F.min("_id").over(run)).withColumn("_n", F.count("*").over(run))
    return placed.select("_row", "_id", "_sha", "_part", "_place", "_first", "_n")


def content_groups(docs: DataFrame, carry: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_row` (a struct of the columns `carry`), keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Of rows with equal normalised texts the one with the smallest `key` is kept, null keys last; of repeated rows, one.
    A null text counts as empty, texts are compared whole whatever their length, an empty table gives none, and other
    columns of docs, whatever their names, are not looked at.
    """
    runs = materialise(sorted_runs(docs, carry, key, text), "runs")
    done = runs.where("_part IS NULL").select("_row", F.col("_first").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_place") == 1).alias("kept"), F.col("_sha").alias("text_sha256"))
    cut = runs.where("_part IS NOT NULL")
    first = F.min(F.struct(F.col("_first").isNull().alias("none"), F.col("_first").alias("id"), F.col("_part").alias("part"))).alias("_least")
    whole = cut.where("_place = 1").groupBy("_sha").agg(first, F.sum("_n").alias("_all"))
    # as many rows as there are hot texts: bounded by hot_texts
    met = cut.join(F.broadcast(whole), "_sha")
    kept = (F.col("_place") == 1) & (F.col("_part") == F.col("_least.part"))
    return done.unionByName(met.select("_row", F.col("_least.id").alias("keep_id"), F.col("_all").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256")))


def one_of_each_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    kept = content_groups(docs, docs.columns, key, text).where("kept")
    return kept.select(unpacked(kept))
