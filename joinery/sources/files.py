"""Readers of strings and graphs. Whole files become rows; broken input becomes an error column, not a failed job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinery.kernels import graphs as kernel
from joinery.runtime import ship

EDGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("src", "dst", "label")])
PARSED = T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("error", T.StringType())])


def records(contents: DataFrame, content: str = "content") -> DataFrame:
    """Columns of contents but `content`, line_ix and text: the records of each file.

    LF ends a record and takes one CR before it along; a CR elsewhere is a symbol; empty lines are records; the last
    record needs no LF. text is null, and error says so, where the file is not valid UTF-8.
    """
    raw = F.col(content).cast("string")
    valid = F.is_valid_utf8(raw)
    pieces = F.split(F.replace(F.when(valid, raw), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    lines = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    others = [c for c in contents.columns if c != content]
    kept = F.when(valid, lines).otherwise(F.array(F.lit(None).cast("string")))
    out = contents.select(*others, F.posexplode(kept).alias("line_ix", "text"))
    return out.withColumn("error", F.when(F.col("text").isNull(), "invalid UTF-8"))


def read_strings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, line_ix, text, error of the records of text files."""
    return records(spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source"), "content"))


def read_graph_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content of graph files; a path without a known suffix also stands for the same with .mol."""
    return spark.read.format("binaryFile").load(resolved(spark, [paths] if isinstance(paths, str) else list(paths))).select("path", "content")


def resolve(path: str, exists) -> str:
    """The path to read: the exact one first; with no known suffix and no such file, the same with .mol."""
    return path if exists(path) or kernel.is_molfile(path) or not exists(f"{path}.mol") else f"{path}.mol"


def resolved(spark: SparkSession, paths: list[str]) -> list[str]:
    """resolve() of each path by what its file system holds; patterns stay as they are."""

    def exists(path: str) -> bool:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)

    return [p if set(p) & set("*?[]{}") else resolve(p, exists) for p in paths]


def _parsed(remove_hydrogens: bool, path: str | None):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, name in zip(batch["_content"], batch["_path"], strict=True):
                try:
                    if content is None:
                        raise kernel.FormatError("no content")
                    graph = kernel.parse(bytes(content), name or "")
                    graph = graph.without("H") if remove_hydrogens else graph
                    out.append((graph.labels, [dict(zip(("src", "dst", "label"), e, strict=True)) for e in graph.edges], None))
                except kernel.FormatError as e:
                    out.append((None, None, str(e)))
            done = pd.DataFrame(out, columns=["labels", "edges", "error"], index=batch.index)
            yield pd.concat([batch.drop(columns=["_content", "_path"]), done], axis=1)

    return run


def parse_graphs(files: DataFrame, content: str = "content", path: str | None = "path", remove_hydrogens: bool = True) -> DataFrame:
    """The columns of files but `content`, and labels, edges (src < dst, by src), error.

    The path's suffix selects the format (.mol, .sdf: first V2000 record; else the five-line format).
    """
    ship(files.sparkSession)
    keep = [c for c in files.columns if c != content]
    name = F.col(path) if path else F.lit("")
    ready = files.select(*keep, F.col(content).cast("binary").alias("_content"), name.alias("_path"))
    schema = T.StructType([files.schema[c] for c in keep] + PARSED.fields)
    return ready.mapInPandas(_parsed(remove_hydrogens, path), schema)
