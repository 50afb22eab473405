"""format("molgraph"): MOL, SDF and five-line graph files as a data source, read and written on the executors.

    register(spark)
    spark.read.format("molgraph").load("folder or file or URI")
    graphs.select("name", "labels", "edges").write.format("molgraph").mode("append").save("folder")

A reader partition is a bundle of files; a broken file is a row with an error. Writing is all or nothing: tasks write beside the
folder, the driver moves their files when all have ended, and an aborted job leaves none. Paths are those of Arrow's file
systems (local and shared folders, hdfs, s3, gs); where only Spark can reach a store, use sources.files.read_graph_files instead.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from joinery.kernels import graphs as kernel
from joinery.runtime import ship

SCHEMA = "path string, labels array<string>, edges array<struct<src: int, dst: int, label: int>>, error string"
#: Bytes and files of a bundle, and files of an Arrow batch.
BUNDLE_BYTES, BUNDLE_FILES, BATCH = 64 << 20, 2_000, 500
_EDGE = pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("label", pa.int32())])
_ARROW = pa.schema([("path", pa.string()), ("labels", pa.list_(pa.string())), ("edges", pa.list_(_EDGE)), ("error", pa.string())])
_TEMPORARY = "_temporary-"


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and the code to its workers."""
    ship(spark)
    spark.dataSource.register(MolGraphSource)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


def five_lines(name: str, labels: list[str], edges: list) -> str:
    """A graph as a five-line file; FormatError if a label cannot stand in one."""
    if "\n" in name or any(not x or x.split() != [x] for x in labels):
        raise kernel.FormatError(f"{name}: a label is empty or has white space")
    ends = " ".join(f"{e['src'] + 1} {e['dst'] + 1}" for e in edges)
    return "\n".join([name, str(len(labels)), ends, " ".join(labels), " ".join(str(e["label"]) for e in edges)]) + "\n"


@dataclass
class Bundle(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, path: str, remove_hydrogens: bool):
        self.path, self.remove_hydrogens = path, remove_hydrogens

    def partitions(self) -> list[Bundle]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda f: any(x[:1] in "._" for x in f.path.removeprefix(path).split("/") if x)
        out, size = [[]], 0
        for f in sorted((f for f in found if f.is_file and (f is info or not hidden(f))), key=lambda f: f.path):
            if out[-1] and (size + f.size > BUNDLE_BYTES or len(out[-1]) >= BUNDLE_FILES):
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Bundle(x) for x in out]

    def _row(self, system: fs.FileSystem, path: str) -> tuple:
        with system.open_input_stream(path) as stream:
            content = stream.read()
        try:
            graph = kernel.parse(content, path)
            graph = graph.without("H") if self.remove_hydrogens else graph
            return path, graph.labels, [dict(zip(("src", "dst", "label"), e, strict=True)) for e in graph.edges], None
        except kernel.FormatError as e:
            return path, None, None, str(e)

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        for at in range(0, len(partition.files), BATCH):
            rows = [self._row(system, p) for p in partition.files[at : at + BATCH]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, columns: list[str]):
        if missing := {"name", "labels", "edges"} - set(columns):
            raise ValueError(f"to write graphs, give name, labels and edges; missing: {', '.join(sorted(missing))}")
        self.path, self.overwrite = path, overwrite
        self.job = f"{_TEMPORARY}{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, path = located(self.path)
        folder = f"{path}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        files = []
        for row in iterator:
            if not row["name"] or "/" in row["name"]:
                raise ValueError("a graph needs a name without slashes")
            files.append(f"{folder}/{row['name']}.graph")
            with system.open_output_stream(files[-1]) as stream:
                stream.write(five_lines(row["name"], row["labels"], row["edges"]).encode())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        files = [f for m in messages if m for f in m.files]
        target = {f: f"{path}/{posixpath.basename(f)}" for f in files}
        there = {f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".graph")}
        if len(set(target.values())) < len(files) or (not self.overwrite and there & set(target.values())):
            self.abort(messages)
            raise ValueError("two graphs of one name")
        if self.overwrite:
            for old in there:
                system.delete_file(old)
        for source, to in target.items():
            system.move(source, to)
        system.delete_dir(f"{path}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        if system.get_file_info(f"{path}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.job}")


class MolGraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "molgraph"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("removeHydrogens", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, schema.fieldNames())
