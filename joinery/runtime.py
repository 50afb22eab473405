"""What every operator needs from a session: shipped code and a shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Applications that have the code already.
_SHIPPED: set[str] = set()
_LOCK = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers import it from anywhere."""
    context = spark.sparkContext
    with _LOCK:
        if context.applicationId not in _SHIPPED:
            _ship(context)
            _SHIPPED.add(context.applicationId)


def _ship(context) -> None:
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="joinery-code-")
    stage = os.path.join(folder, "stage")
    shutil.copytree(package, os.path.join(stage, "joinery"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, f"joinery-{uuid.uuid4().hex}"), "zip", stage))
    shutil.rmtree(stage)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset on a single machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), f"joinery-{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back.

    The files outlive any executor and are removed by forget(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/joinery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def until_exit(spark: SparkSession, path: str) -> None:
    """Have path removed when the driver's JVM ends."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)


def forget(*frames: DataFrame) -> None:
    """Remove what materialise wrote for these frames, once nothing that is still to run reads them; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            context = df.sparkSession.sparkContext
            there = context._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)
            df._written_to = None


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly work on each row.

    Only an input of fewer partitions than cores is dealt anew; a large one has more and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, rows: int = 1_500_000) -> DataFrame:
    """df by key over partitions of about so many rows, however large it is; a small one is left to the session's settings."""
    spark = df.sparkSession
    n = -(-df.count() // rows)
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, key) if n > few else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
