"""Session helpers: shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Largest table, in bytes, that is dealt out to idle cores.
SPREAD = 4 << 30


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only on a local master, where all workers see it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc = spark.sparkContext
    if not getattr(sc, "_corpusloom_folder", None):
        sc._corpusloom_folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, sc._corpusloom_folder, ignore_errors=True)
    return sc._corpusloom_folder


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Write a small file to any file system the session knows; without ``overwrite`` an existing file is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, overwrite)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder named by ``spark.checkpoint.dir`` is used; only on a local
    master whose session names none a temporary one is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: lineage is cut and columns can still be pruned.

    The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def rows_within(df: DataFrame, limit: int) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than needed."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint when its row count is proven to be at most ``limit``.

    Beyond the limit the frame comes back unhinted, so the join shuffles and
    adaptive execution splits its skewed partitions.
    """
    return F.broadcast(df) if rows_within(df, limit) else df


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a folder; with ``spread`` one of fewer parts than there are cores is dealt out to all of them.

    Only tables of at most ``SPREAD`` bytes are moved; larger ones are read as they lie.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not spread or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per context."""
    import os
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._corpusloom_shipped = True
