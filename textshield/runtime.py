"""What every job needs from its session: shipped code, a shared folder, bounded broadcasts."""

from __future__ import annotations

import io
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent

#: Arrow batches stay small: the JVM holds some for each task beside its heap, and rounds their buffers up.
BATCH_ROWS, BATCH_BYTES = "1000", str(4 << 20)

#: Largest table, in rows of some tens of bytes, that is sent whole to every executor.
BROADCAST_ROWS = 1_000_000

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application and bound the Arrow batches."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
        # addPyFile serves the archive from the driver; only the driver opens this folder
        path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{PACKAGE.name}.zip"
        path.write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


_open = threading.local()


def shared_dir(spark: SparkSession, purpose: str, keep: bool = False) -> str:
    """A new folder under the cluster's checkpoint folder; where none is set, a session on one machine makes its own.

    In a scratch block the folder is deleted when the block ends, or, if it is to be kept, with the block around that one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    blocks = getattr(_open, "blocks", [])
    if len(blocks) > keep:
        blocks[-1 - keep].append(path)
    return path


def written(df: DataFrame, purpose: str, keep: bool = False) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Folders made in the block (and not kept) are deleted at its end: use it where what leaves the block does not read them."""
    _open.blocks = [*getattr(_open, "blocks", []), []]
    try:
        yield
    finally:
        for path in _open.blocks.pop():
            drop_dir(spark, path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of short rows for broadcast where a count proves it small; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of a few small files, dealt out over the cores by rows: such files have few row groups, each read by one task.

    A table of as many files as cores, or of many times as many splits, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= 2 * cores else df


__all__ = ["prepare", "shared_dir", "written", "scratch", "drop_dir", "exists", "if_small", "load", "spread"]
