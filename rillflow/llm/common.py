"""Shared helpers: reading tables, cutting lineage in the shared folder, splitting words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Record batches between Spark and Python of a few MB, however long the texts are; a session's own setting stays."""
    if not spark.conf.get(ARROW_BYTES, None):
        spark.conf.set(ARROW_BYTES, "4m")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a private one only where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors of a cluster need a folder they share")
        base = getattr(spark, "_rillflow_shared", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="rillflow-")
            spark._rillflow_shared = base
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles() if "/cut-" in p}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that ended in a :func:`cut`, instead of at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, or what it becomes with underscores until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_rows(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def spread(df: DataFrame, rows: int, per_task: int) -> int:
    """Partitions so that a task gets about ``per_task`` of ``rows`` rows, and no fewer than Spark's default."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def batches_of(it: Iterable[pa.RecordBatch], limit: int, column: str) -> Iterator[pa.RecordBatch]:
    """Re-cut record batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for b in it:
        size = b.column(column).nbytes
        if size <= limit or b.num_rows <= 1:
            yield b
            continue
        step = max(1, b.num_rows * limit // size)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


