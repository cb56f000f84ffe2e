"""Where operators put intermediate tables, and how they write them.

Intermediate tables go below ``spark.checkpoint.dir``: the one folder that the
driver and every executor see.  A table there is committed by Spark's own
writer, so a lost executor costs the tasks it ran and nothing that was written.
They are removed when their readers are done, at the latest with the session.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a Python worker is given at once, whatever the length of the rows (one row at least).
BATCH_BYTES = 8 << 20
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; where it is unset, a folder of this machine if it runs the whole session, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='chirplake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what Arrow sends to a Python worker by bytes; a lower bound of the session's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(step: Callable) -> Callable:
    """A step of ``mapInArrow`` whose worker gives freed memory back when the task ends.

    A worker outlives its task and takes those of any later stage in turn.  Without
    this, Arrow and the C library keep for it what its largest task ever needed.
    """

    @wraps(step)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(it)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run


class Scratch:
    """Tables of one operator call.  ``drop`` removes some early, when their readers are done; the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, system = self._path("")
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _path(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        # what was shuffled for the table goes as soon as it is written, and not when the driver happens to collect its garbage
        before = self.spark.conf.get(SHUFFLES_GO, "false")
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, system = self._path(name)
            system.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, under fixed names; further columns of the caller's table can't clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
