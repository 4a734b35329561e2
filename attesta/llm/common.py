"""Shared pieces of the corpus operators: table access, shared-folder staging, small column idioms."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured an own one is set, but only if driver and executors are
    one process (tests): elsewhere the executors would not see it, and the operator refuses to run."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/attesta-{label}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_clean)
    _staged.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _staged:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone already; nothing depends on the removal
            return


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go_of_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nobody refers to any more deleted now, not when the driver's memory is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes of the Arrow batches that pass between the JVM and Python workers; a single longer text passes alone.
BATCH_ROWS, BATCH_BYTES = 2048, "4m"


def lean(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to pass small Arrow batches, so that a worker holds few texts at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``; lambdas would evaluate it anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of narrow keys up to which a table may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 400_000


def sized(small: DataFrame, rows: int) -> DataFrame:
    """``small``, marked for broadcast if its counted ``rows`` of a few numbers each allow that."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


#: In a worker: what operators keep between tasks, as functions that let go of it.
kept_by_worker: list = []


def let_go() -> None:
    """Free what other operators have kept in this worker and give the memory back; for tasks that need it themselves."""
    for free in kept_by_worker:
        free()
    trim()


def trim() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
