"""A table as a folder of whole versions: a version counts once its write is complete, so a swap is atomic.

Readers take the newest complete version; a write that fails, or a second one for the same version,
changes nothing. Bodies are files named by their content, moved into place when they are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in names if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def swap(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next version and return its number; ``df`` may read the version before."""
    number = max(versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    return number


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version, empty with ``schema`` where there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else spark.createDataFrame([], schema)


def put_bodies(rows: DataFrame, folder: str) -> DataFrame:
    """Write each (domain, content_hash, body) to ``folder``/domain/hash unless it is there; returns domain, content_hash, bytes.

    Names are made safe; null bodies are left out. A task that is run again writes the same files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for place, name, body in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                target = f"{top}/{place}/{name}"
                if store.get_file_info(target).type == fs.FileType.NotFound:
                    store.create_dir(f"{top}/{place}", recursive=True)
                    with store.open_output_stream(f"{target}.part-{attempt}", compression=None) as out:
                        out.write(body)
                    store.move(f"{target}.part-{attempt}", target)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), batch.column(4)], names=["domain", "content_hash", "bytes"])

    place = F.coalesce(F.nullif(F.regexp_replace(F.lower("domain"), r"[^a-z0-9.-]+", "-"), F.lit("")), F.lit("unknown"))
    kept = rows.where("body is not null and content_hash is not null").select(place.alias("place"), "content_hash", F.col("body").cast("binary").alias("body"), "domain", F.octet_length("body").cast("long").alias("bytes"))
    return kept.mapInArrow(run, "domain string, content_hash string, bytes long")
