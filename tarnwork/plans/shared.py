"""Tables written into the folder that driver and executors share, to cut lineage and fix what must not be computed twice."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems have it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; what is left is the cluster's to clean
            return


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of its own if driver and executors are one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/tarnwork-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(at)
        _scratch.append((spark, at))
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when this process ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, at))
    return at


#: Settings of a job whose result is written: its shuffle files go when it ends, since nothing reads them again, and what
#: Python workers are sent at a time is small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict):
    """The session with other settings, which are put back in the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again; lost executors cost a reread, not a recomputation."""
    spark = df.sparkSession
    at = scratch(spark, name)
    with settings(spark, WRITING):
        df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def written_together(**dfs: DataFrame) -> list[DataFrame]:
    """written() for tables that don't rest on each other, side by side, so that one's last tasks don't keep the others waiting."""
    spark = next(iter(dfs.values())).sparkSession
    at = [scratch(spark, name) for name in dfs]
    with settings(spark, WRITING), ThreadPoolExecutor(len(dfs)) as pool:
        list(pool.map(lambda df, to: df.write.parquet(to), dfs.values(), at))
    out = [spark.read.schema(df.schema).parquet(to) for df, to in zip(dfs.values(), at)]
    for df, to in zip(out, at):
        df._written_at = to
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    if at := getattr(df, "_written_at", None):
        delete(df.sparkSession, at)


def open_at(path: str, mode: str):
    """A file of a shared folder: of a local or mounted path, or of a file system that pyarrow knows. For use on executors."""
    from urllib.parse import unquote, urlparse

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(unquote(url.path), mode)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_output_stream(at) if "w" in mode else system.open_input_file(at)
