"""Scratch tables and small files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process that are deleted when it ends: (session, path).
_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, a temporary folder. On a cluster without it this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark.sparkContext, "_querent_scratch", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="querent-scratch-")
            spark.sparkContext._querent_scratch = found
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    files, own = _hadoop(spark, path)
    return files.exists(own)


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what lies in a folder; none where there is no folder."""
    files, own = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(own)) if files.exists(own) else []


def delete(spark: SparkSession, path: str) -> None:
    files, own = _hadoop(spark, path)
    files.delete(own, True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one; whether it was written."""
    files, own = _hadoop(spark, path)
    try:
        out = files.create(own, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


@atexit.register
def _clear() -> None:
    for spark, path in _OWN:
        with contextlib.suppress(Exception):  # the session may have ended before the process
            delete(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new scratch folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/querent-{name}-{uuid.uuid4().hex[:12]}"
    _OWN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read again: lineage ends here, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
