"""Shared helpers of the corpus operators: scratch tables in the shared folder, sorted naming, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes or splits on these characters only; bytes.split() without an argument splits on the same six.
SPACE = "[\\x20\\x09-\\x0D]"
#: Rows with texts that a worker handles at once.
TEXTS = 1000
#: The setting of how many rows a worker gets at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_KEPT: dict[Any, Any] = {}


def once(key: Any, build: Callable[[], Any]) -> Any:
    """build(), kept for the life of the process: tables and coders that a Python worker needs for task after task."""
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def trim() -> None:
    """Give memory that this process freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a system without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 0):
    """run over batches of at most rows (0: as they come), giving the memory that it freed back to the system at its end.

    Workers live on, and their executor's memory is bounded.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows or max(1, batch.num_rows)
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut(batches))
        trim()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_querent_shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="querent-shared-")
            spark._querent_shared = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives a lost executor.

    rows: how many rows workers get at once, where these are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/querent-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(BATCH)
    if rows:
        spark.conf.set(BATCH, str(rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._querent_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again, and let go of the shuffles behind them.

    Spark deletes a shuffle's files when the driver's garbage collector finds it unused, which can be long after.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._querent_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): root is the component's smallest node.

    Alternating large-star and small-star rounds, each a map-side combined minimum and one join, with the
    edges written to the shared folder after each round; hub nodes are split by the adaptive skew join.
    Rounds go on until an edge set repeats, so no length of chain is cut off. Only a count and a checksum
    reach the driver.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, materialize(small, "edges")
        release(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
