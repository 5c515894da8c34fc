"""An ordered log of JSON lines that several writers append to, each batch once.

A log is a folder. A batch's rows are part files in data/<batch>; a commit file in _log then names them, in order,
under the next sequence number. Only committed files are read, by joining a row's file name with the commits. So
rows come back in the order of appends, and in an append in the order of its rows, and what a crash left behind
isn't seen.

A batch with a key is written once: its folder is named by the key and written anew on a replay, and of commits with
one key the first counts. A commit is a file that is made only if there is none, so of writers that reach for one
sequence number all but one take the next.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent import storage

#: A row's place in the log: append, file, stretch of the file, row.
POSITION = "struct<sequence:bigint,ordinal:int,block:bigint,row:bigint>"
_COMMIT = "sequence long, key string, folder string, files array<string>"


def is_log(spark: SparkSession, path: str) -> bool:
    return storage.exists(spark, f"{path}/_log")


def _sequences(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in storage.names(spark, f"{path}/_log") if n.endswith(".json")]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The commits; one that isn't whole counts as none."""
    return spark.read.schema(_COMMIT).json(f"{path}/_log").where("sequence is not null and files is not null")


def append(df: DataFrame, path: str, key: str | None = None, order: list[Column | str] | None = None) -> int | None:
    """Append df's rows, in the order given if there is one; the append's sequence number, or None for a key that is already there."""
    spark = df.sparkSession
    name = hashlib.sha256(key.encode()).hexdigest()[:24] if key is not None else uuid.uuid4().hex[:24]
    if key is not None and _sequences(spark, path) and not _records(spark, path).where(F.col("folder") == name).isEmpty():
        return None
    folder = f"{path}/data/{name}"
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(folder)
    files = [n for n in storage.names(spark, folder) if n.startswith("part-")]
    sequence = max(_sequences(spark, path), default=-1) + 1
    while not storage.create(spark, f"{path}/_log/{sequence:012d}.json", json.dumps({"sequence": sequence, "key": key, "folder": name, "files": files})):
        sequence += 1
    return sequence


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, ordinal, file): the files of the log; of one key's commits the first counts."""
    first = _records(spark, path).groupBy("folder").agg(F.min_by(F.struct("sequence", "files"), "sequence").alias("c"))
    return first.select(F.col("c.sequence").alias("sequence"), F.posexplode("c.files").alias("ordinal", "file"))


def read(spark: SparkSession, path: str, schema: str, position: str = "line") -> DataFrame:
    """The log's rows with their POSITION, by which they sort into the order of appends."""
    if not _sequences(spark, path):
        return spark.createDataFrame([], f"{schema}, {position} {POSITION}")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{path}/data")
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    # A small table, broadcast by its size; many commits make it an ordinary join.
    joined = placed.join(committed(spark, path).withColumnRenamed("file", "_file"), "_file")
    place = F.struct("sequence", "ordinal", F.col("_block").alias("block"), F.col("_row").alias("row"))
    return joined.withColumn(position, place).drop("sequence", "ordinal", "_file", "_block", "_row")
