"""Files of questions, predictions, facts, rollouts and runs: scans with fixed schemas, sinks, resume."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent import storage
from querent.functions.sqltext import strip
from querent.sources import log

FACTS = "question_id long, db_id string, difficulty string, status string, n_rows int, n_cols int, n_duplicate_rows int, has_top_level_order_by boolean, elapsed_s double"
PREDICTION = "question_id long, db_id string, completion string, sql string, finish_reason string, latency_s double, error string"
ROLLOUT = (
    "reward double, correct boolean, official boolean, parsed boolean, executed boolean, pred_status string, gold_status string, reason string, pred_n_rows long, gold_n_rows long, "
    "no_from_clause boolean, empty_result boolean, sql string, question_id long, db_id string, split string, sample_index long, data_source string, error string"
)
#: The keys under which a question's gold query may stand, and what a run's record must hold.
GOLD_KEYS = ("SQL", "sql", "query", "gold_sql")
RUN_FIELDS = ("stage", "split", "n_samples", "metrics")
STAGES = ("baseline", "sft", "grpo", "ablation", "smoke")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """index, question_id, db_id, question, evidence, gold_sql, difficulty of a JSON array of questions.

    The first filled of the gold keys counts, texts are stripped, a missing id is the question's place. A
    question without db_id or question raises when it is read, and so does a file that isn't an array. The array is
    read element by element; a folder of such files counts on from file to file, in the order of their names.
    """
    head = spark.read.text(path).where("value rlike '\\\\S'").limit(1).collect()
    if not head or not head[0].value.lstrip("\ufeff \t").startswith("["):
        raise ValueError(f"{path} is not a JSON array of questions")
    # SQL and sql are two keys, which one schema can't hold: their case is told by a second look at the elements.
    fields = ("question_id", "db_id", "question", "evidence", "difficulty", *GOLD_KEYS)

    def look(names: list[str]) -> DataFrame:
        schema = ", ".join(f"{n} string" for n in names)
        rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
        return rows.select(*[F.col(n).alias(f"q_{fields.index(n)}") for n in names], F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))

    placed = look([f for f in fields if f != "sql"]).join(look(["sql"]), ["file", "at"])
    starts = placed.groupBy("file").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = starts.select("file", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = placed.join(F.broadcast(starts), "file").withColumn("index", (F.col("at") - F.col("first") + F.col("before")).cast("int"))
    text = lambda k: strip(F.coalesce(F.col(f"q_{fields.index(k)}"), F.lit("")))
    gold = F.coalesce(*[F.nullif(text(k), F.lit("")) for k in GOLD_KEYS], F.lit(""))
    need = lambda k: F.when(text(k) == "", F.raise_error(F.concat(F.lit(f"{k} is missing in question "), F.col("index").cast("string")))).otherwise(text(k))
    return rows.select(
        "index", F.coalesce(F.expr("try_cast(q_0 AS long)"), F.col("index").cast("long")).alias("question_id"), need("db_id").alias("db_id"), need("question").alias("question"),
        text("evidence").alias("evidence"), gold.alias("gold_sql"), F.nullif(text("difficulty"), F.lit("")).alias("difficulty"),
    )


def write_questions(examples: DataFrame, path: str) -> None:
    """Questions as one JSON array in a text file, ids stamped, in order of index: an element a line, streamed through one task as the format is one file."""
    record = F.to_json(F.struct("question_id", "db_id", "question", "evidence", F.col("gold_sql").alias("SQL"), "difficulty"))
    lines = examples.select(F.lit(1).alias("_k"), F.col("index").cast("long").alias("_i"), record.alias("value"))
    first = examples.agg(F.min("index")).first()[0]
    lines = lines.withColumn("value", F.when(F.col("_i") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))))
    ends = examples.sparkSession.createDataFrame([(0, 0, "["), (2, 0, "]")], "_k int, _i long, value string")
    ordered = lines.union(ends).repartitionByRange("_k", "_i").sortWithinPartitions("_k", "_i")
    ordered.select("value").coalesce(1).write.mode("overwrite").text(path)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in order: a map-side combined maximum, no window."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with their place (line): of an ordered log, or of plain files in the order of their names."""
    if log.is_log(spark, path):
        return log.read(spark, path, schema)
    lines = spark.read.schema(schema).json(path)
    return lines.withColumn("line", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, completion: JSON lines, completion or else sql or else empty; the last record of an id counts, in the order of appends."""
    text = F.coalesce(F.nullif(F.col("completion"), F.lit("")), F.nullif(F.col("sql"), F.lit("")), F.lit(""))
    return last_wins(_lines(spark, path, PREDICTION).select("question_id", text.alias("completion"), "line"), "question_id", "line").drop("line")


def append_predictions(predictions: DataFrame, path: str, position: str = "index", key: str | None = None) -> int | None:
    """Append predictions to an ordered log in the order of their questions' positions, which isn't kept."""
    kept = [c.split()[0] for c in PREDICTION.split(", ") if c.split()[0] in predictions.columns]
    return log.append(predictions.orderBy(position).select(*kept), path, key)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """Ids that have a record, failed ones too, so a resumed run doesn't repeat them; none where there is no log."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], "question_id long")
    return _lines(spark, path, PREDICTION).select("question_id").distinct()


def resume(examples: DataFrame, path: str, position: str = "index") -> DataFrame:
    """Examples without a record in the log of predictions, in the order of their positions."""
    return to_do(examples, finished(examples.sparkSession, path)).orderBy(position)


def to_do(examples: DataFrame, done: DataFrame) -> DataFrame:
    """Examples without a record."""
    return examples.join(done, "question_id", "left_anti")


def only_predicted(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Examples with a prediction."""
    return examples.join(predictions, "question_id", "left_semi")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).json(path)


def read_rollouts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(usable, errors): rollout records that sort by line into the order they were appended in, and how many carry an error."""
    lines = _lines(spark, path, ROLLOUT)
    return lines.where("error is null"), lines.where("error is not null").agg(F.count("*").alias("n_errors"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; append continues a log."""
    df.write.mode(mode).json(path)


# --- runs ------------------------------------------------------------------------------------------


def file_sha256(path: str | None) -> str:
    """A file's digest, or "" where there is none."""
    if not path or not Path(path).is_file():
        return ""
    with open(path, "rb") as handle:
        return hashlib.file_digest(handle, "sha256").hexdigest()


def sha256_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files read by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def git_state(folder: str = ".", ignore: tuple[str, ...] = ()) -> tuple[str, bool]:
    """(commit, whether anything but the ignored paths has changed); without git ("", True)."""
    try:
        ask = lambda *words: subprocess.check_output(["git", *words], cwd=folder, text=True, stderr=subprocess.DEVNULL)
        commit, root = ask("rev-parse", "HEAD", "--show-toplevel").split("\n")[:2]
        changes = iter(ask("status", "--porcelain", "-z", "-uall").split("\0"))
    except (OSError, subprocess.CalledProcessError):
        return "", True
    passed = [os.path.realpath(i) for i in ignore]
    dirty = False
    for entry in changes:
        if entry:
            own = os.path.join(os.path.realpath(root), entry[3:])
            if entry[0] in "RC":  # the name before follows by itself
                next(changes, None)
            dirty |= not any(own == p or own.startswith(p + os.sep) for p in passed)
    return commit, dirty


def hardware() -> str:
    """Platform, cores and memory of the driver's machine, and the accelerators that QUERENT_HARDWARE, or else CUDA_VISIBLE_DEVICES, names."""
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 30 if hasattr(os, "sysconf") else 0
    devices = os.environ.get("QUERENT_HARDWARE") or os.environ.get("CUDA_VISIBLE_DEVICES")
    return f"{platform.platform()}, {os.cpu_count()} cores, {memory} GiB" + (f", devices {devices}" if devices else "")


#: A run as it stands in the log. What a caller adds beside these fields goes to extra.
RUN = (
    "run_id string, timestamp string, stage string, split string, n_samples long, metrics map<string,double>, git_sha string, git_dirty boolean, hardware string, "
    "config_path string, config_sha256 string, extra string"
)


def append_run(spark: SparkSession, record: dict, path: str) -> dict:
    """Append a run to a log of JSON lines, and give what was written.

    record holds RUN_FIELDS and may hold any other of RUN's; what it leaves out is derived: an id, the time, the git
    state (in which the log itself doesn't count), the hardware and the configuration's digest. Each append is a
    file of its own, so writers don't meet. Without a needed field or with an unknown stage it raises.
    """
    needed = {f: record.get(f) for f in RUN_FIELDS}
    if None in needed.values() or record["stage"] not in STAGES:
        raise ValueError(f"a run needs {', '.join(RUN_FIELDS)} and one of the stages {', '.join(STAGES)}; it has {needed}")
    schema = spark.createDataFrame([], RUN).schema
    sha, dirty = git_state(ignore=(path.removeprefix("file://"),))
    filled = {"run_id": uuid.uuid4().hex[:12], "timestamp": datetime.now(UTC).isoformat(timespec="seconds"), "git_sha": sha, "git_dirty": dirty, "hardware": hardware(), "config_sha256": file_sha256(record.get("config_path"))}
    filled |= {k: v for k, v in record.items() if k in schema.names}
    filled["metrics"] = {k: float(v) for k, v in record["metrics"].items() if isinstance(v, int | float)}
    more = {k: v for k, v in record.items() if k not in schema.names} | {k: v for k, v in record["metrics"].items() if k not in filled["metrics"]}
    filled["extra"] = json.dumps(more, ensure_ascii=False, sort_keys=True) if more else None
    row = tuple(filled.get(n) for n in schema.names)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(path)
    return {**filled, **more}


def append_rollouts(records: DataFrame, path: str | None, key: str | None = None) -> int | None:
    """Append rollout records, error records too, to an ordered log; a key's batch once. Nothing happens without a path."""
    return log.append(records, path, key) if path else None


def rollout_log(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends each batch of records to the log exactly once.

    A batch's key is the checkpoint and the batch's number, so a batch that is run again, after a crash between
    its write and the checkpoint's commit, writes the same folder anew or finds itself committed.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: append_rollouts(batch, path, f"{checkpoint}#{n}")).option("checkpointLocation", checkpoint)


def write_rl_rows(rows: DataFrame, path: str) -> None:
    """Nested training rows as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def _one_file(spark: SparkSession, path: str) -> str | None:
    if not storage.exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def read_meta(spark: SparkSession, path: str) -> dict:
    """What stands in the .meta.json beside a file of predictions; empty where there is none."""
    found = _one_file(spark, f"{path}.meta.json")
    return json.loads(found) if found else {}


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    _write_json(spark, f"{path}.meta.json", meta)


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    text = json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_manifest(spark: SparkSession, path: str, sources: dict[str, str], command: str, ids: dict[str, list] | None = None, **more) -> dict:
    """Write beside a dataset where it came from: sources and their digests, git state, command, ids by part, and more (such as the seed)."""
    commit, dirty = git_state()
    manifest = {"command": command, "git_sha": commit, "git_dirty": dirty}
    for role, source in sources.items():
        manifest |= {f"source_{role}": source, f"source_{role}_sha256": file_sha256(source)}
    manifest |= {f"{part}_ids": list(own) for part, own in (ids or {}).items()}
    manifest |= more
    _write_json(spark, path, manifest)
    return manifest


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """All runs appended so far as rows of RUN; none where there is no log."""
    return spark.read.schema(RUN).json(path) if storage.exists(spark, path) else spark.createDataFrame([], RUN)


def read_runs(spark: SparkSession, path: str) -> list[dict]:
    """The runs of a log, oldest first, without the fields that a run has no value for."""
    found = []
    for row in run_log(spark, path).orderBy("timestamp").toLocalIterator():
        own = {k: v for k, v in row.asDict().items() if v is not None}
        found.append(own | json.loads(own.pop("extra", "{}")))
    return found
