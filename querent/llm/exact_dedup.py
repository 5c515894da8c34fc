"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. All blocks of the corpus are sorted, and equal
blocks get one integer name: the task in which the run of equal blocks begins, and the run's place there.
Then adjacent names are paired, the pairs are sorted and named in the same way, and so on until every
document has one name. Runs are found by comparing whole blocks, so names stand for contents one to one.

The sort is dealt by range over (start of the block, its digest, row), so a run of equal blocks that holds
a third of all rows is spread over many tasks; a task whose first run continues its predecessor's last one
takes over that name. At most two edges a task reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import SPACE, free_name, materialize, text_of, tidy

#: Bytes in a block.
BLOCK = 4096
_TASK = 1 << 32


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace key by task, run (place of the key's run in the sorted task) and edge (digest, in the task's first and last row)."""
    task, run, last, last_mark, held = TaskContext.get().partitionId(), -1, None, None, None
    first = True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, mark = batch.column("key"), batch.column("mark")
        changed = [key[0].as_py() != last, *pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_pylist()]
        same_mark = [mark[0].as_py() == last_mark, *pc.equal(mark.slice(1), mark.slice(0, n - 1)).to_pylist()]
        if any(c and m for c, m in zip(changed, same_mark, strict=True)):
            raise ValueError("two different blocks have one SHA-256 digest")
        runs = []
        for c in changed:
            run += c
            runs.append(run)
        last, last_mark = key[n - 1].as_py(), mark[n - 1].as_py()
        edge = [None] * n
        if first:
            edge[0], first = mark[0].as_py(), False
        out = {x: batch.column(x) for x in batch.schema.names if x not in ("key", "mark")}
        out |= {"task": pa.array([task] * n, pa.int64()), "run": pa.array(runs, pa.int64()), "edge": edge}
        if held is not None:
            yield pa.RecordBatch.from_pydict(held | {"edge": pa.array(held["edge"], pa.binary())})
        held = out
    if held is not None:
        held["edge"][-1] = last_mark
        yield pa.RecordBatch.from_pydict(held | {"edge": pa.array(held["edge"], pa.binary())})


def name_sorted(df: DataFrame, label: str) -> DataFrame:
    """Replace the binary column key by name (long): equal keys get equal names, different keys different ones."""
    carried = [f for f in df.schema.fields if f.name != "key"]
    marked = df.withColumn("mark", F.concat(F.substring("key", 1, 16), F.unhex(F.sha2("key", 256))))
    dealt = marked.repartitionByRange("mark", "rid", "pos").sortWithinPartitions("mark", "key", "rid", "pos")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    runs = materialize(dealt.mapInArrow(tidy(_number_runs), f"{schema}, task long, run long, edge binary"), label, 2000)
    edges: dict[int, list] = {}
    for x in runs.where("edge is not null").select("task", "run", "edge").distinct().collect():
        edges.setdefault(x.task, []).append((x.run, bytes(x.edge)))
    alias, before = [], None  # before: digest and name of the last run of the task before
    for task in sorted(edges):
        own = sorted(edges[task])
        taken = before[1] if before and before[0] == own[0][1] else None
        if taken is not None:
            alias.append((task, 0, taken))
        run, mark = own[-1]
        before = (mark, taken if run == 0 and taken is not None else task * _TASK + run)
    named = F.col("task") * _TASK + F.col("run")
    if alias:
        # One row a task at most.
        taken = df.sparkSession.createDataFrame(alias, "task long, run long, taken long")
        runs, named = runs.join(F.broadcast(taken), ["task", "run"], "left"), F.coalesce("taken", named)
    return runs.select(*[f.name for f in carried], named.alias("name"))


def identify(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, level, name, *others) for df's (rid, key binary, *others): rows have equal (level, name) when their keys are equal.

    The column pos is made here; others must be functions of the row.
    """
    others = [c for c in df.columns if c not in ("rid", "key")]
    parts = F.greatest(F.ceil(F.octet_length("key") / F.lit(block)), F.lit(1)).cast("int")
    cut = df.select(
        "rid",
        F.posexplode(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring("key", i * block + 1, F.lit(block)))).alias("pos", "piece"),
        *[F.col(c) for c in others],
    )
    blocks = cut.select("rid", "pos", F.col("piece").alias("key"), *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in others])
    found, level = None, 0
    while True:
        named = name_sorted(blocks, f"names{level}")
        whole = materialize(
            named.groupBy("rid").agg(
                F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"),
                *[F.max(c).alias(c) for c in others],
            ),
            f"level{level}",
        )
        one = whole.where(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.element_at("names", 1).alias("name"), *others)
        found = one if found is None else found.unionByName(one)
        more = whole.where(F.size("names") > 1)
        if more.isEmpty():
            return found
        pairs = F.transform(
            F.sequence(F.lit(0), ((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.concat_ws(",", F.get("names", 2 * i), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1))).cast("binary"),
        )
        blocks = more.select("rid", F.posexplode(pairs).alias("pos", "key"), *others).select(
            "rid", "pos", "key", *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in others]
        )
        level += 1


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, row_column: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and rid (the row's number: row_column, or made here).

    Texts are equal when they are identical after deletion of space, tab, LF, VT, FF and CR; null counts as
    empty, and empty texts are equal to each other. Of equal texts the row with the most code points stays,
    then the smallest id (null first), then the earlier row, so of repeated rows with one id just one is kept.
    An empty table gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    text = text_of(text_column)
    bare = F.regexp_replace(text, SPACE, "")
    rows = docs.select(
        (F.col(row_column) if row_column else F.monotonically_increasing_id()).alias("rid"),
        bare.cast("binary").alias("key"),
        F.struct(F.length(text).cast("long").alias("n"), F.col(id_column).cast("long").alias("id"), F.unhex(F.sha2(bare, 256)).alias("sha")).alias("own"),
    )
    found = materialize(identify(rows, block).select("rid", "level", "name", "own.*"), "identity")
    best = found.groupBy("level", "name").agg(F.min(F.struct(-F.col("n"), F.col("id"), F.col("rid"))).alias("best"), F.count("*").alias("group_size"))
    # Written, so that the hot groups of the join below lie in plain exchanges that can be split.
    best = best.select("level", "name", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")
    best = materialize(best, "best")
    return found.join(best, ["level", "name"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "rid"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; a semi join on the row's number, so repeated ids are told apart.

    Columns of docs may have any names; the number's own is chosen among free ones.
    """
    own = free_name(docs, "_row")
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    kept = exact_dedup(rows, row_column=own).where("kept").select(F.col("rid").alias(own))
    return rows.join(kept, own, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its class of equal texts."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("rid")


ORACLE_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS s FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS k,
             first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY s) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(s) AS text_sha256 FROM r
"""
