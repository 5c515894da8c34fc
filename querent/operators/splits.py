"""Train and validation splits: why rows are excluded, group-disjoint and sampled validation sets.

Order is by a hash of the key and the seed, the same on any cluster; nothing depends on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = ("no_gold", "no_facts", "not_executable", "too_slow")


def exclusion_reason(max_seconds: float = 10.0) -> Column:
    """The first reason that applies to examples joined with facts (status, elapsed_s), or null."""
    return (
        F.when(F.coalesce(F.col("gold_sql"), F.lit("")) == "", "no_gold")
        .when(F.col("status").isNull(), "no_facts")
        .when(F.col("status") != "ok", "not_executable")
        .when(F.lit(max_seconds > 0) & (F.col("elapsed_s") > max_seconds), "too_slow")
    )


def shuffled(key: Column, seed: int) -> Column:
    """What orders keys at random, the same everywhere: a digest of the seed and the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _groups(eligible: DataFrame, target: int, seed: int) -> DataFrame:
    """Whole groups in shuffled order until target rows are taken; at least one group stays. One row a group, so the window is over few rows."""
    sizes = eligible.groupBy("db_id").agg(F.count("*").alias("n"))
    order = Window.orderBy(shuffled(F.col("db_id"), seed), "db_id")
    ranked = sizes.select(
        "db_id", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy()).alias("groups"),
    )
    return ranked.where((F.col("before") < target) & (F.col("place") < F.col("groups"))).select("db_id")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order."""
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n)


def plan_splits(examples: DataFrame, facts: DataFrame, val_size: int = 500, strategy: str = "db_disjoint", seed: int = 0, max_seconds: float = 10.0) -> DataFrame:
    """(question_id, db_id, part, reason): every example in train, val or excluded, with the reason in the last case."""
    if strategy not in ("db_disjoint", "random"):
        raise ValueError(f"strategy must be db_disjoint or random, got {strategy!r}")
    if val_size < 0:
        raise ValueError(f"val_size must not be negative, got {val_size}")
    joined = examples.join(facts.select("question_id", "status", "elapsed_s"), "question_id", "left").withColumn("reason", exclusion_reason(max_seconds))
    eligible = joined.where("reason is null")
    if strategy == "db_disjoint":
        chosen, on = _groups(eligible, val_size, seed).withColumn("chosen", F.lit(True)), "db_id"
    else:
        chosen, on = sample(eligible, "question_id", val_size, seed).select("question_id").withColumn("chosen", F.lit(True)), "question_id"
    marked = joined.join(chosen, on, "left")
    part = F.when(F.col("reason").isNotNull(), "excluded").when(F.coalesce("chosen", F.lit(False)), "val").otherwise("train")
    return marked.select("question_id", "db_id", part.alias("part"), "reason")


def split_counts(assignments: DataFrame) -> DataFrame:
    """Rows by part and reason; absent ones have no row."""
    return assignments.groupBy("part", "reason").agg(F.count("*").alias("n"))
