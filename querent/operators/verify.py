"""Comparing result sets: the official verdict over sets of raw rows, the strict one over multisets of canonical rows.

Both sides are keyed, stacked with a sign and aggregated by key, so one map-side combined shuffle decides each
verdict whatever the size; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.canonical import FLOAT_DIGITS, with_keys
from querent.functions.sqltext import has_top_level_order_by

ORDER_POLICIES = ("ignore", "gold_order_by", "always")


def check_policy(policy: str) -> None:
    if policy not in ORDER_POLICIES:
        raise ValueError(f"order_policy must be one of {ORDER_POLICIES}, got {policy!r}")


def _tally(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Per by and key: how often on either side."""
    return rows.groupBy(*by, key).agg(F.sum(F.col("side")).alias("p"), F.sum(1 - F.col("side")).alias("g"))


def compare_frames(pred: DataFrame, gold: DataFrame, digits: int = FLOAT_DIGITS) -> DataFrame:
    """One row (official, strict, reason, counts) for two results of any size, row order ignored."""
    rows = with_keys(pred, digits).withColumn("side", F.lit(1)).unionByName(with_keys(gold, digits).withColumn("side", F.lit(0)))
    exact = _tally(rows, "exact", []).agg(F.coalesce(F.sum(((F.col("p") > 0) != (F.col("g") > 0)).cast("long")), F.lit(0)).alias("differ"))
    canon = _tally(rows, "canon", []).agg(
        F.coalesce(F.sum((F.col("p") != F.col("g")).cast("long")), F.lit(0)).alias("off"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("pred_n_rows"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold_n_rows"),
    )
    n_pred, n_gold = len(pred.columns), len(gold.columns)
    both = exact.crossJoin(canon)  # one row each
    reason = (
        F.when(F.lit(n_pred != n_gold), "column_count")
        .when((F.col("off") > 0) & (F.col("pred_n_rows") != F.col("gold_n_rows")), "row_count")
        .when(F.col("off") > 0, "row_values")
    )
    return both.select(
        (F.col("differ") == 0).alias("official"), reason.isNull().alias("strict"), reason.alias("reason"), "pred_n_rows", "gold_n_rows",
        F.lit(n_pred).alias("pred_n_cols"), F.lit(n_gold).alias("gold_n_cols"),
    )


def compare_runs(pairs: DataFrame, results: DataFrame, rows: DataFrame, policy: str = "ignore") -> DataFrame:
    """Verdicts of many pairs at once.

    pairs: pair_id, pred_id, gold_id (null: nothing was run), gold_sql. results: exec_id, status, n_rows, n_cols,
    truncated. rows: exec_id, row_idx, canon, exact. The first reason that applies counts: gold_failed,
    pred_failed, truncated, column_count, row_count, row_values, row_order.
    """
    check_policy(policy)
    own = ["exec_id", "status", "n_rows", "n_cols", "truncated"]
    sides = pairs
    for side in ("pred", "gold"):
        sides = sides.join(results.select(*[F.col(c).alias(f"{side}_{c}") for c in own]), F.col(f"{side}_id") == F.col(f"{side}_exec_id"), "left")
    stacked = (
        pairs.join(rows, F.col("pred_id") == rows["exec_id"]).select("pair_id", "row_idx", "canon", "exact", F.lit(1).alias("side"))
        .unionByName(pairs.join(rows, F.col("gold_id") == rows["exec_id"]).select("pair_id", "row_idx", "canon", "exact", F.lit(0).alias("side")))
    )
    exact = _tally(stacked, "exact", ["pair_id"]).groupBy("pair_id").agg(F.sum(((F.col("p") > 0) != (F.col("g") > 0)).cast("long")).alias("differ"))
    canon = _tally(stacked, "canon", ["pair_id"]).groupBy("pair_id").agg(F.sum((F.col("p") != F.col("g")).cast("long")).alias("off"))
    at = stacked.groupBy("pair_id", "row_idx").agg(F.count_distinct("canon").alias("kinds"), F.count("*").alias("n"))
    order = at.groupBy("pair_id").agg(F.sum(((F.col("kinds") > 1) | (F.col("n") != 2)).cast("long")).alias("moved"))
    joined = sides
    for part in (exact, canon, order):
        joined = joined.join(part, "pair_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = lambda s: F.coalesce(F.col(f"{s}_status"), F.lit("rejected"))
    ok = (status("pred") == "ok") & (status("gold") == "ok")
    gold_order = has_top_level_order_by(F.col("gold_sql"))
    enforced: Column = F.lit(policy == "always") | (F.lit(policy == "gold_order_by") & gold_order)
    matches = count("moved") == 0
    reason = (
        F.when(status("gold") != "ok", "gold_failed")
        .when(status("pred") != "ok", "pred_failed")
        .when(F.coalesce("pred_truncated", F.lit(False)) | F.coalesce("gold_truncated", F.lit(False)), "truncated")
        .when(count("pred_n_cols") != count("gold_n_cols"), "column_count")
        .when((count("off") > 0) & (count("pred_n_rows") != count("gold_n_rows")), "row_count")
        .when(count("off") > 0, "row_values")
        .when(enforced & ~matches, "row_order")
    )
    return joined.select(
        "pair_id", (ok & (count("differ") == 0)).alias("official"), reason.isNull().alias("strict"), reason.alias("reason"),
        status("pred").alias("pred_status"), status("gold").alias("gold_status"),
        *[count(f"{s}_{c}").alias(f"{s}_{c}") for s in ("pred", "gold") for c in ("n_rows", "n_cols")],
        (count("gold_n_rows") == 0).alias("gold_empty"), gold_order.alias("gold_has_order_by"), (reason.isNull() & matches).alias("order_matches"),
    )
