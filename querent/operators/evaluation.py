"""Reports over outcomes of evaluated queries: rates by group, histograms, paired runs, result shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.sqltext import extract_sql, strip


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage of whole, rounded; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, digits))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0))


def with_predictions(examples: DataFrame, predictions: DataFrame, extract: bool = True) -> DataFrame:
    """examples with completion and pred_sql of predictions (question_id, completion); absent ones are empty."""
    joined = examples.join(predictions.select("question_id", "completion"), "question_id", "left")
    completion = F.coalesce("completion", F.lit(""))
    return joined.withColumn("completion", completion).withColumn("pred_sql", extract_sql(completion) if extract else strip(completion))


def by_group(outcomes: DataFrame, group: str = "difficulty") -> DataFrame:
    """n, official_ex and strict_ex by group in one rollup; null and empty groups are "unknown", the total is "all"."""
    name = F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown"))
    rolled = outcomes.select(name.alias("bucket"), "official", "strict").rollup("bucket").agg(
        F.count("*").alias("n"), rate(count_if(F.col("official")), F.count("*")).alias("official_ex"), rate(count_if(F.col("strict")), F.count("*")).alias("strict_ex"),
        F.grouping("bucket").alias("total"),
    )
    return rolled.select(F.when(F.col("total") == 1, "all").otherwise(F.col("bucket")).alias(group), "n", "official_ex", "strict_ex")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """One row: counts of column's values other than null as a map."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(f"{column}_counts"))


def report(outcomes: DataFrame) -> DataFrame:
    """One row of totals: rates, verdict gaps, empty golds, missing and unparsed predictions.

    outcomes: official, strict, gold_empty, completion, pred_sql.
    """
    n = F.count("*")
    missing = F.coalesce(F.col("completion"), F.lit("")) == ""
    return outcomes.agg(
        n.alias("n"), rate(count_if(F.col("official")), n).alias("official_ex"), rate(count_if(F.col("strict")), n).alias("strict_ex"),
        count_if(F.col("official") & ~F.col("strict")).alias("n_official_not_strict"), count_if(~F.col("official") & F.col("strict")).alias("n_strict_not_official"),
        count_if(F.col("gold_empty")).alias("n_gold_empty"), count_if(F.col("gold_empty") & F.col("official")).alias("n_gold_empty_official_pass"),
        count_if(missing).alias("n_missing_predictions"), count_if(~missing & (F.col("pred_sql") == "")).alias("n_unparsed"),
    )


def metrics(outcomes: DataFrame, group: str = "difficulty") -> dict[str, float]:
    """The flat metrics of a run for the ledger; a handful of aggregate rows reach the driver."""
    total = report(outcomes).first().asDict()
    total.pop("n")
    for row in by_group(outcomes, group).where(F.col(group) != "all").orderBy(group).collect():
        total |= {f"official_ex_{row[group]}": row.official_ex, f"n_{row[group]}": row.n}
    return total


def paired(first: DataFrame, second: DataFrame, verdict: str = "official", key: str = "question_id") -> DataFrame:
    """How many questions both runs, only one, or neither got right; absent ones count as not right."""
    a, b = (r.select(key, F.col(verdict).alias(n)) for r, n in ((first, "a"), (second, "b")))
    joined = a.join(b, key, "full")
    was, now = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    change = F.when(was & now, "both").when(was, "lost").when(now, "gained").otherwise("neither")
    return joined.select(change.alias("change")).groupBy("change").agg(F.count("*").alias("n"))


# --- result shapes ---------------------------------------------------------------------------------


def gold_facts(examples: DataFrame, results: DataFrame, rows: DataFrame) -> DataFrame:
    """What each gold result looks like: counts, duplicate canonical rows, top-level order."""
    from querent.functions.sqltext import has_top_level_order_by

    shape = rows.groupBy("exec_id").agg((F.count("*") - F.count_distinct("canon")).alias("n_duplicate_rows"))
    joined = examples.join(results, F.col("gold_sql") == F.col("exec_id"), "left").join(shape, "exec_id", "left")
    return joined.select(
        "question_id", "db_id", "difficulty", F.coalesce("status", F.lit("rejected")).alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_cols", F.lit(0)).alias("n_cols"), F.coalesce("n_duplicate_rows", F.lit(0)).alias("n_duplicate_rows"),
        has_top_level_order_by(F.col("gold_sql")).alias("has_top_level_order_by"), F.round(F.coalesce("elapsed_s", F.lit(0.0)), 3).alias("elapsed_s"),
    )


def exploitable() -> Column:
    """Whether a gold result lets the official verdict be satisfied without an answer."""
    return (F.col("status") == "ok") & ((F.col("n_rows") == 0) | (F.col("n_duplicate_rows") > 0))


def surface(facts: DataFrame) -> DataFrame:
    """One row of shape counts over executable golds; the rate is of all."""
    ok = F.col("status") == "ok"
    n = F.count("*")
    return facts.agg(
        n.alias("n"), count_if(ok).alias("n_executable"), count_if(ok & (F.col("n_rows") == 0)).alias("n_empty"),
        count_if(ok & (F.col("n_duplicate_rows") > 0)).alias("n_with_duplicates"), count_if(exploitable()).alias("n_exploitable"),
        rate(count_if(exploitable()), n).alias("exploitable_rate"), count_if(ok & (F.col("n_rows") == 1)).alias("n_single_row"),
        count_if(ok & (F.col("n_cols") == 1)).alias("n_single_column"), count_if(ok & F.col("has_top_level_order_by")).alias("n_ordered"),
    )


def exploitable_ids(facts: DataFrame) -> DataFrame:
    """(question_id, kind): exploitable and failed golds, one row each."""
    kind = F.when(F.col("status") != "ok", "failed").when(exploitable(), "exploitable")
    return facts.select("question_id", kind.alias("kind")).where("kind is not null")


def slowest(facts: DataFrame, n: int = 5) -> DataFrame:
    """The n slowest golds, ties to smaller ids."""
    return facts.orderBy(F.desc("elapsed_s"), "question_id").limit(n)
