"""Ordered slices of a growing log, floor-index percentiles and running reward figures.

Ranks over a whole log come from one sort in ranges of the whole key and counts a range, percentiles from histograms
of ever narrower ranges, so no single task holds the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent import storage


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with a rank from 0 in the order given, which must be total.

    A sample sort: splitters are sampled from the whole order tuple, of any types, so a leading value that fills many
    ranges is divided by the others. The sorted rows are written once; ranges are as many as shuffle partitions are
    worth for the input, and only a count a range goes through a window.
    """
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    ordered = storage.materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))  # a row a range
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at")).drop("_at", "_part", "_offset")


def in_slices(df: DataFrame, order: list[Column | str], buckets: int) -> DataFrame:
    """df with slice from 1: equal slices of max(1, n // buckets) rows; rows beyond the last whole bucket are left out."""
    ranked = global_rank(df, order)
    size = max(1, ranked.count() // buckets)
    return ranked.withColumn("slice", (F.floor(F.col("rank") / size) + 1).cast("int")).where(F.col("slice") <= buckets).drop("rank")


def summarise(sliced: DataFrame, keys: tuple[str, ...] = ("slice",)) -> DataFrame:
    """Means of rollout records by keys."""
    mean = lambda c: F.avg(c.cast("double"))
    return sliced.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("reward").alias("reward"), mean(F.col("correct")).alias("strict"), mean(F.col("official")).alias("official"),
        mean(F.col("executed")).alias("exec"), mean(F.col("no_from_clause")).alias("no_from"), mean(F.col("empty_result")).alias("empty"),
        mean((F.col("reward") > 0) & ~F.col("correct")).alias("hack"),
    )


def first_last(summary: DataFrame, measures: tuple[str, ...] = ("strict", "official", "no_from", "empty", "hack")) -> DataFrame:
    """(measure, first, last, delta) between the first and the last slice."""
    ends = summary.agg(*[F.min_by(m, "slice").alias(f"{m}_first") for m in measures], *[F.max_by(m, "slice").alias(f"{m}_last") for m in measures])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_first").alias("first"), F.col(f"{m}_last").alias("last")) for m in measures])
    return ends.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.col("last") - F.col("first"))


def degenerate(rollouts: DataFrame) -> DataFrame:
    """Rollouts without a FROM clause, or paid though the strict verdict rejects them."""
    return rollouts.where(F.col("no_from_clause") | ((F.col("reward") > 0) & ~F.col("correct")))


#: Ranges of a histogram pass.
BINS = 1000


def select_at(df: DataFrame, value: Column, indices: list[int]) -> list:
    """The values at places, from 0, of the sorted values, null ones left out; None beyond the end.

    Each pass counts the ranges that the wanted places lie in by BINS bins, of which count, least and greatest value
    reach the driver, and goes on with the bins that hold them until a bin is one value. Bins of a range's two ends
    differ, so every pass narrows; integers and lengths take two or three.
    """
    rows = df.select(value.alias("v")).where("v is not null and not isnan(v)")
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    # Of each place: the range it lies in, and how many values are below that.
    places = {i: (ends.low, ends.high, 0) for i in indices if 0 <= i < ends.n}
    while open_ := sorted({(low, high) for low, high, _ in places.values() if low != high}):
        bin_, own = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (low, high) in enumerate(open_):
            inside = F.col("v").between(F.lit(low), F.lit(high))
            share = F.try_divide(F.col("v").cast("double") / 2 - F.lit(float(low)) / 2, F.lit(float(high)) / 2 - F.lit(float(low)) / 2)
            place = F.when(F.col("v") == F.lit(high), BINS).when(F.col("v") == F.lit(low), -1).otherwise(F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)))
            own, bin_ = F.when(inside, k).otherwise(own), F.when(inside, place.cast("int")).otherwise(bin_)
        counted = rows.select("v", own.alias("own"), bin_.alias("bin")).where("own is not null").groupBy("own", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins: dict[int, list] = {}
        for r in counted.collect():
            bins.setdefault(r.own, []).append(r)
        for i, (low, high, below) in places.items():
            if low != high:
                for r in sorted(bins[open_.index((low, high))], key=lambda r: r.bin):
                    if below + r.n > i:
                        places[i] = (r.low, r.high, below)
                        break
                    below += r.n
    return [places[i][0] if i in places else None for i in indices]


def floor_percentiles(df: DataFrame, value: Column, points: tuple[float, ...], names: tuple[str, ...]) -> DataFrame:
    """One row: for each point p the value at index min(n - 1, int(p n)) of the sorted values, which are numbers; null ones are left out."""
    kind = df.select(value.alias("v")).where("v is not null and not isnan(v)")
    n = kind.count()
    found = select_at(df, value, [min(n - 1, int(p * n)) for p in points])
    shape = ", ".join(f"{name} {kind.schema['v'].dataType.simpleString()}" for name in names)
    return df.sparkSession.createDataFrame([tuple(found)], shape)


#: Characters a token is taken to have when lengths are turned into tokens.
CHARS_PER_TOKEN = 3.6


def length_report(records: DataFrame) -> DataFrame:
    """One row of example lengths: percentiles, the longest's database, estimated tokens. records: question_id, db_id, n_prompt_chars, n_target_chars."""
    total = F.col("n_prompt_chars") + F.col("n_target_chars")
    marks = floor_percentiles(records, total, (0.5, 0.95, 0.99), ("chars_p50", "chars_p95", "chars_p99"))
    rest = records.agg(F.count("*").alias("n"), F.max(total).alias("chars_max"), F.max_by("db_id", F.struct(total, -F.col("question_id"))).alias("longest_db_id"))
    est = lambda c: F.floor(F.col(c) / F.lit(CHARS_PER_TOKEN)).cast("long")
    return rest.crossJoin(marks).select("n", "chars_p50", "chars_p95", "chars_p99", "chars_max", "longest_db_id", est("chars_p99").alias("est_tokens_p99"), est("chars_max").alias("est_tokens_max"))


def over_budget(records: DataFrame, most: int) -> DataFrame:
    """Records of more characters than most, prompt and target together."""
    return records.where(F.col("n_prompt_chars") + F.col("n_target_chars") > most)


def suggested_budget(longest: Column) -> Column:
    """The next but one multiple of 512."""
    return (F.lit(512) * (F.floor(longest / 512) + 2)).cast("long")


def of_split(log: DataFrame, split: str, column: str = "split") -> DataFrame:
    """The log's records of one split."""
    return log.where(F.col(column) == split)


def first_n(df: DataFrame, n: int, position: str = "index") -> DataFrame:
    """The first n rows by position; none for n <= 0."""
    return df.orderBy(position).limit(max(0, n))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "question_id", position: str = "pos") -> DataFrame:
    """The rows of df that a list of ids (key, position) names, with their positions in the list."""
    return df.join(ids.select(key, position), key)


def shown_ids(failed: DataFrame, key: str = "question_id", most: int = 20) -> DataFrame:
    """One row: ids, the first most of the failed ones in order as text, with how many more there are; and n.

    At most most ids are gathered; the count is an aggregate.
    """
    first = failed.select(key).orderBy(key).limit(most).agg(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ", ").alias("ids"))
    n = failed.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" (+"), (F.col("n") - most).cast("string"), F.lit(" more)"))).otherwise("")
    return first.crossJoin(n).select(F.concat("ids", more).alias("ids"), "n")  # one row each


def percentile_at(ranked: str, points: dict[str, Column]) -> list[Column]:
    """Aggregates of running counts: the least value whose running count passes each index."""
    return [F.min(F.when(F.col("_upto") > index, F.col(ranked))).alias(name) for name, index in points.items()]


def _counted(df: DataFrame, by: str, value: Column) -> DataFrame:
    """(by, v, _upto, _n): distinct values with running counts in each group, and the group's size."""
    counts = df.select(F.col(by), value.alias("v")).groupBy(by, "v").agg(F.count("*").alias("c"))
    own = Window.partitionBy(by)
    return counts.withColumn("_upto", F.sum("c").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("c").over(own))


def prompt_length_stats(rows: DataFrame, tag: str = "split", chars: str = "chars", database: str = "db_id") -> DataFrame:
    """By tag: n, distinct databases, the middle, 99th percentile and longest of the prompts' characters, and its estimated tokens."""
    marks = _counted(rows, tag, F.col(chars)).groupBy(tag).agg(
        *percentile_at("v", {"prompt_chars_p50": F.floor(F.col("_n") / 2), "prompt_chars_p99": F.least(F.col("_n") - 1, F.floor(F.lit(0.99) * F.col("_n")))}),
        F.max("v").alias("prompt_chars_max"),
    )
    sizes = rows.groupBy(tag).agg(F.count("*").alias("n"), F.countDistinct(database).alias("n_databases"))
    return sizes.join(marks, tag).withColumn("est_prompt_tokens_max", F.floor(F.col("prompt_chars_max") / F.lit(CHARS_PER_TOKEN)).cast("long"))


def diagnostic_summary(rows: DataFrame, most_tokens: int, by: str = "variant") -> DataFrame:
    """By variant: prompt tokens' percentiles, rows over budget, and how well selected tables cover what is required.

    rows: variant, prompt_tokens, n_selected_tables, all_required_tables_retained, required_table_recall,
    fk_connectivity_checkable, fk_connectivity_retained, n_distractor_tables, distractor_table_rate. The rate of
    retained connectivity counts checkable rows only and is null without any.
    """
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
    tokens = _counted(rows, by, F.col("prompt_tokens")).groupBy(by).agg(*percentile_at("v", {f"prompt_tokens_p{round(100 * p)}": at(p) for p in (0.5, 0.95, 0.99)}))
    distracting = _counted(rows, by, F.col("n_distractor_tables")).groupBy(by).agg(*percentile_at("v", {"distractor_tables_p95": at(0.95)}))
    mean = lambda c, digits: F.round(F.avg(F.col(c).cast("double")), digits)
    over, checkable = (F.col("prompt_tokens") > most_tokens).cast("int"), F.col("fk_connectivity_checkable")
    whole = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.max("prompt_tokens").alias("prompt_tokens_max"), F.sum(over).alias("n_over_budget"), F.round(F.avg(over), 4).alias("over_budget_rate"),
        mean("n_selected_tables", 2).alias("mean_selected_tables"), mean("all_required_tables_retained", 4).alias("all_required_tables_retained_rate"),
        mean("required_table_recall", 4).alias("mean_required_table_recall"), F.sum(checkable.cast("int")).alias("n_fk_connectivity_checkable"),
        F.round(F.avg(F.when(checkable, F.col("fk_connectivity_retained").cast("double"))), 4).alias("fk_connectivity_retained_rate"),
        mean("n_distractor_tables", 2).alias("mean_distractor_tables"), mean("distractor_table_rate", 4).alias("mean_distractor_rate"),
    )
    return whole.join(tokens, by).join(distracting, by)


def distinct_databases(rows: DataFrame, database: str = "db_id") -> DataFrame:
    """One row: how many databases rows have."""
    return rows.agg(F.countDistinct(database).alias("n_databases"))
