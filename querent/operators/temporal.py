"""Joins by nearness: the latest earlier row (as-of) and points in intervals (range), both dealt by buckets of time or value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a task that puts one side of a range join in order; so many longs fit a Parquet dictionary's megabyte.
TASK = 100_000


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def as_of_join(left: DataFrame, right: DataFrame, on: str, carried: str, keys: tuple[str, ...] = (), width: float = 86_400.0) -> DataFrame:
    """left with the column carried of right's latest row at or before it in on (numeric or time), null where there is none.

    Both sides are stacked and dealt by keys and buckets of width (seconds for times); inside a bucket the last
    value is carried forward. What a bucket starts from comes from a window over one row a bucket, so no task
    holds all rows of a key. Of right's rows at one point the greatest carried counts. Rows of left without a time or
    a key stay, with null; those of right match nothing.
    """
    point = F.unix_micros(F.col(on).cast("timestamp")) / 1e6 if dict(left.dtypes)[on].startswith("timestamp") else F.col(on).cast("double")
    own = F.struct(*left.columns)
    shape = left.select(own.alias("row")).schema["row"].dataType
    one = right.dropna(subset=[*keys, on]).groupBy(*keys, on).agg(F.max(carried).alias(carried))
    stacked = left.select(*keys, point.alias("_t"), own.alias("_row"), F.lit(None).cast(dict(right.dtypes)[carried]).alias("_v")).unionByName(
        one.select(*keys, point.alias("_t"), F.lit(None).cast(shape).alias("_row"), F.col(carried).alias("_v"))
    )
    dealt = stacked.withColumn("_b", _bucket(F.col("_t"), width))
    ends = dealt.where("_v is not null").groupBy(*keys, "_b").agg(F.max_by("_v", "_t").alias("_end"))
    buckets = dealt.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).where("_row is not null").join(starts, [*keys, "_b"], "left")
    return found.select("_row.*", F.coalesce("_own", "_start").alias(carried))


def range_join(points: DataFrame, spans: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs of points and spans with low <= at < high: an equi-join on buckets of width, then the exact condition.

    A span is copied to the buckets it touches, so width should be about a span's length; without buckets the
    join would compare all pairs. Both sides come in order, so near points meet the same spans one after the other:
    the pairs, which may be far more than the rows of both, take little room where columns are written by dictionary.
    """

    def ordered(df: DataFrame, by: str) -> DataFrame:
        parts = max(16, df.count() // TASK)
        ties = F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))
        return df.repartitionByRange(parts, by, ties).sortWithinPartitions(by)

    cut = ordered(points.withColumn("_at", at), "_at").withColumn("_b", _bucket(F.col("_at"), width))
    ends = ordered(spans.withColumn("_low", low).withColumn("_high", high).where("_low < _high"), "_low")
    touched = ends.withColumn("_b", F.explode(F.sequence(_bucket(F.col("_low"), width), _bucket(F.col("_high"), width))))
    return cut.join(touched, "_b").where("_low <= _at and _at < _high").drop("_b", "_at", "_low", "_high")
