"""Keys that compare result cells: canonical ones for the strict verdict, exact ones for the official verdict."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Significant digits of floats that aren't whole, and the magnitude from which floats no longer hold all integers.
FLOAT_DIGITS = 6
EXACT_LIMIT = float(2**53)


def _significant(digits: int):
    @F.pandas_udf(T.StringType())
    def shown(values: pd.Series) -> pd.Series:
        # Binary ties round half to even here; the JVM's formatter rounds them up.
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}g}")

    return shown


def canonical_key(column: Column, kind: T.DataType, digits: int = FLOAT_DIGITS) -> Column:
    """A tagged string: cells with equal keys count as equal in the strict verdict.

    Booleans, integers and whole floats below 2^53 are integers; other floats keep so many significant digits;
    null, text and bytes are never equal to each other or to numbers.
    """
    if isinstance(kind, T.BooleanType):
        key = F.concat(F.lit("i:"), column.cast("int").cast("string"))
    elif isinstance(kind, T.IntegralType):
        key = F.concat(F.lit("i:"), column.cast("string"))
    elif isinstance(kind, T.FractionalType):
        value = column.cast("double")
        whole = (value == F.floor(value).cast("double")) & (F.abs(value) < EXACT_LIMIT)
        odd = F.when(~whole & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
        key = (
            F.when(F.isnan(value), "f:nan")
            .when(value == float("inf"), "f:inf")
            .when(value == float("-inf"), "f:-inf")
            .when(whole, F.concat(F.lit("i:"), value.cast("bigint").cast("string")))
            .otherwise(F.concat(F.lit("f:"), _significant(digits)(odd)))
        )
    elif isinstance(kind, T.BinaryType):
        key = F.concat(F.lit("b:"), F.lower(F.hex(column)))
    elif isinstance(kind, T.StringType):
        key = F.concat(F.lit("s:"), column)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        key = F.concat(F.lit("o:"), column.cast("string"))
    return F.coalesce(key, F.lit("null"))


def exact_key(column: Column, kind: T.DataType) -> Column:
    """A tagged string: cells with equal keys are equal as raw values, numbers by value, so 1, 1.0 and true are one."""
    if isinstance(kind, T.BooleanType):
        key = F.concat(F.lit("n:"), column.cast("int").cast("string"))
    elif isinstance(kind, T.IntegralType):
        key = F.concat(F.lit("n:"), column.cast("string"))
    elif isinstance(kind, T.FractionalType):
        value = column.cast("double")
        whole = (value == F.floor(value).cast("double")) & (F.abs(value) < 1e37)
        # A whole double's integer is exact; the shortest decimal of any other names one double.
        key = F.when(whole, F.concat(F.lit("n:"), F.when(whole, value).cast("decimal(38,0)").cast("string"))).otherwise(F.concat(F.lit("d:"), value.cast("string")))
    elif isinstance(kind, T.BinaryType):
        key = F.concat(F.lit("b:"), F.lower(F.hex(column)))
    elif isinstance(kind, T.StringType):
        key = F.concat(F.lit("s:"), column)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        key = F.concat(F.lit("o:"), column.cast("string"))
    return F.coalesce(key, F.lit("null"))


def with_keys(df: DataFrame, digits: int = FLOAT_DIGITS) -> DataFrame:
    """(canon, exact): the keys of each row's cells in column order; repeated column names are fine."""
    fields = df.schema.fields
    plain = df.toDF(*[f"c{i}" for i in range(len(fields))])
    canon = [canonical_key(F.col(f"c{i}"), f.dataType, digits) for i, f in enumerate(fields)]
    exact = [exact_key(F.col(f"c{i}"), f.dataType) for i, f in enumerate(fields)]
    return plain.select(F.array(*canon).alias("canon"), F.array(*exact).alias("exact"))
