"""Exact distinct counts and label counts for many columns in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = 64


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def long_text(col: Column) -> Column:
    """Text, or its SHA-256 where it is long.

    Counting distinct documents then does not send the documents through the
    shuffle. The prefix makes a digest longer than any text kept as it is.
    """
    return F.when(F.length(col) > _LONG, F.concat(F.lit("sha:"), F.sha2(col, 256))).otherwise(col)


def _key(col: Column, data_type: T.DataType) -> tuple[str, Column]:
    """(type family, key that is equal exactly for equal values)."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole", col.cast("bigint")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # Adding zero turns -0.0 into 0.0.
        return data_type.simpleString(), F.nanvl(col, F.lit(None).cast(data_type)) + F.lit(0.0).cast(data_type)
    if isinstance(data_type, (T.DateType, T.TimestampType)):
        return "time", col.cast("timestamp")
    if isinstance(data_type, T.BinaryType):
        return "text", long_text(F.base64(col))
    return "text", long_text(col.cast("string"))


def long_form(df: DataFrame, columns: Mapping[str, Column], *carry: Column) -> DataFrame:
    """One row per (column, value), plus ``carry0`` and so on; all values of one type.

    The rows only widen inside the scan stage; the grouping that follows
    combines them before anything is shuffled.
    """
    kept = [f"carry{i}" for i in range(len(carry))]
    picked = df.select(*[c.alias(k) for c, k in zip(carry, kept)],
                       *[c.alias(n) for n, c in columns.items()])
    rows = picked.unpivot(kept, [quoted(n) for n in columns], "column", "value")
    return rows.filter(F.col("value").isNotNull())


def distinct_count_frame(df: DataFrame, names) -> DataFrame:
    """``column, unique_values``: exact number of distinct non-null values.

    Columns of one type share a pass, so that keys keep their native type.
    """
    families: dict[str, dict[str, Column]] = {}
    for name in names:
        family, key = _key(quoted(name), df.schema[name].dataType)
        families.setdefault(family, {})[name] = key
    parts = [
        long_form(df, columns).groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count("*").alias("unique_values"))
        for columns in families.values()]
    return reduce(DataFrame.unionAll, parts)


def distinct_counts(df: DataFrame, names) -> dict[str, int]:
    names = list(names)
    if not names:
        return {}
    found = {r["column"]: r.unique_values for r in distinct_count_frame(df, names).collect()}
    return {n: found.get(n, 0) for n in names}


def label_counts(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``column, value, rows`` for string columns with few distinct labels."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("rows"))
