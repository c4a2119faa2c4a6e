"""Filters, search, sorting and paging of a cleaned table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions.numbers import plain_text
from tablescope.operators.distinct import distinct_counts, label_counts, quoted
from tablescope.operators.profiling import measure
from tablescope.plans.profile import Profile

DOMAIN_SCHEMA = "column string, kind string, value string, low double, high double, first date, last date"


def filter_categories(df: DataFrame, selected: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keep rows whose value is among those selected; nothing selected filters nothing."""
    for name, values in selected.items():
        if values:
            df = df.filter(plain_text(quoted(name), df.schema[name].dataType).isin([str(v) for v in values]))
    return df


def filter_numbers(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep rows within the range, both ends included; NULL is outside."""
    for name, (low, high) in ranges.items():
        # The bare column, so that the comparison reaches the scan.
        value = quoted(name) if dict(df.dtypes)[name] != "string" else measure(df, name)
        df = df.filter(value.between(low, high))
    return df


def filter_dates(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """Keep rows from the first day to the last, both whole days; NULL is outside."""
    for name, (first, last) in ranges.items():
        # Bounds of the column's own type, so that the comparison reaches the scan.
        kind = df.schema[name].dataType
        after = F.date_add(F.lit(str(last)).cast("date"), 1).cast(kind)
        df = df.filter((quoted(name) >= F.lit(str(first)).cast("date").cast(kind)) & (quoted(name) < after))
    return df


def search(df: DataFrame, needle: str) -> DataFrame:
    """Rows in which any column holds ``needle``, regardless of case."""
    needle = needle.strip().lower()
    if not needle:
        return df
    found = F.lit(False)
    for field in df.schema.fields:
        shown = F.lower(plain_text(quoted(field.name), field.dataType))
        found = found | F.coalesce(shown.contains(needle), F.lit(False))
    return df.filter(found)


def sort_page(df: DataFrame, by: str, descending: bool = True, rows: int = 50,
              then: Sequence[str] = ()) -> DataFrame:
    """The first ``rows`` rows by one column, NULLs last; ``then`` settles ties."""
    column = quoted(by)
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return df.orderBy(order, *[quoted(t).asc_nulls_last() for t in then]).limit(rows)


def filter_domains(df: DataFrame, profile: Profile) -> DataFrame:
    """What there is to filter by: the values of categories with at most 50, and
    the range of each number and date that has more than one value."""
    spark = df.sparkSession
    names = list(profile.category_columns)
    known = {n: profile.columns[n].unique_values for n in names}
    if not all(known.values()):
        known = distinct_counts(df, names)
    few = {n: plain_text(quoted(n), df.schema[n].dataType) for n in names if 0 < known[n] <= fv.FILTER_OPTIONS}
    parts = []
    if few:
        parts.append(label_counts(df, few).select(
            "column", F.lit("category").alias("kind"), "value", F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"), F.lit(None).cast("date").alias("first"),
            F.lit(None).cast("date").alias("last")))
    ranges = []
    for n in profile.measure_columns + profile.percent_columns:
        value = measure(df, n)
        ranges.append(F.struct(F.lit(n), F.lit("number"), F.lit(None).cast("string"), F.min(value),
                               F.max(value), F.lit(None).cast("date"), F.lit(None).cast("date")))
    for n in profile.date_columns:
        day = quoted(n).cast("date")
        ranges.append(F.struct(F.lit(n), F.lit("date"), F.lit(None).cast("string"),
                               F.lit(None).cast("double"), F.lit(None).cast("double"), F.min(day), F.max(day)))
    if ranges:
        rows = df.agg(F.array(*ranges).alias("r")).select(F.inline("r")).toDF(
            "column", "kind", "value", "low", "high", "first", "last")
        parts.append(rows.filter("(kind = 'number' and low < high) or (kind = 'date' and first < last)"))
    out = spark.createDataFrame([], DOMAIN_SCHEMA)
    for part in parts:
        out = out.unionByName(part)
    return out


def selection_size(df: DataFrame, selected: DataFrame) -> tuple[int, int]:
    """Rows selected, and the difference to all rows."""
    chosen = selected.count()
    return chosen, chosen - df.count()
