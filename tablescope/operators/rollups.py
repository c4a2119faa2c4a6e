"""The datasets behind a dashboard: trend, top ten, shares, status, distribution."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import fixed_values as fv
from tablescope.operators.distinct import distinct_counts, quoted
from tablescope.operators.profiling import measure as as_double
from tablescope.operators.profiling import profile_dataset
from tablescope.plans.profile import Profile

_STEPS = {"quarter": "interval 3 months", "month": "interval 1 month",
          "week": "interval 7 days", "day": "interval 1 day"}


@dataclass
class Rollup:
    """One dataset worth showing, and why."""

    key: str
    title: str
    description: str
    data: DataFrame


def _active_values(df: DataFrame, profile: Profile, measure: str) -> Column:
    return F.when(profile.is_active(), as_double(df, measure))


def bucket(date: Column, grain: str) -> Column:
    """Start of the quarter, month or day; for weeks the Sunday that ends it."""
    if grain == "week":
        return F.next_day(F.date_sub(date, 1), "SUN")
    return F.trunc(date, grain) if grain != "day" else date.cast("date")


def choose_grain(days: int) -> str:
    return "quarter" if days > 730 else "month" if days > 90 else "week" if days > 14 else "day"


def _dated(df: DataFrame, profile: Profile, measure: str) -> DataFrame:
    return (df.filter(profile.is_active())
            .select(quoted(profile.primary_date).cast("timestamp").alias("date"),
                    as_double(df, measure).alias("value"))
            .filter("date is not null and value is not null"))


def trend_grain(df: DataFrame, profile: Profile, measure: str) -> str | None:
    """Grain that suits the span of the data, None if there are no dates."""
    seconds = F.max("date").cast("double") - F.min("date").cast("double")
    days = _dated(df, profile, measure).agg(F.floor(seconds / 86400).alias("d")).first().d
    return None if days is None else choose_grain(days)


def trend(df: DataFrame, profile: Profile, measure: str | None = None,
          grain: str | None = None) -> DataFrame:
    """``bucket, value`` over the whole span; buckets without rows hold 0."""
    measure = measure or profile.primary_measure
    grain = grain or trend_grain(df, profile, measure) or "day"
    sums = (_dated(df, profile, measure).groupBy(bucket(F.col("date"), grain).alias("bucket"))
            .agg(F.sum("value").alias("value")))
    # The calendar has one row per bucket of the span.
    calendar = sums.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr(_STEPS[grain]))).alias("bucket"))
    return (calendar.join(sums, "bucket", "left")
            .select("bucket", F.coalesce("value", F.lit(0.0)).alias("value")))


def _grouped(df: DataFrame, profile: Profile, dimension: str, measure: str) -> DataFrame:
    return (df.filter(profile.is_active())
            .select(quoted(dimension).alias("key"), as_double(df, measure).alias("v"))
            .filter("key is not null and v is not null").groupBy("key").agg(F.sum("v").alias("value")))


def top_categories(df: DataFrame, profile: Profile, dimension: str,
                   measure: str | None = None, n: int = fv.TOP_N) -> DataFrame:
    """The ``n`` keys with the largest totals: ``key, value``."""
    grouped = _grouped(df, profile, dimension, measure or profile.primary_measure)
    return grouped.orderBy(F.desc("value"), "key").limit(n)


def share(df: DataFrame, profile: Profile, dimension: str, measure: str | None = None,
          slices: int = fv.SHARE_SLICES) -> DataFrame:
    """``key, value, share_pct`` of positive totals; beyond ``slices`` keys the
    smaller ones are summed up as others."""
    positive = _grouped(df, profile, dimension, measure or profile.primary_measure).filter("value > 0")
    positive = positive.select(F.col("key").cast("string").alias("key"), "value")
    largest = positive.orderBy(F.desc("value"), "key").limit(slices + 1).collect()
    if len(largest) > slices:
        # The others are summed themselves: what is left of a large total would lose their digits.
        shown = largest[:slices - 1]
        rest = positive.filter(~F.col("key").isin([r["key"] for r in shown])).agg(F.sum("value")).first()[0]
        rows = [(r["key"], r["value"]) for r in shown] + [(fv.OTHERS, rest)]
    else:
        rows = [(r["key"], r["value"]) for r in largest]
    total = math.fsum(float(v) for _, v in rows)
    return df.sparkSession.createDataFrame(
        [(k, v, float(v) / total * 100) for k, v in rows],
        T.StructType([T.StructField("key", T.StringType()), positive.schema["value"], T.StructField("share_pct", T.DoubleType())]))


def status_counts(df: DataFrame, profile: Profile) -> DataFrame:
    """Rows per status over all rows, most frequent first."""
    return (df.select(quoted(profile.status_column).alias("key")).filter("key is not null")
            .groupBy("key").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "key"))


def distribution(df: DataFrame, profile: Profile, measure: str | None = None,
                 bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """``bin, low, high, rows``: a histogram with ``bins`` equal parts, empty ones included."""
    value = as_double(df, measure or profile.primary_measure)
    values = df.filter(profile.is_active()).select(value.alias("v")).filter("v is not null")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    spark = df.sparkSession
    if ends.lo is None or ends.lo == ends.hi:
        rows = [] if ends.lo is None else [(1, ends.lo, ends.hi, ends.n)]
        return spark.createDataFrame(rows, "bin int, low double, high double, rows bigint")
    width = (ends.hi - ends.lo) / bins
    # The largest value belongs to the last bin.
    place = F.least(F.width_bucket("v", F.lit(ends.lo), F.lit(ends.hi), F.lit(bins)), F.lit(bins)).cast("int")
    counted = values.groupBy(place.alias("bin")).agg(F.count("*").alias("rows"))
    edges = spark.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"), (F.lit(ends.lo) + (F.col("id") - 1) * width).alias("low"),
        (F.lit(ends.lo) + F.col("id") * width).alias("high"))
    return edges.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("rows", F.lit(0)).alias("rows"))


def create_charts(df: DataFrame, profile: Profile | None = None) -> list[Rollup]:
    """Choose the datasets that suit the meaning of the data.

    Only a handful of counts is looked at here; the datasets stay lazy.
    """
    if not isinstance(df, DataFrame) or not df.columns:
        return []
    if profile is None:
        if df.isEmpty():
            return []
        profile = profile_dataset(df)
    measure = profile.primary_measure
    if not measure:
        return []
    dimensions = [c for c in profile.dimension_candidates() if c != profile.status_column]
    value = _active_values(df, profile, measure)
    facts = [F.count("*").alias("rows"), F.approx_count_distinct(value).alias("values")]
    facts += [F.count(F.when(quoted(d).isNotNull(), value)).alias(f"d{i}") for i, d in enumerate(dimensions[:2])]
    facts += [F.approx_count_distinct(quoted(d)).alias(f"u{i}") for i, d in enumerate(dimensions)]
    if profile.status_column:
        facts.append(F.count(quoted(profile.status_column)).alias("statuses"))
    if profile.primary_date:
        date = F.when(value.isNotNull(), quoted(profile.primary_date).cast("timestamp"))
        facts += [F.min(date).cast("double").alias("lo"), F.max(date).cast("double").alias("hi")]
        for grain in _STEPS:
            facts.append((F.min(bucket(date, grain)) < F.max(bucket(date, grain))).alias(f"many_{grain}"))
    seen = df.agg(*facts).first().asDict()
    if not seen["rows"]:
        return []

    out: list[Rollup] = []

    def add(kind, key, data, **values):
        title, description = fv.ROLLUP_TEXTS[kind]
        out.append(Rollup(key, title.format(measure=measure, **values),
                          description.format(measure=measure, **values), data))

    if seen.get("lo") is not None:
        grain = choose_grain(int((seen["hi"] - seen["lo"]) // 86400))
        if seen[f"many_{grain}"]:
            add("trend", "trend", trend(df, profile, measure, grain), grain=fv.GRAIN_LABELS[grain])
    for i, d in enumerate(dimensions[:2]):
        if seen[f"d{i}"]:
            add("top", f"top_{d}", top_categories(df, profile, d, measure), dimension=d)
    # Estimates only rule columns out; the candidates are counted exactly.
    near = [d for i, d in enumerate(dimensions) if seen[f"u{i}"] <= 2 * fv.SHARE_MAX_GROUPS]
    counts = distinct_counts(df, near)
    chosen = next((d for d in near if 1 < counts[d] <= fv.SHARE_MAX_GROUPS), None)
    if chosen:
        positive = _grouped(df, profile, chosen, measure).filter("value > 0")
        if positive.count() >= 2:  # at most SHARE_MAX_GROUPS rows
            add("share", f"share_{chosen}", share(df, profile, chosen, measure), dimension=chosen)
    if profile.status_column and seen["statuses"]:
        add("status", "status", status_counts(df, profile), dimension=profile.status_column)
    several = seen["values"] >= 20 or (
        df.select(value.alias("v")).filter("v is not null").distinct().limit(5).count() >= 5)
    if several:
        add("distribution", "distribution", distribution(df, profile, measure))
    return out
