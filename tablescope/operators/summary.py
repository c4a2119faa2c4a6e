"""Summaries of deliveries that can be stored and merged.

The state of a table is how often each value of each column occurs; that of a rollup is
count, sum and extremes of each group. Both merge by adding, so what old and new
deliveries say together follows from their states alone and equals a run over all rows:
counts, distinct values, extremes and quantiles exactly, sums but for the order of adding.
Groupings combine before the shuffle, so a value that a third of all rows have is
one row for each task; a column without repeats has a state of its own length, in which
long texts are digests.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.distinct import long_text, quoted
from tablescope.operators.quantiles import exact_quantiles

STATE = "column string, label string, number double, rows bigint"
QUARTILES = (0.25, 0.5, 0.75)
#: Bytes of a file that a task combines at most, as far as the file's row groups let it.
SCAN_BYTES = 16 << 20


def _number(col: Column, kind: T.DataType) -> Column:
    """What is ranked and added up: dates as days and times as seconds since 1970, nothing for texts."""
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")) / 1e6
    if isinstance(kind, T.NumericType):
        return col.cast("double")
    return F.lit(None).cast("double")


def _label(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        col = F.nanvl(col, F.lit(None).cast(kind)) + F.lit(0.0).cast(kind)  # no NaN, no -0.0
    if isinstance(kind, T.BinaryType):
        return long_text(F.base64(col))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return long_text(F.to_json(F.array(col)))
    return long_text(col.cast("string"))


def summarise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, label, number, rows: how often each value occurs; missing values, NaN among them, have a null label."""
    pairs = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType
        label = _label(quoted(name), kind)
        pairs.append(F.struct(F.lit(name).alias("column"), label.alias("label"),
                              F.when(label.isNotNull(), _number(quoted(name), kind)).alias("number")))
    if not pairs:
        return df.sparkSession.createDataFrame([], STATE)
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "label").agg(
        F.max("number").alias("number"), F.count("*").alias("rows"))


def merge(states: DataFrame) -> DataFrame:
    """One state of several, given as rows of one frame."""
    return states.groupBy("column", "label").agg(F.max("number").alias("number"), F.sum("rows").alias("rows"))


def describe(state: DataFrame) -> DataFrame:
    """column, rows, missing, distinct, total, low, high, q1, median and q3, from a merged state; ordered by column."""
    known = F.col("label").isNotNull()
    facts = state.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0).cast("bigint")).alias("missing"),
        F.count("label").alias("distinct"), F.sum(F.col("number") * F.col("rows")).alias("total"),
        F.min("number").alias("low"), F.max("number").alias("high")).orderBy("column").collect()  # a row for each column
    ranked = {r["column"]: F.when(F.col("column") == r["column"], F.col("number")) for r in facts if r["low"] is not None}
    quartiles = exact_quantiles(state, ranked, {n: QUARTILES for n in ranked}, F.col("rows"))
    return state.sparkSession.createDataFrame(
        [(*r, *quartiles.get(r["column"], [None] * 3)) for r in facts],
        "column string, rows bigint, missing bigint, distinct bigint, total double, low double, high double, "
        "q1 double, median double, q3 double")


def group_states(df: DataFrame, keys: Mapping[str, Column], measure: Column) -> DataFrame:
    """The keys, and rows, known, total, low and high of ``measure`` for each group."""
    picked = df.select(*[c.alias(n) for n, c in keys.items()], measure.alias("measure"))
    return picked.groupBy(*[quoted(n) for n in keys]).agg(
        F.count("*").alias("rows"), F.count("measure").alias("known"), F.sum("measure").alias("total"),
        F.min("measure").alias("low"), F.max("measure").alias("high"))


def merge_groups(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.groupBy(*[quoted(n) for n in keys]).agg(
        F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"))


@contextmanager
def _small_parts(spark: SparkSession):
    """Jobs run meanwhile read files in parts of SCAN_BYTES: what a task reads it also holds, if nothing repeats."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > SCAN_BYTES:
        spark.conf.set(key, str(SCAN_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class SummaryStore:
    """States of deliveries in a shared folder, one subfolder for each.

    Only a delivery that is added is read; adding one of the same name replaces it. A
    delivery counts once its files are whole, so a job that dies while it writes adds nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: Sequence[str] | None = None):
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), columns
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _place(self, delivery: str) -> str:
        if not re.fullmatch(r"[\w-]+", delivery):
            raise ValueError(f"a delivery's name is letters, digits, _ and -: {delivery!r}")
        return f"{self.folder}/{delivery}"

    def add(self, delivery: str, df: DataFrame) -> None:
        with _small_parts(self.spark):
            (summarise(df, self.columns).write.mode("overwrite").option("parquet.block.size", SCAN_BYTES)
             .parquet(self._place(delivery)))

    def drop(self, delivery: str) -> None:
        self._files.delete(self._path(self._place(delivery)), True)

    def deliveries(self) -> list[str]:
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder)) if s.isDirectory()]
        return sorted(n for n in names if self._files.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def state(self) -> DataFrame:
        """The state of all deliveries together; needs none of their rows."""
        whole = [f"{self.folder}/{n}" for n in self.deliveries()]
        if not whole:
            return self.spark.createDataFrame([], STATE)
        return merge(self.spark.read.schema(STATE).parquet(*whole))

    def describe(self) -> DataFrame:
        with _small_parts(self.spark):
            return describe(self.state())
