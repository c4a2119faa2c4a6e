"""Writing cleaned rows and the cleaning report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablescope.functions.numbers import plain_text
from tablescope.operators.cleaning import CleaningResult
from tablescope.operators.distinct import quoted

_REALS = (T.FloatType, T.DoubleType)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of UTF-8 CSV files with headers, written by all tasks; doubles without exponents where they fit."""
    df = df.select(*[plain_text(quoted(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, _REALS)
                     else quoted(f.name) for f in df.schema.fields])
    df.write.csv(path, header=True, quote='"', escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_report(result: CleaningResult, path: str) -> None:
    """The audit, some tens of rows, as one CSV file."""
    result.actions_frame(result.data.sparkSession).coalesce(1).write.csv(path, header=True, escape='"')
