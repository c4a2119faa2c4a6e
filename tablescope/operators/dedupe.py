"""Exact duplicate rows.

Whole rows are shuffled only where they may be duplicates: eight bytes per row
find the hashes that occur more than once, and just the rows behind those are
compared column by column. A hash collision costs a comparison, never a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.distinct import quoted
from tablescope.session import materialize

ROW_HASH = "__row_hash"


def _comparable(field: T.StructField) -> Column:
    """The column, and for maps, which have no equality, their sorted entries."""
    column = quoted(field.name)
    return F.array_sort(F.map_entries(column)) if isinstance(field.dataType, T.MapType) else column


def _hash(df: DataFrame) -> Column:
    return F.xxhash64(*[_comparable(f) for f in df.schema.fields])


def _distinct(df: DataFrame) -> DataFrame:
    """One row of each form; maps are compared by their entries."""
    maps = {f"__entries_{i}": _comparable(f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.MapType)}
    if not maps:
        return df.dropDuplicates()
    others = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return df.withColumns(maps).dropDuplicates([*others, *maps]).drop(*maps)


def with_row_hash(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW_HASH, _hash(df))


def _split(hashed: DataFrame) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(rows that are unique, distinct forms of the others, number of the others).

    The first two are None when nothing repeats. Both come from joins on the
    eight-byte hash, which Spark turns into broadcasts where the repeated hashes are few.
    """
    # Written out, since three jobs ask for it.
    repeated = materialize(
        hashed.groupBy(ROW_HASH).agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    found = repeated.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if not found["keys"]:
        return None, None, 0
    some = repeated.select(ROW_HASH)
    unique = hashed.join(some, ROW_HASH, "left_anti")
    others = hashed.join(some, ROW_HASH, "left_semi")
    columns = [quoted(c) for c in hashed.columns]
    return unique.select(*columns), _distinct(others.select(*columns)), found["rows"]


def remove_duplicates(df: DataFrame, count: bool = True) -> tuple[DataFrame, int]:
    """``df`` without exact copies of a row (NULL equals NULL), and how many went.

    The number is only worked out with ``count``, else it is -1.
    """
    given = ROW_HASH in df.columns
    hashed = df if given else with_row_hash(df)
    unique, others, rows = _split(hashed)
    if not rows:
        return df, 0
    if count:
        others = materialize(others, "repeated-rows")
    kept = unique.unionAll(others)
    return kept if given else kept.drop(ROW_HASH), rows - others.count() if count else -1


def drop_duplicates(df: DataFrame) -> DataFrame:
    return remove_duplicates(df, count=False)[0]


def count_duplicates(df: DataFrame) -> int:
    """Number of rows that :func:`drop_duplicates` would remove."""
    return remove_duplicates(df)[1]
