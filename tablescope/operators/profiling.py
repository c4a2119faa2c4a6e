"""Roles of columns, from their names and a few statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import fixed_values as fv
from tablescope.functions.numbers import plain_text, to_double
from tablescope.functions.text import contains_any, has_hint, needs_nfkc, normalize_text
from tablescope.operators.distinct import distinct_counts, quoted
from tablescope.plans.profile import ColumnProfile, Profile

# Up to so many spellings a row's status is looked up among them, which a scan can
# evaluate; beyond, it is tested for the words they were found by. Same rows.
LOOKED_UP = 1000
_SAMPLE_CHARS = 40


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def is_date(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def measure(df: DataFrame, name: str):
    """Column ``name`` as double, NULL where it is no number."""
    return to_double(quoted(name), df.schema[name].dataType)


def _role(name: str, data_type: T.DataType, rows: int, unique: int, mean_length: float):
    """(role, subtype, key of the reason)."""
    rows = max(rows, 1)
    if is_date(data_type):
        return "date", "", "date"
    if is_numeric(data_type):
        if has_hint(name, fv.PERCENT_HINTS):
            return "percent", "percent", "percent"
        if has_hint(name, fv.ID_HINTS) and unique > rows * 0.9:
            return "identifier", "id", "numeric_id"
        for hints, kind in ((fv.MONEY_HINTS, "money"), (fv.QUANTITY_HINTS, "quantity")):
            if has_hint(name, hints):
                return "measure", kind, kind
        return "measure", "generic", "generic"
    mostly_unique = unique > rows * 0.5
    if mostly_unique and has_hint(name, fv.ID_HINTS):
        return "identifier", "id", "text_id"
    if mostly_unique and mean_length > 25:
        return "text", "free_text", "free_text"
    meaning = next((m for m, hints in fv.TEXT_MEANINGS if has_hint(name, hints)), "")
    if unique <= max(50, rows * 0.2):
        return "category", meaning, "category"
    return "text", meaning or "free_text", "varied"


def column_statistics(df: DataFrame) -> dict[str, dict]:
    """Rows, filled, mean length, total of absolute values and a sample per column.

    Plain sums, extremes and counts in one job, plus exact distinct counts in
    another.
    """
    names = df.columns
    exprs = [F.count("*").alias("rows")]
    for i, field in enumerate(df.schema.fields):
        col = quoted(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            col = F.nanvl(col, F.lit(None))
        exprs.append(F.count(col).alias(f"filled{i}"))
        if is_numeric(field.dataType):
            exprs.append(F.sum(F.abs(to_double(col, field.dataType))).alias(f"total{i}"))
        elif not is_date(field.dataType):
            exprs.append(F.avg(F.length(col.cast("string"))).alias(f"length{i}"))
        plain = is_numeric(field.dataType) or is_date(field.dataType)
        shown = F.min(col if plain else F.substring(col.cast("string"), 1, _SAMPLE_CHARS))
        exprs.append(plain_text(shown, field.dataType if plain else T.StringType()).alias(f"sample{i}"))
    row = df.agg(*exprs).first().asDict()
    unique = distinct_counts(df, names)
    return {n: {
        "rows": row["rows"], "unique": unique[n], "filled": row[f"filled{i}"],
        "mean_length": row.get(f"length{i}") or 0.0, "abs_total": row.get(f"total{i}") or 0.0,
        "sample": (row[f"sample{i}"] or "")[:_SAMPLE_CHARS],
    } for i, n in enumerate(names)}


def _set_statuses(df: DataFrame, profile: Profile) -> None:
    """List the cancelled and pending status values, in both spellings."""
    status = quoted(profile.status_column).cast("string")
    # The maximum is the value itself; named anew, the tests below stay above the
    # grouping and see each spelling once.
    values = (df.select(status.alias("raw")).filter("raw is not null")
              .groupBy("raw").agg(F.max("raw").alias("value")))

    def spellings(unicode_forms: bool):
        normal = normalize_text(F.col("value"), unicode_forms)
        return (
            values.select(F.col("value").alias("raw"), normal.alias("normal"), needs_nfkc(F.col("value")).alias("odd"))
            .withColumn("negative", contains_any(F.col("normal"), fv.NEGATIVE_STATUS_WORDS))
            .withColumn("pending", contains_any(F.col("normal"), fv.PENDING_STATUS_WORDS))
            .filter(F.col("negative") | F.col("pending") | (F.lit(not unicode_forms) & F.col("odd")))
            .collect())

    # Distinct spellings only, all of them: the profile and the figures' wording name each.
    rows = spellings(False)
    if any(r.odd for r in rows):
        rows = spellings(True)
    for kind in ("negative", "pending"):
        found = sorted(r.raw for r in rows if r[kind])
        members = None if len(found) > LOOKED_UP else found
        profile.override(None, **{f"{kind}_statuses": sorted({r.normal for r in rows if r[kind]}),
                                  f"{kind}_members": members})


def profile_dataset(df: DataFrame, roles=None, **elected) -> Profile:
    """Infer the role of every column; ``roles`` and ``elected`` override the inference."""
    if not isinstance(df, DataFrame):
        raise ValueError(fv.ERRORS["not_a_dataframe"])
    profile = Profile()
    if not df.columns:
        return profile
    stats = column_statistics(df)
    for field in df.schema.fields:
        s = stats[field.name]
        role, subtype, reason = _role(field.name, field.dataType, s["rows"], s["unique"], s["mean_length"])
        profile.columns[field.name] = ColumnProfile(
            field.name, role, subtype, s["unique"], s["rows"] - s["filled"], fv.ROLE_REASONS[reason],
            s["sample"], s["filled"], s["abs_total"])
        profile.rows = s["rows"]
    profile.elect()
    profile.override(roles, **elected)
    if profile.status_column:
        _set_statuses(df, profile)
        profile.override(None, **elected)
    return profile


PROFILE_SCHEMA = ("column string, role string, subtype string, unique_values bigint, missing bigint, "
                  "reason string, sample string")


def profile_frame(df: DataFrame, profile: Profile) -> DataFrame:
    rows = [(c.name, c.role, c.subtype, c.unique_values, c.missing, c.reason, c.sample)
            for c in profile.columns.values()]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
