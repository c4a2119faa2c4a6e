"""Structure of a table and the score of its quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions.numbers import SPACES, parse_number
from tablescope.operators.cleaning import CleaningResult, _is_text
from tablescope.operators.dedupe import count_duplicates
from tablescope.operators.distinct import long_form, quoted
from tablescope.operators.profiling import is_numeric, measure, profile_dataset
from tablescope.operators.quantiles import exact_quantiles
from tablescope.plans.profile import Profile

ISSUE_SCHEMA = "column string, issue_code string, issue string, severity string, description string, affected bigint"


@dataclass
class Issue:
    column: str
    code: str
    severity: str
    description: str
    affected: int = 0

    @property
    def issue(self) -> str:
        return fv.ISSUES[self.code][0]


@dataclass
class Quality:
    score: float
    issues: list[Issue]
    total_missing: int
    duplicate_rows: int
    high_severity: int
    medium_severity: int

    @property
    def band(self) -> str:
        return "good" if self.score >= 85 else "usable" if self.score >= 60 else "poor"

    def issues_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i.column, i.code, i.issue, i.severity, i.description, i.affected) for i in self.issues]
        return spark.createDataFrame(rows, ISSUE_SCHEMA)


def analyze_dataset(df: DataFrame, profile: Profile | None = None,
                    duplicate_rows: int | None = None) -> dict:
    """Structural description of a table."""
    if not isinstance(df, DataFrame):
        raise ValueError(fv.ERRORS["not_a_dataframe"])
    if not df.columns or df.isEmpty():
        raise ValueError(fv.ERRORS["empty"])
    profile = profile or profile_dataset(df)
    columns = profile.columns.values()
    missing = {c.name: c.missing for c in columns if c.missing}
    return {
        "rows": profile.rows,
        "columns": len(df.columns),
        "column_names": list(df.columns),
        "missing_values": missing,
        "total_missing": sum(missing.values()),
        "duplicate_rows": count_duplicates(df) if duplicate_rows is None else duplicate_rows,
        "data_types": dict(df.dtypes),
        "numeric_columns": profile.measure_columns + profile.percent_columns,
        "text_columns": profile.category_columns + profile.text_columns,
        "date_columns": profile.date_columns,
        "identifier_columns": profile.identifier_columns,
        "column_summary": [{
            "column": c.name, "role": fv.ROLE_LABELS[c.role],
            "meaning": fv.MEANING_LABELS.get(c.subtype, fv.NO_COLUMN),
            "unique_values": c.unique_values, "missing": c.missing, "sample": c.sample,
        } for c in columns],
        "profile": profile,
    }


SUMMARY_SCHEMA = ("column string, role string, meaning string, unique_values bigint, missing bigint, "
                  "sample string")


def column_summary_frame(spark: SparkSession, structure: dict) -> DataFrame:
    return spark.createDataFrame([tuple(c.values()) for c in structure["column_summary"]], SUMMARY_SCHEMA)


def outlier_fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Q1 - 3 IQR and Q3 + 3 IQR of columns whose quartiles differ."""
    quartiles = exact_quantiles(df, {c: measure(df, c) for c in columns},
                                {c: [0.25, 0.75] for c in columns})
    fences = {}
    for name, (q1, q3) in quartiles.items():
        if q1 is not None and q3 > q1:
            reach = fv.OUTLIER_IQR_FACTOR * (q3 - q1)
            fences[name] = (q1 - reach, q3 + reach)
    return fences


def value_checks(df: DataFrame, measures: list[str], percents: list[str]) -> DataFrame:
    """One row per column: ``column, filled, negative, outliers, invalid_percent``."""
    fences = outlier_fences(df, measures)
    parts = []
    for name in measures + percents:
        value = measure(df, name)
        low, high = fences.get(name, (None, None))
        outside = F.lit(0) if low is None else F.sum(F.when((value < low) | (value > high), 1).otherwise(0))
        is_measure = name in measures
        parts.append(F.struct(
            F.lit(name).alias("column"),
            F.count(value).alias("filled"),
            (F.count(F.when(value < 0, 1)) if is_measure else F.lit(0)).cast("bigint").alias("negative"),
            F.when(F.count(value) >= fv.OUTLIER_MIN_ROWS, outside).otherwise(0).cast("bigint").alias("outliers"),
            (F.lit(0) if is_measure else F.count(F.when((value < 0) | (value > 100), 1)))
            .cast("bigint").alias("invalid_percent")))
    schema = "column string, filled bigint, negative bigint, outliers bigint, invalid_percent bigint"
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    # Two-step, so that one array expression holds plain aggregate results.
    return df.agg(F.array(*parts).alias("checks")).select(F.inline("checks"))


def _mixed_numbers(raw: DataFrame, columns: list[str], **style) -> dict[str, list[str]]:
    """Examples of unreadable values for text columns that are mostly numbers, read in the given style.

    Columns go by their raw names; those that cleaning has renamed are not looked at.
    """
    if not columns:
        return {}
    exprs, failed = [], {}
    for i, name in enumerate(columns):
        text = quoted(name)
        filled = F.trim(text, F.lit(SPACES)) != ""
        number = parse_number(text, **style)
        exprs += [F.count(F.when(filled, 1)).alias(f"f{i}"),
                  F.count(F.when(filled, number)).alias(f"n{i}")]
        failed[name] = F.when(number.isNull(), text)
    row = raw.agg(*exprs).first()
    mixed = [n for i, n in enumerate(columns) if row[f"f{i}"] and 0.5 <= row[f"n{i}"] / row[f"f{i}"] < 1]
    if not mixed:
        return {}
    first = F.row_number().over(W.partitionBy("column").orderBy("value"))
    examples: dict[str, list[str]] = {}
    for r in (long_form(raw, {n: failed[n] for n in mixed}).groupBy("column", "value")
              .agg(F.lit(1).alias("one")).withColumn("rank", first).filter("rank <= 3")
              .orderBy("column", "rank").collect()):
        examples.setdefault(r["column"], []).append(r.value)
    return examples


def missing_severity(share: float) -> str:
    return fv.HIGH if share > 0.2 else fv.MEDIUM if share > 0.01 else fv.LOW


def assess_quality(raw: DataFrame, clean: DataFrame, cleaning: CleaningResult | None = None,
                   profile: Profile | None = None) -> Quality:
    """Score the data and list the problems found in the raw table."""
    profile = profile or profile_dataset(clean)
    raw_rows = max(cleaning.raw_rows if cleaning else raw.count(), 1)
    issues: list[Issue] = []

    def add(column, code, severity, affected=0, **values):
        text = fv.ISSUES[code][1]
        issues.append(Issue(column, code, severity, text.format(count=affected, **values), affected))

    for c in profile.columns.values():
        if c.missing:
            share = c.missing / raw_rows
            add(c.name, "missing", missing_severity(share), c.missing, share=share * 100)
    total_missing = sum(c.missing for c in profile.columns.values())

    duplicates = cleaning.duplicate_rows_removed if cleaning else count_duplicates(raw)
    if duplicates:
        add(fv.NO_COLUMN, "duplicate_rows", fv.HIGH, duplicates)
    if cleaning and cleaning.duplicate_id_rows:
        add(profile.order_id_column or fv.NO_ID_COLUMN, "duplicate_ids", fv.MEDIUM,
            cleaning.duplicate_id_rows)

    clean_types = {f.name: f.dataType for f in clean.schema.fields}
    repaired = [f.name for f in raw.schema.fields if _is_text(f.dataType)
                and f.name in clean_types and is_numeric(clean_types[f.name])]
    options = cleaning.plan.options if cleaning else None
    style = {k: getattr(options, k) for k in ("signed_thousands", "decimal_style")} if options else {}
    for name, examples in _mixed_numbers(raw, repaired, **style).items():
        add(name, "mixed_numbers", fv.MEDIUM, examples=examples)
    for name, values in (cleaning.rejected_values if cleaning else {}).items():
        add(name, "rejected", fv.HIGH, cleaning.rejected_counts.get(name, len(values)), examples=values[:3])

    checks = {r["column"]: r for r in
              value_checks(clean, profile.measure_columns, profile.percent_columns).collect()}
    for name in profile.measure_columns:
        found = checks[name]
        if found.negative:
            add(name, "negative", fv.HIGH, found.negative)
        if found.outliers and found.outliers / found.filled <= fv.OUTLIER_MAX_SHARE:
            add(name, "outlier", fv.MEDIUM, found.outliers)
    for name in profile.percent_columns:
        if checks[name].invalid_percent:
            add(name, "bad_percent", fv.HIGH, checks[name].invalid_percent)
    for c in profile.columns.values():
        if c.unique_values == 1:
            add(c.name, "constant", fv.LOW)

    high = sum(i.severity == fv.HIGH for i in issues)
    medium = sum(i.severity == fv.MEDIUM for i in issues)
    cells = max(profile.rows * len(profile.columns), 1)
    penalty = (min(total_missing / cells * 100, 25) + min(duplicates / raw_rows * 200, 20)
               + min(4 * high + 2 * medium, 35))
    return Quality(round(max(0.0, 100.0 - penalty), 1), issues, total_missing, duplicates, high, medium)
