"""Cleaning: look at the data once, decide, then apply the decisions as columns."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import fixed_values as fv
from tablescope.functions.dates import AMBIGUOUS, FORMS, date_and_form, has_date_name
from tablescope.functions.numbers import number_in_tidy
from tablescope.functions.text import (
    compatible_forms, empty_to_null, has_hint, let, needs_nfkc, normalize_column_name, normalize_text,
)
from tablescope.operators import dedupe
from tablescope.operators.distinct import distinct_counts, long_form, quoted
from tablescope.operators.labels import collect_labels, merge_map
from tablescope.plans.cleaning_plan import (
    CleaningAction, CleaningOptions, CleaningPlan, ColumnDecision, clean_input,
)
from tablescope.session import materialize

# Text columns per statistics job.
_CHUNK = 50
# Partial statistics are first merged by this many tasks, then by one.
_MERGERS = 64

AUDIT_SCHEMA = "column string, action_code string, action string, detail string, affected_rows bigint"
REJECTED_SCHEMA = "column string, value string, rank int, distinct_rejected bigint"


@dataclass
class _TextStats:
    filled: int = 0
    changed: int = 0
    odd: int = 0  # rows that need NFKC
    numbers: int = 0
    dates: int = 0
    labels: int = 0  # estimated distinct values
    forms: int = 0  # a bit for each form of a date
    month_first: int = 0  # dates that have only one order, and which
    day_first: int = 0


@dataclass
class _TableStats:
    rows: int = 0
    null_rows: int = 0
    present: list[int] = field(default_factory=list)
    text: dict[int, _TextStats] = field(default_factory=dict)


@dataclass
class CleaningResult:
    data: DataFrame
    plan: CleaningPlan
    actions: list[CleaningAction]
    rejected_values: dict[str, list[str]]
    rejected_counts: dict[str, int]
    duplicate_rows_removed: int
    duplicate_id_rows: int
    raw_rows: int
    stats: _TableStats

    def actions_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a.column, a.action_code, a.action, a.detail, a.affected_rows) for a in self.actions]
        return spark.createDataFrame(rows, AUDIT_SCHEMA)

    def rejected_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, v, i, self.rejected_counts[c])
                for c, values in self.rejected_values.items() for i, v in enumerate(values, 1)]
        return spark.createDataFrame(rows, REJECTED_SCHEMA)


def _is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def clean_names(names: list[str]) -> list[str]:
    """Normalised column names, numbered where several come out alike."""
    wanted = [normalize_column_name(n) or str(n) for n in names]
    taken, out = set(wanted), []
    for name in wanted:
        unique, i = name, 0
        while unique in out or (i and unique in taken):
            i += 1
            unique = f"{name}_{i}"
        out.append(unique)
    return out


# --- statistics -------------------------------------------------------------

def _two_step(df: DataFrame, conditions: dict[str, str], sketched: dict[str, str], bits: dict[str, str]):
    """Rows per condition, estimated distinct values and united bits, all given as SQL.

    Merged by many tasks before the last one, which would otherwise receive the
    sketches of every task of the scan.
    """
    merger = F.pmod(F.spark_partition_id(), F.lit(_MERGERS)).alias("merger")
    partial = df.groupBy(merger).agg(
        *[F.expr(f"count_if({c}) as {n}") for n, c in conditions.items()],
        *[F.expr(f"hll_sketch_agg({c}, 12) as {n}") for n, c in sketched.items()],
        *[F.expr(f"bit_or({c}) as {n}") for n, c in bits.items()])
    return partial.agg(
        *[F.expr(f"coalesce(sum({n}), 0) as {n}") for n in conditions],
        *[F.expr(f"hll_sketch_estimate(hll_union_agg({n})) as {n}") for n in sketched],
        *[F.expr(f"bit_or({n}) as {n}") for n in bits]).first()


def _text_stats(raw: DataFrame, positions: list[int], unicode_forms: bool, options: CleaningOptions,
                extra: dict) -> tuple[dict[int, _TextStats], object]:
    """Statistics of normalised text columns, and of ``extra`` sums, in one job."""
    forms = {i: compatible_forms(F.col(f"c{i}")) if unicode_forms else F.col(f"c{i}") for i in positions}
    cells = F.array(*[F.struct(F.col(f"c{i}").cast("string").alias("old"), forms[i].alias("text"))
                      for i in positions])

    def look(cell):
        def judge(new):
            return let(date_and_form(new, options.strict_days, options.day_order == "day"), lambda date: F.struct(
                new.alias("new"),
                (F.coalesce(cell["old"], F.lit("")) != F.coalesce(new, F.lit(""))).alias("changed"),
                needs_nfkc(cell["old"]).alias("odd"),
                number_in_tidy(new, options.signed_thousands, options.decimal_style).isNotNull().alias("number"),
                F.when(date["value"].isNotNull(), date["form"]).alias("form")))
        return let(empty_to_null(normalize_text(cell["text"], False)), judge)

    # One expression for the cells of all columns, so the plan stays small
    # however many columns there are.
    table = raw.withColumn("cells", cells)
    if positions:
        table = table.withColumn("seen", F.transform("cells", look))
    sums = dict(extra)
    for k, i in enumerate(positions):
        sums[f"filled{i}"] = f"seen[{k}].new is not null"
        sums[f"changed{i}"] = f"seen[{k}].changed"
        sums[f"odd{i}"] = f"seen[{k}].odd"
        sums[f"numbers{i}"] = f"seen[{k}].number"
        sums[f"dates{i}"] = f"seen[{k}].form is not null"
        for order in ("month_first", "day_first"):
            sums[f"{order}{i}"] = f"seen[{k}].form = {FORMS.index(order)}"
    row = _two_step(table, sums, {f"labels{i}": f"seen[{k}].new" for k, i in enumerate(positions)},
                    {f"forms{i}": f"shiftleft(1, seen[{k}].form)" for k, i in enumerate(positions)})
    fields = [f.name for f in dataclasses.fields(_TextStats)]
    return {i: _TextStats(**{f: int(row[f"{f}{i}"] or 0) for f in fields}) for i in positions}, row


def _table_stats(df: DataFrame, options: CleaningOptions) -> _TableStats:
    count = len(df.columns)
    raw = df.toDF(*[f"c{i}" for i in range(count)])
    texts = [i for i, f in enumerate(df.schema.fields) if _is_text(f.dataType)]

    def missing(i):
        if isinstance(df.schema.fields[i].dataType, (T.FloatType, T.DoubleType)):
            return f"(c{i} is null or isnan(c{i}))"
        return f"c{i} is null"

    extra = {f"present{i}": f"not {missing(i)}" for i in range(count)}
    extra["rows"] = "true"
    extra["null_rows"] = " and ".join(missing(i) for i in range(count))

    stats = _TableStats()
    for start in range(0, max(len(texts), 1), _CHUNK):
        found, row = _text_stats(raw, texts[start:start + _CHUNK], False, options,
                                 extra if start == 0 else {})
        stats.text.update(found)
        if start == 0:
            stats.rows, stats.null_rows = int(row["rows"]), int(row["null_rows"])
            stats.present = [int(row[f"present{i}"]) for i in range(count)]
    # Only columns with compatibility forms are looked at again, with NFKC.
    odd = [i for i in texts if stats.text[i].odd]
    for start in range(0, len(odd), _CHUNK):
        some = odd[start:start + _CHUNK]
        stats.text.update(_text_stats(raw.select(*[f"c{i}" for i in some]), some, True, options, {})[0])
    return stats


# --- decisions --------------------------------------------------------------

def _looks_like_date(name: str, stats: _TextStats) -> bool:
    return has_date_name(name) or (
        stats.filled > 0 and stats.dates / stats.filled >= fv.DATE_LIKE_RATIO)


def _kind(name: str, stats: _TextStats, options: CleaningOptions) -> str:
    if not stats.filled:
        return "text"
    if _looks_like_date(name, stats):
        return "date" if stats.dates / stats.filled >= options.date_ratio else "text"
    return "number" if stats.numbers / stats.filled >= options.number_ratio else "text"


def _normalized(df: DataFrame, plan: CleaningPlan, decisions: list[ColumnDecision]) -> DataFrame:
    """The text of some columns after normalisation, under their final names."""
    raw = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return raw.select(*[clean_input(F.col(f"c{d.source}"), T.StringType(), d.unicode_forms).alias(d.name)
                        for d in decisions])


def _rejected(df: DataFrame, plan: CleaningPlan, decisions: list[ColumnDecision]):
    """Values that failed to convert: the first ones by spelling, and how many."""
    if not decisions:
        return {}, {}
    texts = _normalized(df, plan, decisions)
    failed = {d.name: F.when(plan._typed(quoted(d.name), d).isNull(), quoted(d.name)) for d in decisions}
    values = long_form(texts, failed).groupBy("column", "value").agg(F.lit(1).alias("one"))
    first = F.row_number().over(W.partitionBy("column").orderBy("value"))
    kept: dict[str, list[str]] = {d.name: [] for d in decisions}
    for row in (values.withColumn("rank", first).filter(F.col("rank") <= fv.REJECTED_KEPT)
                .select("column", "value", "rank").orderBy("column", "rank").collect()):
        kept[row["column"]].append(row.value)
    counts = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}
    return kept, counts


def compile_plan(df: DataFrame, options: CleaningOptions | None = None):
    """Decide how to clean ``df``: ``(plan, actions, rejected, rejected_counts, stats)``.

    Only counts, at most 20 rejected values and at most 200 labels per column
    come back to the driver.
    """
    if not isinstance(df, DataFrame):
        raise ValueError(fv.ERRORS["not_a_dataframe"])
    options = options or CleaningOptions()
    if options.day_order not in ("month", "day", "counts"):
        raise ValueError("day_order must be month, day or counts")
    old_names = list(df.columns)
    if not old_names:
        return CleaningPlan([], [], options), [], {}, {}, _TableStats()
    names = clean_names(old_names)
    stats = _table_stats(df, options)
    actions: list[CleaningAction] = []

    def act(column, code, affected, detail=None, **values):
        text = fv.ACTIONS[code][1] if detail is None else detail
        actions.append(CleaningAction(column, code, text.format(**values) if values else text, affected))

    renamed = [o for o in old_names if normalize_column_name(o) not in ("", str(o))]
    if renamed:
        act(fv.LIST_COMMA.join(renamed), "rename", len(renamed))

    empty = [i for i in range(len(names)) if not stats.present[i]]
    if empty:
        act(fv.LIST_COMMA.join(names[i] for i in empty), "drop_column", len(empty))
    if stats.null_rows:
        act(fv.NO_COLUMN, "drop_row", stats.null_rows)

    plan = CleaningPlan(old_names, [], options, drop_null_rows=stats.null_rows > 0)
    for i, name in enumerate(names):
        if i in empty:
            continue
        text = stats.text.get(i)
        kind = "as_is" if text is None else _kind(name, text, options)
        decision = ColumnDecision(name, i, kind, unicode_forms=bool(text and text.odd))
        plan.columns.append(decision)
        if text and text.changed:
            act(name, "text", text.changed)
        if kind == "date":
            decision.forms = [f for k, f in enumerate(FORMS) if text.forms >> k & 1]
            decision.day_first = options.day_order == "day" or (
                options.day_order == "counts" and text.day_first > text.month_first)
            if options.day_order == "counts" and AMBIGUOUS in decision.forms:
                act(name, "date_order", text.dates, day=text.day_first, month=text.month_first,
                    order=fv.DATE_ORDERS[decision.day_first])

    def passed(d: ColumnDecision) -> int:
        text = stats.text[d.source]
        return text.numbers if d.kind == "number" else text.dates

    converted = [d for d in plan.columns if d.kind in ("number", "date")]
    rejected, rejected_counts = _rejected(
        df, plan, [d for d in converted if passed(d) < stats.text[d.source].filled])
    for kind, code, note in (("number", "to_number", fv.REJECTED_NUMBERS),
                             ("date", "to_date", fv.REJECTED_DATES)):
        for d in converted:
            if d.kind == kind:
                failures = rejected_counts.get(d.name, 0)
                detail = fv.ACTIONS[code][1] + (note.format(count=failures) if failures else "")
                act(d.name, code, passed(d), detail)

    _decide_labels(df, plan, stats, act)
    return plan, actions, rejected, rejected_counts, stats


def _decide_labels(df: DataFrame, plan: CleaningPlan, stats: _TableStats, act) -> None:
    options = plan.options
    texts = [d for d in plan.columns if d.kind == "text" and stats.text[d.source].filled]
    if options.merge_labels is False:
        return
    if isinstance(options.merge_labels, (list, tuple)):
        texts = [d for d in texts if d.name in options.merge_labels]
    # The sketch is exact for counts this small; the labels themselves settle it.
    few = [d for d in texts if stats.text[d.source].labels <= 2 * fv.LABEL_CAP]
    many = [d for d in texts if d not in few]
    counts = collect_labels(_normalized(df, plan, few), {d.name: quoted(d.name) for d in few})
    rows = stats.rows - stats.null_rows
    for d in few:
        found = counts[d.name]
        if not options.literal_labels and (
                has_hint(d.name, fv.ID_HINTS) and len(found) > 0.5 * rows):
            continue  # an identifier
        repaired = {options.typos.get(label, label) for label in found}
        if len(repaired) > fv.LABEL_CAP:
            many.append(d)
            continue
        d.labels = merge_map(found, options.typos, options.min_label_ratio, options.literal_labels)
        d.nan_is_null = "nan" in found
        affected = sum(found.get(label, 0) for label in d.labels)
        if affected:
            pairs = ", ".join(fv.MERGE_PAIR.format(wrong=w, right=r) for w, r in d.labels.items())
            act(d.name, "merge", affected, pairs=pairs)
    if many and options.typos:
        known = {d.name: F.when(quoted(d.name).isin(list(options.typos)), quoted(d.name)) for d in many}
        counts = collect_labels(_normalized(df, plan, many), known)
        for d in many:
            found = counts[d.name]
            d.labels = {w: r for w, r in options.typos.items() if w in found}
            if found:
                pairs = ", ".join(fv.MERGE_PAIR.format(wrong=w, right=r) for w, r in d.labels.items())
                act(d.name, "merge", sum(found.values()), pairs=pairs)


# --- the whole step ---------------------------------------------------------

def is_id_name(name: str) -> bool:
    lowered = str(name).lower()
    return lowered.endswith("_id") or lowered in fv.DUPLICATE_ID_NAMES


def duplicate_ids(df: DataFrame, columns=None) -> dict[str, int]:
    """Surplus non-null values of identifier-named columns; nothing is removed."""
    names = [c for c in df.columns if is_id_name(c)] if columns is None else list(columns)
    if not names:
        return {}
    filled = df.agg(*[F.count(quoted(n)).alias(f"f{i}") for i, n in enumerate(names)]).first()
    unique = distinct_counts(df, names)
    return {n: filled[i] - unique[n] for i, n in enumerate(names)}


def clean_dataset(df: DataFrame, options: CleaningOptions | None = None,
                  store: bool = False) -> CleaningResult:
    """Typed, normalised copy of ``df`` plus the decisions taken.

    With ``store`` the typed table is written once to the shared folder; what
    follows then reads only the columns it needs.
    """
    plan, actions, rejected, rejected_counts, stats = compile_plan(df, options)
    data = plan.apply(df)
    removed = 0
    if plan.columns:
        hashed = dedupe.with_row_hash(data)
        if store:
            hashed = materialize(hashed, "typed")
        hashed, removed = dedupe.remove_duplicates(hashed)
        if removed:
            if store:
                hashed = materialize(hashed, "clean")
            actions.append(CleaningAction(fv.NO_COLUMN, "drop_duplicate",
                                          fv.ACTIONS["drop_duplicate"][1], removed))
        data = hashed.drop(dedupe.ROW_HASH)
    repeated = {n: c for n, c in duplicate_ids(data).items() if c}
    for name, surplus in repeated.items():
        actions.append(CleaningAction(name, "duplicate_id", fv.ACTIONS["duplicate_id"][1], surplus))
    return CleaningResult(data, plan, actions, rejected, rejected_counts, removed,
                          sum(repeated.values()), stats.rows, stats)
