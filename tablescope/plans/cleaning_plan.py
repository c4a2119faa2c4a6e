"""What cleaning will do to each column, decided once and reusable."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import fixed_values as fv
from tablescope.functions.dates import date_in_tidy
from tablescope.functions.numbers import number_in_tidy
from tablescope.functions.text import empty_to_null, normalize_text
from tablescope.operators.distinct import quoted
from tablescope.operators.labels import replace_labels


@dataclass
class CleaningAction:
    """One decision, as the user sees it."""

    column: str
    action_code: str
    detail: str
    affected_rows: int = 0

    @property
    def action(self) -> str:
        return fv.ACTIONS[self.action_code][0]


@dataclass
class CleaningOptions:
    number_ratio: float = fv.NUMBER_RATIO
    date_ratio: float = fv.DATE_RATIO
    signed_thousands: bool = False
    decimal_style: str = "grouped"
    strict_days: bool = False
    # Which comes first in dates such as 1/2/2026: "month", "day", or what more of the
    # column's other dates say ("counts"; the month if that does not settle it).
    day_order: str = "month"
    # True: all label columns; a list: only these; False: none.
    merge_labels: bool | list[str] = True
    min_label_ratio: float = fv.LABEL_RATIO
    # Also merge identifiers, and labels that differ in their digits.
    literal_labels: bool = False
    typos: dict[str, str] = field(default_factory=lambda: dict(fv.LABEL_TYPOS))


@dataclass
class ColumnDecision:
    name: str
    source: int  # position in the raw table
    kind: str  # as_is | text | number | date
    unicode_forms: bool = False  # some rows need NFKC
    labels: dict[str, str] = field(default_factory=dict)
    nan_is_null: bool = False
    forms: list[str] = field(default_factory=list)  # those that the dates were seen in
    day_first: bool = False


@dataclass
class CleaningPlan:
    """Applies to any table with the same columns, batch or stream."""

    source_names: list[str]
    columns: list[ColumnDecision]
    options: CleaningOptions
    drop_null_rows: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> CleaningPlan:
        raw = json.loads(text)
        return cls(raw["source_names"], [ColumnDecision(**c) for c in raw["columns"]],
                   CleaningOptions(**raw["options"]), raw["drop_null_rows"])

    def apply(self, df: DataFrame) -> DataFrame:
        """The typed table: two projections without any shuffle."""
        if list(df.columns) != self.source_names:
            raise ValueError(f"the plan is for columns {self.source_names}")
        # By position, since raw names need not be unique.
        raw = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        types = [f.dataType for f in df.schema.fields]
        raw = raw.select(*[f"c{d.source}" for d in self.columns])
        if self.drop_null_rows and self.columns:
            raw = raw.na.drop("all")
        texts = [clean_input(F.col(f"c{d.source}"), types[d.source], d.unicode_forms).alias(d.name)
                 for d in self.columns]
        return raw.select(*texts).select(*[
            self._typed(quoted(d.name), d).alias(d.name) for d in self.columns])

    def _typed(self, col, decision: ColumnDecision):
        if decision.kind == "number":
            return number_in_tidy(col, self.options.signed_thousands, self.options.decimal_style)
        if decision.kind == "date":
            return date_in_tidy(col, self.options.strict_days, decision.day_first, decision.forms)
        if decision.kind == "text":
            out = replace_labels(col, decision.labels)
            return F.nullif(out, F.lit("nan")) if decision.nan_is_null else out
        return col


def clean_input(col, data_type: T.DataType, unicode_forms: bool):
    """Text normalised with blanks as NULL; NaN as NULL; other types untouched."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return empty_to_null(normalize_text(col, unicode_forms))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(data_type))
    return col
