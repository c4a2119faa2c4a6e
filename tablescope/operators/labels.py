"""Near-duplicate labels: merge a label into a more frequent one spelled much alike."""

from __future__ import annotations

import re
from collections.abc import Mapping
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.operators.distinct import label_counts

_BLANK = ("", "nan", "None", "NaN")


def _alike(label: str, other: str, min_ratio: float, literal: bool) -> bool:
    if not literal and re.findall(r"\d+", label) != re.findall(r"\d+", other):
        return False  # "30 days" is not "60 days"
    matcher = SequenceMatcher(None, label, other)
    # Both quick forms are upper bounds of the ratio.
    return (matcher.real_quick_ratio() >= min_ratio and matcher.quick_ratio() >= min_ratio
            and matcher.ratio() >= min_ratio)


def merge_map(counts: Mapping[str, int], typos: Mapping[str, str] = fv.LABEL_TYPOS,
              min_ratio: float = fv.LABEL_RATIO, literal: bool = False) -> dict[str, str]:
    """Which label becomes which, given how often each occurs.

    Labels are visited by falling frequency (ties by spelling). One that looks
    like a label already kept is merged into it, otherwise it is kept.
    """
    mapping = {wrong: typos[wrong] for wrong in counts if wrong in typos}
    repaired: dict[str, int] = {}
    for label, rows in counts.items():
        target = mapping.get(label, label)
        repaired[target] = repaired.get(target, 0) + rows
    targets = set(mapping.values())
    kept: list[str] = []
    for label in sorted(repaired, key=lambda k: (-repaired[k], k)):
        if label in _BLANK:
            continue
        like = None if label in targets else next(
            (other for other in kept if _alike(label, other, min_ratio, literal)), None)
        if like is None:
            kept.append(label)
        else:
            mapping[label] = like
    return mapping


def collect_labels(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, dict[str, int]]:
    """Label counts per column; the caller has made sure that labels are few."""
    found: dict[str, dict[str, int]] = {name: {} for name in columns}
    if columns:
        for row in label_counts(df, columns).collect():
            found[row["column"]][row.value] = row.rows
    return found


def replace_labels(col: Column, mapping: Mapping[str, str]) -> Column:
    """Native lookup in a literal map; labels outside the map stay."""
    if not mapping:
        return col
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)
