"""From a raw table to everything a dashboard needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablescope import fixed_values as fv
from tablescope.operators.cleaning import CleaningResult, clean_dataset
from tablescope.operators.profiling import profile_dataset
from tablescope.operators.quality import Quality, analyze_dataset, assess_quality
from tablescope.plans.cleaning_plan import CleaningOptions
from tablescope.plans.profile import Profile


@dataclass
class AnalysisBundle:
    raw_data: DataFrame
    data: DataFrame
    cleaning: CleaningResult
    profile: Profile
    structure: dict
    quality: Quality


def build_analysis(raw: DataFrame, options: CleaningOptions | None = None,
                   roles=None, store: bool = True, **elected) -> AnalysisBundle:
    """Clean, profile, describe and score a table.

    The cleaned table is written once to the shared folder (``store``), since
    every later question reads it again; the raw table is left as it is.
    """
    if not isinstance(raw, DataFrame):
        raise ValueError(fv.ERRORS["not_a_dataframe"])
    if not raw.columns or raw.isEmpty():
        raise ValueError(fv.ERRORS["empty"])
    cleaning = clean_dataset(raw, options, store=store)
    profile = profile_dataset(cleaning.data, roles, **elected)
    # Exact duplicates are gone by now.
    structure = analyze_dataset(cleaning.data, profile, duplicate_rows=0)
    quality = assess_quality(raw, cleaning.data, cleaning, profile)
    return AnalysisBundle(raw, cleaning.data, cleaning, profile, structure, quality)
