"""A cleaning plan decided on a batch also cleans the rows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablescope.plans.cleaning_plan import CleaningPlan


def clean_stream(stream: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Type and normalise streamed rows; needs no state, so no watermark either."""
    return plan.apply(stream)
