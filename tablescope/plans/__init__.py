"""Small serialisable decisions: how to clean a table, what its columns mean."""

from tablescope.plans.cleaning_plan import CleaningAction, CleaningOptions, CleaningPlan, ColumnDecision
from tablescope.plans.profile import ColumnProfile, Profile

__all__ = ["CleaningAction", "CleaningOptions", "CleaningPlan", "ColumnDecision",
           "ColumnProfile", "Profile"]
