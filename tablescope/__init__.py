"""Turn an untidy business table of any size into decision-ready results."""

from tablescope.operators.cleaning import CleaningResult, clean_dataset, compile_plan
from tablescope.operators.insights import generate_insights
from tablescope.operators.kpis import calculate_kpis
from tablescope.operators.profiling import profile_dataset
from tablescope.operators.quality import analyze_dataset, assess_quality
from tablescope.operators.rollups import create_charts
from tablescope.pipeline import AnalysisBundle, build_analysis
from tablescope.plans import CleaningAction, CleaningOptions, CleaningPlan, ColumnProfile, Profile
from tablescope.session import configure
from tablescope.sources import load, load_file
from tablescope.store import AnalysisStore

__all__ = [
    "AnalysisBundle", "AnalysisStore", "CleaningAction", "CleaningOptions", "CleaningPlan", "CleaningResult",
    "ColumnProfile", "Profile", "analyze_dataset", "assess_quality", "build_analysis",
    "calculate_kpis", "clean_dataset", "compile_plan", "configure", "create_charts",
    "generate_insights", "load", "load_file", "profile_dataset",
]
