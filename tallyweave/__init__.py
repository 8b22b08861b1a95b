"""tallyweave: document analytics over report text, as DataFrame operators for Spark."""

from .operators.pipeline import Run, Settings, extract, extract_whole, run_stages
from .sources.profiles import list_profiles, load_profile

__all__ = ["Run", "Settings", "extract", "extract_whole", "list_profiles", "load_profile", "run_stages"]
