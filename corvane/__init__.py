"""Document stores with relationship indexes on PySpark."""

from .context import Context
from .operators.filters import Comparison, InverseMatch, Match, comparison_with_range, greater_than, greater_than_or_equal_to, in_range, less_than, less_than_or_equal_to
from .plans.compile import Options, Plan
from .spec import RelationshipSpec
from .store import Reader, Store, StoreOptions

__all__ = [
    "Comparison", "Context", "InverseMatch", "Match", "Options", "Plan", "Reader", "RelationshipSpec", "Store", "StoreOptions", "comparison_with_range",
    "greater_than", "greater_than_or_equal_to", "in_range", "less_than", "less_than_or_equal_to",
]
