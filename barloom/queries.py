"""Imports every module that registers queries."""

from .plans import operator_queries  # noqa: F401
from .plans import feature_queries  # noqa: F401
from .plans import report_queries  # noqa: F401
from .plans import objective_queries  # noqa: F401
from .plans import candidate_queries  # noqa: F401
from .plans import record_queries  # noqa: F401
