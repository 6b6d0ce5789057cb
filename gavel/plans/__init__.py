"""Query catalogue: named Spark plans over the given tables, each with an
independent DuckDB oracle where SQL can express it."""

from gavel.plans import q_clean, q_eval, q_fair, q_gov, q_io, q_model, q_plan, q_profile, q_stream  # noqa: F401  (registers queries)
from gavel.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
