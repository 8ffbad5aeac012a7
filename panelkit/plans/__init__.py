"""Query plans bound to the driver tables (the registered t2 queries)."""

from panelkit.plans import q_agg, q_closed, q_io, q_join, q_ml, q_models, q_null, q_prep, q_sample  # noqa: F401
from panelkit.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
