"""Feature preparation, KPI prediction and what-if analysis on Spark DataFrames."""

from loomwright.plans.operator import Chain, Operator

__all__ = ["Chain", "Operator"]
