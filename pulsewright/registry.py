"""Names, DataFrame builders and reference SQL of every registered query."""

from pulsewright.plans import queries_bins, queries_cuts, queries_jobs, queries_noise, queries_params, queries_stats, queries_text  # noqa: F401
from pulsewright.plans.registration import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
