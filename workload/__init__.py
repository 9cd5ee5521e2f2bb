"""Queries over the given tables, each with the SQL that states its result."""

from workload import closedform, edges, forecasting, pipelines, preparation, profiling, quantiles, sources  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
