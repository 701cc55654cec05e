"""Queries over the driver's tables, each with the SQL that checks it."""

from hotspan.workload.registry import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]
