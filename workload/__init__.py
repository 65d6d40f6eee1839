"""The engine bound to the driver's tables: one query and one SQL twin each."""

from workload import filters, log, measures, proposals, reports, results, samples, scalars, scans, signals  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
