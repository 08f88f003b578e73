"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from cohortline.workload import grouping, people, preparation, risk, scalars, terms
from cohortline.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "grouping", "people", "preparation", "risk", "scalars", "terms"]
