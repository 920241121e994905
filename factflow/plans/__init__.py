"""Registered plans: every operator over tables derived from the given ones, with the SQL that checks it."""

from factflow.plans import detection, scalars, sites, tables  # noqa: F401
from factflow.plans.registry import ORACLES, QUERIES  # noqa: F401
