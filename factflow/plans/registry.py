"""Where plans register: a name, a function of (spark, sf_dir), and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factflow.plans import fixtures
from factflow.plans.dialect import Check, Spark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MADE: dict[tuple, object] = {}


class Tables:
    """The given tables by attribute, derived ones by ``fx``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def fx(self, name: str) -> DataFrame:
        return self.spark.sql(getattr(fixtures, name)(Spark(self.sf_dir)))

    def once(self, name: str, make: Callable[[], object]) -> object:
        """What ``make`` writes, made once for these tables in this application."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _MADE:
            _MADE[key] = make()
        return _MADE[key]


def o(name: str) -> str:
    """A derived table for the checking SQL."""
    return f"({getattr(fixtures, name)(Check())})"


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
