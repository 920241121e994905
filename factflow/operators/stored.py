"""Tables kept in buckets by their key, so that merging a run's rows into them does not shuffle them.

A table is a folder with one version after the other; each version is Parquet in a fixed
number of buckets by hash of the keys. A merge brings only the new rows into the same
buckets; bucket k of the old version meets bucket k of the new rows in one task, which
writes bucket k of the next version. The old version stays until it is dropped, so a merge
that is tried again reads the same and writes the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factflow.sources.folders import exists, removed


@dataclass(frozen=True)
class Stored:
    """``path`` must be shared by all executors; ``buckets`` belongs to the table as its schema does.

    Choose it by the size that the table will have (some 200 MB a bucket): it is part of
    the folder's name, and a table that is opened with another number is not found.
    """

    path: str
    schema: str
    keys: Sequence[str]
    buckets: int = 64

    def at(self, version: int) -> str:
        return f"{self.path}/v={version}/buckets-{self.buckets}"

    def _name(self, version: int) -> str:
        return "stored_" + hashlib.md5(self.at(version).encode()).hexdigest()

    def _keys(self) -> str:
        return ", ".join(f"`{k}`" for k in self.keys)

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """A version, known to the planner by its buckets; no rows for a negative one. A session that did not write it may read it.

        A version that is not there is an error: Spark would take it for an empty table.
        """
        if version < 0:
            return spark.createDataFrame([], self.schema)
        if not exists(spark, self.at(version)):
            raise FileNotFoundError(self.at(version))
        at = self.at(version).replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(version)} ({self.schema.replace(':', ' ')}) USING parquet CLUSTERED BY ({self._keys()}) SORTED BY ({self._keys()}) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return spark.table(self._name(version))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns that they have, keys in its types, in its buckets.

        Keys that are constants stay columns for the planner: one that it folded away would
        be missing from the partitioning, and the table would be shuffled after all.
        """
        kinds = {f.name: f.dataType for f in StructType.fromDDL(self.schema)}
        typed = [F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in self.keys else F.col(f"`{c}`") for c in rows.columns]
        opaque = rows.select(F.explode(F.array(F.struct(*typed))).alias("r")).select("r.*")
        return opaque.repartition(self.buckets, *[F.col(f"`{k}`") for k in self.keys])

    def write(self, rows: DataFrame, version: int) -> DataFrame:
        """Writes a version, over one of that number; rows that are not placed give more files, not other results."""
        spark = rows.sparkSession
        own = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema)])
        spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")  # of an earlier try: the data stay until they are replaced
        first, *more = self.keys
        own.write.mode("overwrite").format("parquet").bucketBy(self.buckets, first, *more).sortBy(first, *more).option("path", self.at(version)).saveAsTable(self._name(version))
        return self.read(spark, version)

    def change(self, spark: SparkSession, version: int, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Writes version + 1 as ``how`` makes it of this version and the new rows, joined by the table's keys."""
        return self.write(how(self.read(spark, version), self.placed(new)), version + 1)

    def drop(self, spark: SparkSession, version: int) -> None:
        """Deletes a version that no reader needs any more; a missing one is no error."""
        if version >= 0:
            spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")
            removed(spark, f"{self.path}/v={version}")
