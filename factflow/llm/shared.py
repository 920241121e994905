"""Tables cut loose from their lineage, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.sources.folders import shared_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: recovery needs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of at most ``BATCH_BYTES``, for long texts would else fill two workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def renamed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so extra columns cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
