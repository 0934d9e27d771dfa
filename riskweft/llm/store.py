"""Tables written once to the shared checkpoint folder, and the columns an operator needs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweft.session import use_checkpoints


#: Bytes of a batch that a Python task is given; it holds a few copies of one at a time.
BATCH_BYTES = "4m"
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hand Python tasks batches of few bytes: a number of rows alone does not bound long texts.

    A session that already has a smaller bound keeps it.
    """
    if spark.conf.get(_BATCHES, "64m").lower() in ("67108864b", "64m", "64mb", "9223372036854775807b"):
        spark.conf.set(_BATCHES, BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again.

    The lineage is cut, and the files outlive any executor.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    bound_batches(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
