"""Intermediate tables in the shared folder."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from formscribe.session import scratch_path

#: Spark's own setting that drops a query's shuffle files when the query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def early_cleanup(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give back their shuffle files at once; the session's setting is put back afterwards."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read back: what made it is not needed again, and executors
    that are lost later cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with early_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
