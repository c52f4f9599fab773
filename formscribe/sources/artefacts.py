"""Stored artefacts: profiles, rules, clusters, vectors, models and review data."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formscribe.operators.profile import KEY
from formscribe.sources.json_ranges import read_members

BUCKETS = 64


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns become JSON text."""
    nested = ("array", "map", "struct")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_map(spark: SparkSession, path: str, entry: StructType) -> DataFrame:
    """Files that hold one object which maps composite keys to records, as one row per key; large files are read in
    ranges. For importing such files; tables written here have one record per line instead."""
    parsed = read_members(spark, path).select(F.col("name").alias(KEY), F.from_json("body", entry).alias("e"))
    return parsed.select(KEY, "e.*")


def write_keyed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by a hash bucket of the key. A look-up by key reads one bucket, and a key never
    needs a file name of its own."""
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))
    bucketed.write.mode(mode).partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def read_key(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of one key; the bucket filter prunes the other partitions."""
    bucket = F.pmod(F.xxhash64(F.lit(key)), F.lit(BUCKETS)).cast("int")
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(KEY) == key)).drop("bucket")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Was a table written to its end? A half-written folder has no success marker."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table at `path`, built and written first if it is not there in full."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_learning_data(items: DataFrame, decisions: DataFrame, path: str) -> None:
    write_json(items, f"{path}/review_items")
    write_json(decisions, f"{path}/review_decisions")


def import_learning_data(spark: SparkSession, path: str, items: StructType, decisions: StructType) -> tuple[DataFrame, DataFrame]:
    return read_json(spark, f"{path}/review_items", items), read_json(spark, f"{path}/review_decisions", decisions)


def save_index(index: DataFrame, centres: DataFrame, path: str) -> None:
    write_keyed(index, f"{path}/vectors")
    write_keyed(centres, f"{path}/centres")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_keyed(spark, f"{path}/vectors"), read_keyed(spark, f"{path}/centres")
