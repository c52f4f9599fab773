"""Ranked selections inside groups that stay cheap when one group holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formscribe.session import cut_lineage

#: Spark prunes `row_number() <= k` before the shuffle up to this k (its default group-limit threshold).
PRUNED_BEFORE_SHUFFLE = 1000
_SALTS = 64


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of each group with their 1-based rank.

    Up to 1000 rows Spark limits each map partition first. Larger k take a salted first round, so that no
    task ever sorts a whole group.
    """
    if k > PRUNED_BEFORE_SHUFFLE:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if not _nested(df, c)]), F.lit(_SALTS))
        salted = df.withColumn("_salt", salt)
        first = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_first", F.row_number().over(first)).where(F.col("_first") <= k)
        df = df.drop("_salt", "_first")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _nested(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("array", "map", "struct")


def most_common(df: DataFrame, keys: Sequence[str], item: str, weight: Column, name: str) -> DataFrame:
    """Mode per group: highest weight, ties to the smallest item. Counts are summed before ranking."""
    counted = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.sum(weight).alias("_w"))
    best = F.min(F.struct((-F.col("_w")).alias("w"), F.col(item).alias("item")))
    return counted.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.item").alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], column: str, name: str = "median") -> DataFrame:
    """Exact median per group without holding a group's values in one aggregation buffer.

    Values are counted, placed into at most 1024 equal slots between the group's extremes, and only the
    slots that hold the middle ranks are sorted.
    """
    keys = list(keys)
    slots = 1024
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    span = F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum("_n").alias("total")).alias("_span")
    if keys:
        spanned = counted.join(counted.groupBy(*keys).agg(span), keys)
    else:
        spanned = counted.withColumn("_span", counted.agg(span).scalar())
    share = (F.col(column) - F.col("_span.lo")) / (F.col("_span.hi") - F.col("_span.lo"))
    slot = F.when(F.col("_span.hi") == F.col("_span.lo"), F.lit(0)).otherwise(
        F.least(F.floor(share * slots), F.lit(slots - 1))
    )
    placed = spanned.withColumns({"_slot": slot.cast("int"), "_total": F.col("_span.total")}).drop("_span")
    # keyless input has one group: at most 1024 slot rows reach this window
    group = keys or ["_total"]
    per_slot = placed.groupBy(*keys, "_slot", "_total").agg(F.sum("_n").alias("_in"))
    run = W.partitionBy(*group).orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = per_slot.withColumn("_upto", F.sum("_in").over(run))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    before = F.col("_upto") - F.col("_in")
    holds = ((before < low) & (F.col("_upto") >= low)) | ((before < high) & (F.col("_upto") >= high))
    wanted = ranked.where(holds).select(*keys, "_slot", before.alias("_before"))
    inner = W.partitionBy(*keys, "_slot").orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = placed.join(wanted, [*keys, "_slot"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inner))
    start = F.col("_end") - F.col("_n")
    at_low = F.max(F.when((start < low) & (F.col("_end") >= low), F.col(column)))
    at_high = F.max(F.when((start < high) & (F.col("_end") >= high), F.col(column)))
    return middle.groupBy(*keys).agg(((at_low + at_high) / 2).alias(name))


def spread(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """count, mean, population std, min, max and exact median of a number per group; zeros when empty."""
    keys = list(keys)
    measures = [
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    ]
    summary = df.groupBy(*keys).agg(*measures)
    middle = exact_median(df, keys, column)
    if keys:
        joined = summary.join(middle, keys, "left")
    else:
        joined = summary.withColumn("median", middle.agg(F.max("median")).scalar())
    return joined.fillna(0.0, subset=["mean", "std", "min", "max", "median"])


def number_items(df: DataFrame, keys: Sequence[str], item: str, name: str, bucket: Column | None = None) -> DataFrame:
    """0-based number of each row within its group in the order of `item`, which must be unique there.

    Rows are numbered bucket by bucket: buckets are counted and offset first, so a large group is never sorted
    whole in one task. `bucket` is a prefix of the item's order that splits it evenly, such as the head of a
    hash. Without one, rows are range-partitioned by sampled bounds and stored, which holds the bounds still.
    """
    keys = list(keys)
    if bucket is not None:
        placed = df.withColumn("_bucket", bucket)
    else:
        placed = cut_lineage(df.repartitionByRange(*keys, item).withColumn("_bucket", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(item))
    numbered = placed.join(offsets, [*keys, "_bucket"])
    return numbered.withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_bucket", "_before")
