"""Combining key statistics of several batches."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.profile import KEY, value_table
from formscribe.operators.ranking import top_per_group


def batch_stats(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Mergeable statistics of one batch, one row per (key, signature): count, distinct values and a sketch
    of the distinct values. Nothing is cut to a top ten, so merged histograms stay exact."""
    values = value_table(df, settings)
    return values.groupBy(KEY, "sig").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique_values"),
        F.hll_sketch_agg("value", F.lit(14)).alias("value_sketch"),
    )


#: Size of a quantile sketch; ranks are off by `RANK_ERROR` at most with 99 % confidence, however many batches are merged.
SKETCH_K, RANK_ERROR = 400, 0.01


def length_sketches(df: DataFrame) -> DataFrame:
    """Mergeable length statistics of one batch, one row per key: count, sum, min, max and a sketch of all lengths."""
    length = F.length("value").cast("long")
    return df.where(F.col("value").isNotNull()).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(length).alias("length_sum"),
        F.min(length).alias("length_min"),
        F.max(length).alias("length_max"),
        F.kll_sketch_agg_bigint(length, F.lit(SKETCH_K)).alias("length_sketch"),
    )


def merge_length_sketches(batches: DataFrame) -> DataFrame:
    """One row per key of the same form, from any number of batches."""
    return batches.groupBy(KEY).agg(
        F.sum("count").alias("count"),
        F.sum("length_sum").alias("length_sum"),
        F.min("length_min").alias("length_min"),
        F.max("length_max").alias("length_max"),
        F.kll_merge_agg_bigint("length_sketch", F.lit(SKETCH_K)).alias("length_sketch"),
    )


def merged_length_stats(batches: DataFrame) -> DataFrame:
    """(key, count, mean, min, max, median) over all batches; the median is a length whose rank is within `RANK_ERROR`."""
    return merge_length_sketches(batches).select(
        KEY,
        "count",
        (F.col("length_sum") / F.col("count")).alias("mean"),
        F.col("length_min").alias("min"),
        F.col("length_max").alias("max"),
        F.kll_sketch_get_quantile_bigint("length_sketch", F.lit(0.5)).alias("median"),
    )


def merge_batch_stats(batches: DataFrame, settings: Settings = Settings(), mode: str = "sketch") -> DataFrame:
    """Merged per-key statistics. `sum` adds the distinct counts of the batches, which counts a value again
    for every batch that holds it; `sketch` unions the sketches."""
    if mode not in ("sum", "sketch"):
        raise ValueError("mode must be 'sum' or 'sketch'")
    merged = batches.groupBy(KEY, "sig").agg(
        F.sum("count").alias("count"),
        F.sum("unique_values").alias("unique_sum"),
        F.hll_union_agg("value_sketch").alias("value_sketch"),
    )
    totals = merged.groupBy(KEY).agg(
        F.sum("count").alias("count"),
        F.sum("unique_sum").alias("unique_sum"),
        F.hll_sketch_estimate(F.hll_union_agg("value_sketch")).alias("unique_sketch"),
    )
    unique = F.col("unique_sum") if mode == "sum" else F.least("unique_sketch", "count")
    ratio = unique / F.col("count")
    top = top_per_group(
        merged.select(KEY, "sig", "count"), [KEY], [F.col("count").desc(), F.col("sig")], settings.top_signatures
    )
    entry = F.struct("rank", "sig", "count")
    lists = top.groupBy(KEY).agg(F.array_sort(F.collect_list(entry)).alias("top_signatures"))
    return totals.join(lists, KEY).select(
        KEY,
        "count",
        unique.alias("unique_values"),
        ratio.alias("unique_ratio"),
        (ratio > settings.free_text_ratio).alias("is_free_text"),
        "top_signatures",
    )


def merge_key_rows(stats: DataFrame) -> DataFrame:
    """Merge of finished per-batch key rows: counts and distincts added, ratio averaged, flags or-ed."""
    flags = [F.bool_or(c).alias(c) for c in ("is_free_text", "is_numeric_unit") if c in stats.columns]
    return stats.groupBy(KEY).agg(
        F.sum("count").alias("count"),
        F.sum("unique_values").alias("unique_values"),
        F.avg("unique_ratio").alias("unique_ratio"),
        *flags,
    )
