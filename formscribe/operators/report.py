"""Summary rows over profile, rule, cluster and review tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formscribe.operators.profile import KEY


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def key_type_counts(profiles: DataFrame) -> DataFrame:
    """Keys by type. A key may be both free text and numeric, so structured = total - both can under-count;
    `overlap` says by how much."""
    free, numeric = F.count_if("is_free_text"), F.count_if("is_numeric_unit")
    total = F.count(F.lit(1))
    return profiles.agg(
        total.alias("total_keys"),
        free.alias("free_text_keys"),
        numeric.alias("numeric_keys"),
        (total - free - numeric).alias("structured_keys"),
        F.count_if(F.col("is_free_text") & F.col("is_numeric_unit")).alias("overlap"),
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the extremes; the last bin includes the maximum."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    spanned = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), span.alias("s"))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("s.lo")) / width), F.lit(bins - 1)))
    return spanned.groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def key_overview(stats: DataFrame) -> DataFrame:
    """Totals and mean values per key."""
    return stats.agg(
        F.count(F.lit(1)).alias("total_keys"),
        F.sum("count").alias("total_values"),
        F.avg("count").alias("mean_values_per_key"),
        F.sum("unique_values").alias("total_unique"),
        F.avg("unique_ratio").alias("mean_unique_ratio"),
        F.count_if("is_free_text").alias("free_text_keys"),
    )


def largest_keys(stats: DataFrame, n: int = 10) -> DataFrame:
    chosen = stats.select(KEY, "count", "unique_values", "unique_ratio")
    return chosen.orderBy(F.col("count").desc(), KEY).limit(n)


def run_report(rows: DataFrame, profiles: DataFrame, rules: DataFrame, clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of every stage of a learning run."""
    return rows.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        _rows(profiles).alias("unique_keys"),
        _rows(profiles).alias("key_profiles"),
        _rows(rules).alias("normalization_rules"),
        _rows(clusters).alias("clustering_models"),
        _rows(vectors).alias("embedding_vectors"),
    )


def service_counts(profiles: DataFrame, pending: DataFrame, vectors: DataFrame, rules: DataFrame) -> DataFrame:
    return profiles.agg(F.count(F.lit(1)).alias("total_keys")).select(
        "total_keys",
        _rows(pending).alias("review_queue_size"),
        _rows(vectors.select(KEY).distinct()).alias("indices_loaded"),
        _rows(rules).alias("normalization_rules_loaded"),
    )


def training_summary(examples: DataFrame, pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """Sizes of the mined training data."""
    return examples.agg(F.count_distinct(KEY).alias("clustering_keys")).select(
        "clustering_keys", _rows(pairs).alias("embedding_pairs"), _rows(changed).alias("normalization_examples")
    )


def silhouette_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("keys"),
        *[
            F.coalesce(f("silhouette"), F.lit(0.0)).alias(f"silhouette_{n}")
            for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
        ],
    )


def model_type_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
