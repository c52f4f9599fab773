"""Fitted cluster models as stored tables: learn on some values, keep, load, label new values, and score the labels."""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.blocks import add_blocks, constants, group_schema, map_groups, numbers, sparse_rows, strings
from formscribe.operators.cluster import best_model, search_kmeans, training_rows
from formscribe.operators.hierarchy import SEARCH_GRID, hierarchy_labels, search_hierarchy
from formscribe.operators.kmeans import train_centres
from formscribe.operators.mining import signature_labels
from formscribe.operators.profile import KEY
from formscribe.operators.silhouette import adjusted_rand_index, silhouette_of
from formscribe.operators.terms import term_counts, term_weights, vocabulary
from formscribe.operators.vectors import value_id
from formscribe.session import cut_lineage

#: Terms of a training key, as the training step has it; its keys have ten values or more.
MAX_FEATURES, LEAST_VALUES = 1000, 10


@dataclass(frozen=True)
class ClusterModels:
    """terms: key, term, df, idf, idx. models: key, type (density or kmeans), score and the chosen parameters.
    centres: key, cluster, idx, w, reach: the mean of a cluster, and how far its farthest value was."""

    terms: DataFrame
    models: DataFrame
    centres: DataFrame

    def save(self, path: str) -> None:
        for name in ("terms", "models", "centres"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_models(spark: SparkSession, path: str) -> ClusterModels:
    return ClusterModels(*[spark.read.parquet(f"{path}/{name}") for name in ("terms", "models", "centres")])


def rows_of(values: DataFrame, terms: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Values (key, value, n) as rows (..., id, idx, w) of fitted terms; unknown terms do not count."""
    weights = term_weights(term_counts(values, settings), terms)
    packed = weights.groupBy(KEY, "id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("e"))
    named = values.withColumn("id", value_id(F.col("value")))
    joined = named.join(packed, [KEY, "id"], "left")
    empty = [F.array().cast("array<int>"), F.array().cast("array<double>")]
    return joined.select(*named.columns, F.coalesce("e.idx", empty[0]).alias("idx"), F.coalesce("e.w", empty[1]).alias("w"))


def _gaps(rows: DataFrame, centres: DataFrame, settings: Settings) -> DataFrame:
    """(key, id, cluster, gap, reach): the nearest centre of every row. Centres are few per key and go to all its blocks."""
    blocked = add_blocks(rows.select(KEY, "id", "idx", "w"), [KEY], "id", settings.block_rows)
    places = blocked.select(KEY, "b").distinct()
    spread = centres.join(places, KEY).select(KEY, "b", F.lit("").alias("id"), F.col("cluster").alias("c"), "reach", "idx", "w")
    both = blocked.select(KEY, "b", "id", F.lit(-1).alias("c"), F.lit(0.0).alias("reach"), "idx", "w").unionByName(spread)

    def kernel(table: pa.Table) -> pa.Table | None:
        c, dense = numbers(table, "c"), sparse_rows(table)
        stored = c >= 0
        if stored.all() or not stored.any():
            return None
        order = np.argsort(c[stored])
        x, m = dense[~stored], dense[stored][order]
        squares = (x * x).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2.0 * (x @ m.T)
        near = squares.argmin(axis=1)
        return pa.table(
            {
                **constants(table, [KEY], len(x)),
                "id": pa.array(strings(table, "id")[~stored]),
                "cluster": pa.array(c[stored][order][near].astype(np.int32)),
                "gap": pa.array(np.sqrt(np.maximum(squares[np.arange(len(x)), near], 0.0))),
                "reach": pa.array(numbers(table, "reach")[stored][order][near]),
            }
        )

    return map_groups(both, [KEY, "b"], kernel, group_schema(rows, [KEY], "id string, cluster int, gap double, reach double"))


def _means(labelled: DataFrame) -> DataFrame:
    """(key, cluster, idx, w) of labelled rows, noise left out; a mean has the terms of its rows."""
    real = labelled.where(F.col("cluster") >= 0)
    mass = real.groupBy(KEY, "cluster").agg(F.sum("n").alias("mass"))
    entries = real.select(KEY, "cluster", "n", F.explode(F.arrays_zip("idx", "w")).alias("e"))
    sums = entries.groupBy(KEY, "cluster", F.col("e.idx").alias("i")).agg(F.sum(F.col("n") * F.col("e.w")).alias("s"))
    packed = sums.groupBy(KEY, "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("e"))
    means = mass.join(packed, [KEY, "cluster"], "left")
    w = F.transform("e.s", lambda s: F.round(s / F.col("mass"), 12))
    return means.select(KEY, "cluster", F.coalesce("e.i", F.array().cast("array<int>")).alias("idx"), F.coalesce(w, F.array().cast("array<double>")).alias("w"))


def fit_models(
    values: DataFrame, settings: Settings = Settings(), grid: tuple[tuple[int, int, str], ...] = SEARCH_GRID, most: int = 20
) -> ClusterModels:
    """The better of a density and a k-means clustering per key, by silhouette over their grids, as tables to be kept.

    Keys with fewer than `LEAST_VALUES` values or without a cell that gives several labels have no density model; a key
    with neither has none at all. All keys take the same steps at once.
    """
    settings = replace(settings, max_features=MAX_FEATURES)
    rows = cut_lineage(training_rows(values, settings))
    kept = values.join(rows.select(KEY).distinct(), KEY, "left_semi")
    terms = cut_lineage(vocabulary(kept, term_counts(kept, settings), settings))
    density = cut_lineage(search_hierarchy(rows, grid=grid, settings=settings))
    kmeans = cut_lineage(search_kmeans(rows, settings, most))
    chosen = best_model(density.select(KEY, "score"), kmeans.select(KEY, "score"))
    models = chosen.join(density.drop("score"), KEY, "left").join(kmeans.select(KEY, "k"), KEY, "left")
    own = F.col("type") == "density"
    models = cut_lineage(
        models.select(
            KEY, "type", "score", F.when(~own, F.col("k")).alias("k"),
            *[F.when(own, F.col(c)).alias(c) for c in ("min_cluster_size", "min_samples", "metric")],
        )
    )
    by_k = rows.join(models.where(F.col("type") == "kmeans").select(KEY, "k"), KEY)
    centres = train_centres(by_k, [KEY], "k", settings=settings).select(KEY, "cluster", "idx", "w")
    for metric in dict.fromkeys(m for _, _, m in grid):
        mine = models.where(own & (F.col("metric") == metric)).select(KEY, "min_cluster_size", "min_samples")
        dense = rows.select(KEY, "id", "n", "idx", "w").join(mine, KEY)
        labels = hierarchy_labels(dense, [KEY], metric, settings).select(KEY, "id", "cluster")
        centres = centres.unionByName(_means(dense.join(labels, [KEY, "id"])))
    centres = cut_lineage(centres.withColumn("reach", F.lit(0.0)))
    # the farthest training value that is nearest to a mean, among those with a label
    farthest = _gaps(rows, centres, settings).groupBy(KEY, "cluster").agg(F.max("gap").alias("reach"))
    centres = centres.drop("reach").join(farthest, [KEY, "cluster"], "left").fillna(0.0, subset=["reach"])
    return ClusterModels(terms, models, cut_lineage(centres))


def predict(models: ClusterModels, values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Values of keys that have a model, as rows with cluster: that of the nearest mean. A density model leaves values
    that are farther from it than any training value as noise (-1)."""
    settings = replace(settings, max_features=MAX_FEATURES)
    known = values.join(models.models.select(KEY, "type"), KEY)
    rows = cut_lineage(rows_of(known, models.terms, settings))
    near = _gaps(rows, models.centres, settings)
    far = (F.col("type") == "density") & (F.col("gap") > F.col("reach") + 1e-9)
    labelled = rows.join(near, [KEY, "id"])
    return labelled.withColumn("cluster", F.when(far, -1).otherwise(F.col("cluster"))).drop("reach")


def evaluate(models: ClusterModels, test_values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, type, tested, n_clusters_predicted, silhouette_score, adjusted_rand_index) on values (key, value, n, sig) that
    were not learnt from; the signatures are the labels that are asked for. Keys with one predicted label are left out."""
    found = cut_lineage(predict(models, test_values, settings))
    several = found.groupBy(KEY).agg(F.count(F.lit(1)).alias("tested"), F.count_distinct("cluster").alias("n_clusters_predicted")).where("n_clusters_predicted > 1")
    scored = found.join(several.select(KEY), KEY, "left_semi")
    # noise is one more label here
    inside = silhouette_of(scored.withColumn("cluster", F.col("cluster") + 1), [KEY], settings)
    truth = signature_labels(test_values).select(KEY, "value", "label")
    agreed = adjusted_rand_index(scored.join(truth, [KEY, "value"]), "label", "cluster", weight="n")
    return (
        several.join(models.models.select(KEY, "type"), KEY)
        .join(inside, KEY)
        .join(agreed.select(KEY, "adjusted_rand_index"), KEY)
        .select(KEY, "type", "tested", "n_clusters_predicted", F.col("silhouette").alias("silhouette_score"), "adjusted_rand_index")
    )
