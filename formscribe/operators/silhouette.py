"""Silhouette scores and label agreement."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.blocks import add_blocks, block_pairs, constants, group_schema, map_groups, numbers, sparse_rows, strings, tiles
from formscribe.operators.neighbours import TILE_COLUMNS, TILE_ROWS
from formscribe.operators.profile import KEY


def silhouette(labelled: DataFrame, group: Sequence[str] = (KEY,), settings: Settings = Settings()) -> DataFrame:
    """(group, silhouette) of labelled rows (group, id, n, idx, w, cluster): Euclidean, noise left out, 0 with
    fewer than two clusters; a value that occurs n times counts n times.

    Exact. Block pairs give distance sums per row and cluster; pairs of rows never leave a task.
    """
    group = list(group)
    rows = labelled.where(F.col("cluster") >= 0)
    sizes = rows.groupBy(*group, "cluster").agg(F.sum("n").alias("size"))
    several = sizes.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= 2).select(*group)
    meeting = block_pairs(rows.join(several, group, "left_semi"), group, "id", settings.block_rows, tiled=True)

    def kernel(table: pa.Table) -> pa.Table:
        dense, ids = sparse_rows(table), strings(table, "id")
        n, cluster = numbers(table, "n").astype(float), numbers(table, "cluster")
        lo, hi = numbers(table, "lo")[0], numbers(table, "hi")[0]
        first = numbers(table, "b") == lo
        second = first if lo == hi else ~first
        square = (dense * dense).sum(1)
        left, right, here, there = dense[first], dense[second], square[first], square[second]
        mine, theirs = _weights(cluster[first], n[first]), _weights(cluster[second], n[second])
        back, parts = np.zeros((len(right), mine[1].shape[1])), []
        for some in tiles(len(left), TILE_ROWS):
            totals = np.zeros((some.stop - some.start, theirs[1].shape[1]))
            for others in tiles(len(right), TILE_COLUMNS):
                gaps = here[some][:, None] + there[others][None, :] - 2.0 * (left[some] @ right[others].T)
                gaps = np.sqrt(np.maximum(gaps, 0.0))
                if lo == hi:
                    r = np.arange(max(some.start, others.start), min(some.stop, others.stop))
                    gaps[r - some.start, r - others.start] = 0.0
                else:
                    back[others] += gaps.T @ mine[1][some]
                totals += gaps @ theirs[1][others]
            parts.append(_sums(totals, theirs[0], ids[first][some], cluster[first][some], n[first][some]))
        if lo != hi:
            parts.append(_sums(back, mine[0], ids[second], cluster[second], n[second]))
        columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        return pa.table({**constants(table, group, len(columns["id"])), **{k: pa.array(v) for k, v in columns.items()}})

    schema = group_schema(rows, group, "id string, own int, n double, other int, total double")
    sums = map_groups(meeting.select(*group, "id", "n", "cluster", "idx", "w", "b", "lo", "hi"), [*group, "lo", "hi"], kernel, schema)
    per_cluster = sums.groupBy(*group, "id", "own", "n", "other").agg(F.sum("total").alias("total"))
    sized = per_cluster.join(sizes.withColumnRenamed("cluster", "other"), [*group, "other"])
    same = F.col("own") == F.col("other")
    # a row is no neighbour of itself, but its repetitions are
    inside = F.max(F.when(same & (F.col("size") > 1), F.col("total") / (F.col("size") - 1)))
    outside = F.min(F.when(~same, F.col("total") / F.col("size")))
    scores = sized.groupBy(*group, "id", "n").agg(inside.alias("a"), outside.alias("b"))
    width = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | (width == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / width)
    result = scores.groupBy(*group).agg((F.sum(score * F.col("n")) / F.sum("n")).alias("silhouette"))
    everyone = labelled.select(*group).distinct()
    return everyone.join(result, group, "left").fillna(0.0, subset=["silhouette"])


def silhouette_from_moments(labelled: DataFrame, group: Sequence[str] = (KEY,), settings: Settings = Settings()) -> DataFrame:
    """(group, silhouette) over squared Euclidean distances, linear in the rows.

    The mean squared distance of a row to a cluster follows from the cluster's size, mean row and mean squared
    length, so rows only meet the few cluster records of their group.
    """
    group = list(group)
    rows = labelled.where(F.col("cluster") >= 0)
    sizes = rows.groupBy(*group, "cluster").agg(
        F.sum("n").alias("size"),
        (F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x) * F.col("n")) / F.sum("n")).alias("square"),
    )
    entries = rows.select(*group, "cluster", "n", F.explode(F.arrays_zip("idx", "w")).alias("e"))
    sums = entries.groupBy(*group, "cluster", F.col("e.idx").alias("i")).agg(F.sum(F.col("e.w") * F.col("n")).alias("s"))
    # one entry per term of the group's bounded vocabulary
    packed = sums.groupBy(*group, "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("e"))
    moments = sizes.join(packed, [*group, "cluster"], "left").select(
        *group,
        "cluster",
        "size",
        "square",
        F.coalesce(F.col("e.i"), F.array().cast("array<int>")).alias("idx"),
        F.coalesce(F.transform("e", lambda x: x["s"] / F.col("size")), F.array().cast("array<double>")).alias("w"),
    )
    blocked = add_blocks(rows.select(*group, "id", "n", "cluster", "idx", "w"), group, "id", settings.block_rows)
    places = blocked.select(*group, "b").distinct()
    columns = [*group, "b", "id", "n", "cluster", "size", "square", "idx", "w"]
    points = blocked.withColumns({"size": F.lit(None).cast("long"), "square": F.lit(None).cast("double")}).select(*columns)
    records = moments.join(places, group).withColumns({"id": F.lit(""), "n": F.lit(0).cast("long")}).select(*columns)

    def kernel(table: pa.Table) -> pa.Table | None:
        dense, n, cluster = sparse_rows(table), numbers(table, "n"), numbers(table, "cluster")
        record = n == 0
        if record.sum() < 2:
            return None
        centre, size = dense[record], table.column("size").to_numpy()[record].astype(float)
        square = table.column("square").to_numpy()[record].astype(float)
        x, own = dense[~record], cluster[~record]
        gaps = np.maximum((x * x).sum(1)[:, None] + square[None, :] - 2.0 * (x @ centre.T), 0.0)
        mine = own[:, None] == cluster[record][None, :]
        inside = (gaps * mine).sum(1)
        mates = (size[None, :] * mine).sum(1)
        a = np.divide(inside * mates, mates - 1, out=np.zeros_like(inside), where=mates > 1)
        b = np.where(mine, np.inf, gaps).min(axis=1)
        wide = np.maximum(a, b)
        s = np.divide(b - a, wide, out=np.zeros_like(wide), where=(wide > 0) & (mates > 1))
        weight = n[~record].astype(float)
        return pa.table(
            {**constants(table, group, 1), "total": pa.array([float((s * weight).sum())]), "rows": pa.array([float(weight.sum())])}
        )

    partial = map_groups(points.unionByName(records), [*group, "b"], kernel, group_schema(rows, group, "total double, rows double"))
    scored = partial.groupBy(*group).agg((F.sum("total") / F.sum("rows")).alias("silhouette"))
    return labelled.select(*group).distinct().join(scored, group, "left").fillna(0.0, subset=["silhouette"])


def silhouette_of(labelled: DataFrame, group: Sequence[str] = (KEY,), settings: Settings = Settings()) -> DataFrame:
    """(group, silhouette) by the measure that the settings name, the same for groups of every size."""
    if settings.silhouette_measure == "euclidean":
        return silhouette(labelled, group, settings)
    if settings.silhouette_measure == "squared":
        return silhouette_from_moments(labelled, group, settings)
    raise ValueError("silhouette_measure must be euclidean or squared")


def _weights(clusters: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The clusters of a block, and for each row its weight in the column of its cluster."""
    present, place = np.unique(clusters, return_inverse=True)
    onehot = np.zeros((len(clusters), len(present)))
    onehot[np.arange(len(clusters)), place] = n
    return present, onehot


def _sums(totals: np.ndarray, present: np.ndarray, ids: np.ndarray, own: np.ndarray, n: np.ndarray) -> dict:
    """Weighted distance sums of rows to the clusters of the other block, one entry each."""
    return {
        "id": np.repeat(ids, len(present)),
        "own": np.repeat(own, len(present)).astype(np.int32),
        "n": np.repeat(n, len(present)),
        "other": np.tile(present, len(ids)).astype(np.int32),
        "total": totals.ravel(),
    }


def adjusted_rand_index(labelled: DataFrame, truth: str, predicted: str, group: Sequence[str] = (KEY,), weight: str | None = None) -> DataFrame:
    """(group, adjusted_rand_index, clusters_predicted) from contingency counts."""
    group = list(group)
    amount = F.sum(F.col(weight) if weight else F.lit(1)).cast("double")
    cells = labelled.groupBy(*group, truth, predicted).agg(amount.alias("n"))

    def pairs(n):
        return n * (n - 1) / 2

    def margin(column: str, name: str) -> DataFrame:
        totals = cells.groupBy(*group, column).agg(F.sum("n").alias("n"))
        return totals.groupBy(*group).agg(F.sum(pairs(F.col("n"))).alias(name), F.count(F.lit(1)).alias(f"{name}_k"))

    joint = cells.groupBy(*group).agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    joined = joint.join(margin(truth, "t"), group).join(margin(predicted, "p"), group)
    expected = F.col("t") * F.col("p") / pairs(F.col("total"))
    best = (F.col("t") + F.col("p")) / 2
    score = F.when((F.col("total") < 2) | (best == expected), F.lit(1.0)).otherwise((F.col("both") - expected) / (best - expected))
    return joined.select(*group, score.alias("adjusted_rand_index"), F.col("p_k").alias("clusters_predicted"))
