"""Density clustering: DBSCAN* on the graph of rows whose cosine distance is at most eps.

It is one horizontal cut of the density hierarchy: rows with at least `min_samples` rows in reach (the row
itself counts) are core, connected core rows form a cluster, clusters below `min_cluster_size` and all other
rows are noise (-1). Rows are sparse: (group, id, n, idx, w), rarest terms first, unit length.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.blocks import block_pairs, constants, group_schema, map_groups, numbers, sparse_rows, strings
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import number_items
from formscribe.session import cut_lineage


def prefix_terms(least: Column) -> Column:
    """Leading terms of a row such that the rest of the row is shorter than `least`.

    Two unit rows with cosine >= `least` share a term of both prefixes, namely their rarest common one.
    """
    backwards = F.reverse("w")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(state: Column, x: Column) -> Column:
        total = state["sum"] + x * x
        fits = state["open"] & (total < least * least - 1e-12)
        return F.struct(
            total.alias("sum"), F.when(fits, state["n"] + 1).otherwise(state["n"]).alias("n"), fits.alias("open")
        )

    dropped = F.aggregate(backwards, start, step, lambda s: s["n"])
    return F.slice("idx", F.lit(1), F.greatest(F.size("idx") - dropped, F.lit(0)))


def _meetings(rows: DataFrame, group: Sequence[str], settings: Settings) -> DataFrame:
    """Rows once per prefix term and block pair; a term that one row alone has leads nowhere."""
    visits = rows.withColumn("term", F.explode(prefix_terms(1.0 - F.col("eps"))))
    return block_pairs(visits, [*group, "term"], "id", settings.block_rows, at_least=2)


def _close(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, second, near): the two blocks' masks and which of their rows are within eps."""
    dense = sparse_rows(table)
    lo, hi = numbers(table, "lo")[0], numbers(table, "hi")[0]
    first = numbers(table, "b") == lo
    second = first if lo == hi else ~first
    near = dense[first] @ dense[second].T >= 1.0 - numbers(table, "eps")[0] - 1e-12
    if lo == hi:
        np.fill_diagonal(near, False)
    return dense, first, second, near


def close_counts(rows: DataFrame, group: Sequence[str], settings: Settings) -> DataFrame:
    """(group, id, close): occurrences of other rows within eps. A pair is counted at its rarest common term
    only, so meeting at several terms changes nothing."""
    group = list(group)

    def kernel(table: pa.Table) -> pa.Table:
        dense, first, second, near = _close(table)
        term = int(numbers(table, "term")[0])
        earlier = (dense[:, :term] != 0).astype(float)
        near &= (earlier[first] @ earlier[second].T) == 0
        n, ids = numbers(table, "n").astype(np.int64), strings(table, "id")
        out_ids, out = [ids[first]], [near @ n[second]]
        if numbers(table, "lo")[0] != numbers(table, "hi")[0]:
            out_ids.append(ids[second])
            out.append(near.T @ n[first])
        total = np.concatenate(out)
        return pa.table(
            {**constants(table, group, len(total)), "id": pa.array(np.concatenate(out_ids)), "close": pa.array(total)}
        )

    meeting = _meetings(rows, group, settings)
    schema = group_schema(rows, group, "id string, close bigint")
    partial = map_groups(meeting, [*group, "term", "lo", "hi"], kernel, schema)
    return partial.groupBy(*group, "id").agg(F.sum("close").alias("close"))


def component_roots(near: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row through `near`."""
    size = len(first)
    label = np.arange(size)
    left, right = np.flatnonzero(first), np.flatnonzero(second)
    while True:
        before = label.copy()
        if len(left) and len(right):
            reach = np.where(near, label[right][None, :], size).min(axis=1)
            label[left] = np.minimum(label[left], reach)
            reach = np.where(near, label[left][:, None], size).min(axis=0)
            label[right] = np.minimum(label[right], reach)
            label = label[label]
        if (label == before).all():
            return label


def core_edges(rows: DataFrame, group: Sequence[str], settings: Settings) -> DataFrame:
    """(group, a, b): each meeting sends its rows to one representative per component, so a dense block gives
    as many edges as rows, not as pairs."""
    group = list(group)

    def kernel(table: pa.Table) -> pa.Table | None:
        _, first, second, near = _close(table)
        root = component_roots(near, first, second)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if not len(moved):
            return None
        ids = strings(table, "id")
        return pa.table(
            {**constants(table, group, len(moved)), "a": pa.array(ids[moved]), "b": pa.array(ids[root[moved]])}
        )

    meeting = _meetings(rows, group, settings)
    edges = map_groups(meeting, [*group, "term", "lo", "hi"], kernel, group_schema(rows, group, "a string, b string"))
    return edges.distinct()


def connected(edges: DataFrame, group: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(group, id, root): the smallest id of each connected component.

    Every round takes the smallest label among the neighbours and then the label of that label, which halves
    long chains; rounds are checkpointed, and the loop ends when no label changes.
    """
    group = list(group)
    one_way = edges.select(*group, F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut_lineage(one_way.unionByName(one_way.select(*group, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(*group, F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    labels = cut_lineage(labels)
    while True:
        seen = both.join(labels.select(*group, F.col("id").alias("v"), F.col("root").alias("r")), [*group, "v"])
        lowest = seen.groupBy(*group, F.col("u").alias("id")).agg(F.min("r").alias("r"))
        lower = labels.join(lowest, [*group, "id"]).select(
            *group, "id", F.col("root").alias("old"), F.least("root", "r").alias("mid")
        )
        jump = labels.select(*group, F.col("id").alias("mid"), F.col("root").alias("next"))
        moved = lower.join(jump, [*group, "mid"]).select(
            *group, "id", F.least("mid", "next").alias("root"), (F.least("mid", "next") != F.col("old")).alias("moved")
        )
        moved = cut_lineage(moved)
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels


def density_labels(rows: DataFrame, group: Sequence[str] = (KEY,), settings: Settings = Settings()) -> DataFrame:
    """(group, id, cluster) for every row; -1 is noise. Clusters are numbered from 0 within the group.

    Columns eps, min_samples and min_cluster_size may be given per row; settings fill what is missing.
    """
    group = list(group)
    defaults = {"eps": settings.density_eps, "min_samples": settings.min_samples, "min_cluster_size": settings.min_cluster_size}
    rows = rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})
    rows = cut_lineage(rows.select(*group, "id", "n", "idx", "w", *defaults))
    neighbours = rows.join(close_counts(rows, group, settings), [*group, "id"], "left")
    core = cut_lineage(
        neighbours.where(F.col("n") + F.coalesce("close", F.lit(0)) >= F.col("min_samples")).select(*rows.columns)
    )
    roots = connected(core_edges(core, group, settings), group)
    member = core.join(roots, [*group, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    sizes = member.groupBy(*group, "root").agg(F.sum("n").alias("size"), F.max("min_cluster_size").alias("least"))
    kept = sizes.where(F.col("size") >= F.col("least")).select(*group, "root")
    # roots are hash ids, whose first characters split them evenly
    numbered = number_items(kept, group, "root", "cluster", F.substring("root", 1, 3))
    labelled = member.join(numbered, [*group, "root"]).select(*group, "id", F.col("cluster").cast("int").alias("cluster"))
    return rows.select(*group, "id").join(labelled, [*group, "id"], "left").fillna(-1, subset=["cluster"])
