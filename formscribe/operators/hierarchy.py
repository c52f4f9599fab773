"""The density hierarchy: clusters of varying density without a distance to choose.

Two rows are as far apart as their distance or the larger of their core distances (how far the `min_samples`-th row is, the
row itself counts). The spanning tree of these distances, cut from its longest edge down, is a tree of clusters; those of
at least `min_cluster_size` rows that last longest for their size are the result, all other rows are noise.

Rows are sparse: (group, id, n, idx, w), n occurrences each. Groups of one block get their spanning tree in one go; larger
ones by rounds in which every component takes its shortest edge to another one, over all pairs of blocks. Both follow one
order of edges (distance, then ids), so the tree does not depend on the blocks.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.blocks import add_blocks, block_pairs, constants, group_schema, map_groups, numbers, sparse_rows, strings, unit_rows
from formscribe.operators.density import connected
from formscribe.operators.profile import KEY
from formscribe.operators.silhouette import silhouette
from formscribe.session import cut_lineage

#: Distances are kept to so many digits, so that equal ones are equal; smaller ones than the last digit count as that.
DIGITS = 9
FLOOR = 10.0**-DIGITS
METRICS = ("euclidean", "cosine", "manhattan")


def row_distances(one: np.ndarray, two: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        found = 1.0 - unit_rows(one) @ unit_rows(two).T
    elif metric == "euclidean":
        squares = (one * one).sum(1)[:, None] + (two * two).sum(1)[None, :] - 2.0 * (one @ two.T)
        found = np.sqrt(np.maximum(squares, 0.0))
    elif metric == "manhattan":
        found = np.zeros((len(one), len(two)))
        for i, row in enumerate(one):
            found[i] = np.abs(two - row).sum(1)
    else:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return np.round(np.maximum(found, 0.0), DIGITS)


def _by_id(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(strings(table, "id"), kind="stable")))


def _reached(distances: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the nearest columns of each row that together hold `least` occurrences, or all."""
    keep = min(least, distances.shape[1])
    nearest = np.argpartition(distances, keep - 1, axis=1)[:, :keep] if keep < distances.shape[1] else np.tile(np.arange(keep), (len(distances), 1))
    return np.repeat(np.arange(len(distances)), keep), nearest.ravel()


def _core(distances: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Distance at which each row has `least` occurrences in reach; the farthest row if there are fewer."""
    order = np.argsort(distances, axis=1, kind="stable")
    near = np.take_along_axis(distances, order, axis=1)
    enough = np.cumsum(n[order], axis=1) >= least
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), distances.shape[1] - 1)
    return near[np.arange(len(near)), at]


def _prim(far: np.ndarray) -> list[tuple[int, int, float]]:
    """The spanning tree of a full matrix: of equal edges the one of smaller rows first."""
    size = len(far)
    open_ = np.ones(size, dtype=bool)
    open_[0] = False
    best, parent = far[0].copy(), np.zeros(size, dtype=np.int64)
    edges = []
    for _ in range(size - 1):
        left = np.flatnonzero(open_)
        ties = left[best[left] == best[left].min()]
        code = np.minimum(ties, parent[ties]) * size + np.maximum(ties, parent[ties])
        new = ties[code.argmin()]
        edges.append((min(new, parent[new]), max(new, parent[new]), float(best[new])))
        open_[new] = False
        mine = np.minimum(np.arange(size), new) * size + np.maximum(np.arange(size), new)
        theirs = np.minimum(np.arange(size), parent) * size + np.maximum(np.arange(size), parent)
        nearer = (far[new] < best) | ((far[new] == best) & (mine < theirs))
        best[nearer], parent[nearer] = far[new][nearer], new
    return edges


def _small_trees(rows: DataFrame, group: list[str], metric: str) -> DataFrame:
    """(group, id, core) and (group, a, b, d) of groups of one block, in one table: b is null in rows of the first kind."""

    def kernel(table: pa.Table) -> pa.Table:
        table = _by_id(table)
        dense, ids = sparse_rows(table), strings(table, "id")
        far = row_distances(dense, dense, metric)
        np.fill_diagonal(far, 0.0)
        core = _core(far, numbers(table, "n").astype(np.int64), int(numbers(table, "min_samples")[0]))
        far = np.maximum(far, np.maximum(core[:, None], core[None, :]))
        edges = _prim(far)
        a = [*ids, *(ids[x] for x, _, _ in edges)]
        b = [*[None] * len(ids), *(ids[y] for _, y, _ in edges)]
        d = [*core, *(w for _, _, w in edges)]
        return pa.table({**constants(table, group, len(a)), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "d": pa.array(d, pa.float64())})

    return map_groups(rows, group, kernel, group_schema(rows, group, "a string, b string, d double"))


def core_distances(rows: DataFrame, group: Sequence[str], metric: str, settings: Settings = Settings()) -> DataFrame:
    """(group, id, core) by pairs of blocks: each pair sends what a row needs at most, `min_samples` rows."""
    group = list(group)

    def kernel(table: pa.Table) -> pa.Table:
        table = _by_id(table)
        dense, ids, n = sparse_rows(table), strings(table, "id"), numbers(table, "n").astype(np.int64)
        lo, hi = numbers(table, "lo")[0], numbers(table, "hi")[0]
        first, least = numbers(table, "b") == lo, int(numbers(table, "min_samples")[0])
        second = first if lo == hi else ~first
        far = row_distances(dense[first], dense[second], metric)
        if lo == hi:
            np.fill_diagonal(far, 0.0)
        out = []
        sides = [(first, second, far)] if lo == hi else [(first, second, far), (second, first, far.T)]
        for mine, theirs, distances in sides:
            i, j = _reached(distances, n[theirs], least)
            out.append((ids[mine][i], distances[i, j], n[theirs][j]))
        got = [np.concatenate(x) for x in zip(*out)]
        return pa.table({**constants(table, group, len(got[0])), "id": pa.array(got[0]), "d": pa.array(got[1]), "n": pa.array(got[2])})

    pairs = block_pairs(rows, group, "id", settings.block_rows)
    near = map_groups(pairs, [*group, "lo", "hi"], kernel, group_schema(rows, group, "id string, d double, n long"))
    wanted = rows.select(*group, F.col("id"), "min_samples")
    nearest = Window.partitionBy(*group, "id").orderBy("d", "n")
    reached = near.join(wanted, [*group, "id"]).withColumn("r", F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
    enough = F.min(F.when(F.col("r") >= F.col("min_samples"), F.col("d")))
    return reached.groupBy(*group, "id").agg(F.coalesce(enough, F.max("d")).alias("core"))


def _shortest_edges(rows: DataFrame, group: list[str], metric: str, settings: Settings) -> DataFrame:
    """(group, c, e): of every component c its shortest edge e (d, a, b, ca, cb) to another one."""

    def kernel(table: pa.Table) -> pa.Table | None:
        table = _by_id(table)
        dense, ids, core, c = sparse_rows(table), strings(table, "id"), numbers(table, "core"), strings(table, "c")
        lo, hi = numbers(table, "lo")[0], numbers(table, "hi")[0]
        first = np.flatnonzero(numbers(table, "b") == lo)
        second = first if lo == hi else np.flatnonzero(numbers(table, "b") != lo)
        far = row_distances(dense[first], dense[second], metric)
        far = np.maximum(far, np.maximum(core[first][:, None], core[second][None, :]))
        names, code = np.unique(c, return_inverse=True)
        far[code[first][:, None] == code[second][None, :]] = np.inf
        best: dict[int, tuple[float, int, int]] = {}
        for mine, theirs, distances in ((first, second, far), (second, first, far.T)):
            for i, least in zip(mine, distances.min(axis=1) if distances.shape[1] else []):
                if np.isfinite(least):
                    # rows are sorted by id, so the smallest number is the smallest id
                    for j in theirs[distances[np.searchsorted(mine, i)] == least]:
                        edge = (float(least), int(min(i, j)), int(max(i, j)))
                        best[code[i]] = min(best.get(code[i], edge), edge)
        if not best:
            return None
        found = sorted(best.items())
        e = [{"d": d, "a": ids[a], "b": ids[b], "ca": c[a], "cb": c[b]} for _, (d, a, b) in found]
        kind = pa.struct([("d", pa.float64()), ("a", pa.string()), ("b", pa.string()), ("ca", pa.string()), ("cb", pa.string())])
        return pa.table({**constants(table, group, len(found)), "c": pa.array([names[k] for k, _ in found], pa.string()), "e": pa.array(e, kind)})

    pairs = block_pairs(rows, group, "id", settings.block_rows)
    schema = group_schema(rows, group, "c string, e struct<d:double,a:string,b:string,ca:string,cb:string>")
    edges = map_groups(pairs, [*group, "lo", "hi"], kernel, schema)
    return edges.groupBy(*group, "c").agg(F.min("e").alias("e"))


def _large_trees(rows: DataFrame, group: list[str], metric: str, settings: Settings) -> DataFrame:
    """The table of `_small_trees` for groups of several blocks."""
    core = cut_lineage(core_distances(rows, group, metric, settings))
    out = core.select(*group, F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("core").alias("d"))
    current = cut_lineage(rows.join(core, [*group, "id"]).withColumn("c", F.col("id")))
    while True:
        chosen = cut_lineage(_shortest_edges(current, group, metric, settings).select(*group, "e.*"))
        if chosen.isEmpty():
            return out
        out = out.unionByName(chosen.select(*group, "a", "b", "d").distinct())
        roots = connected(chosen, group, "ca", "cb").select(*group, F.col("id").alias("c"), "root")
        current = cut_lineage(current.join(roots, [*group, "c"]).withColumn("c", F.col("root")).drop("root"))


def spanning_trees(rows: DataFrame, group: Sequence[str], metric: str = "euclidean", settings: Settings = Settings()) -> DataFrame:
    """(group, a, b, d): a row per edge of each group's spanning tree, and one per row with its core distance (b null)."""
    group = list(group)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    blocked = cut_lineage(add_blocks(rows, group, "id", settings.block_rows))
    small = _small_trees(blocked.where("nb = 1"), group, metric)
    large = blocked.where("nb > 1").drop("nb", "b")
    if large.isEmpty():
        return small
    return small.unionByName(_large_trees(large, group, metric, settings))


def _merge_tree(edges: list[tuple[float, int, int]], sizes: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Single linkage: node `len(sizes) + i` joins two earlier nodes at a distance; sizes of all nodes."""
    count = len(sizes)
    root, size = list(range(2 * count - 1)), [*map(int, sizes)]
    joins = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, a, b in sorted(edges):
        x, y = find(a), find(b)
        new = count + len(joins)
        joins.append((x, y, d))
        size.append(size[x] + size[y])
        root[x] = root[y] = new
    return joins, np.array(size)


def condensed_labels(edges: list[tuple[float, int, int]], core: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, strength) of every row from the spanning tree; clusters are numbered by their first row.

    From the top, a node whose two parts both hold `least` occurrences ends a cluster and begins two; a smaller part
    leaves its cluster there. A cluster's stability is the sum over its rows of how much nearer (in 1 / distance) they
    left than it began. From the bottom, a cluster is taken if it is as stable as what is taken below it; the top one
    never is. Strength is 1 / distance at which a row left, as a share of the largest in its cluster.
    """
    count = len(core)
    joins, size = _merge_tree(edges, sizes)

    def density(d: float) -> float:
        return 1.0 / max(d, FLOOR)

    parent, birth, stability = [-1], [0.0], [0.0]
    left, leaving = np.zeros(count, dtype=np.int64), np.zeros(count)

    def leave(node: int, cluster: int, at: float) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if x < count:
                left[x], leaving[x] = cluster, at
            else:
                stack += joins[x - count][:2]
        stability[cluster] += int(size[node]) * (at - birth[cluster])

    stack = [(2 * count - 2 if joins else 0, 0)] if count else []
    while stack:
        node, cluster = stack.pop()
        if node < count:
            leave(node, cluster, density(core[node]))
            continue
        x, y, d = joins[node - count]
        at, big = density(d), [z for z in (x, y) if size[z] >= least]
        if len(big) == 2:
            stability[cluster] += int(size[node]) * (at - birth[cluster])
            for z in big:
                parent.append(cluster)
                birth.append(at)
                stability.append(0.0)
                stack.append((z, len(parent) - 1))
            continue
        for z in (x, y):
            if z in big:
                stack.append((z, cluster))
            else:
                leave(z, cluster, at)

    below, taken = [0.0] * len(parent), [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        taken[c] = stability[c] >= below[c]
        below[parent[c]] += max(stability[c], below[c])
    label = [-1] * len(parent)
    for c in range(1, len(parent)):
        label[c] = label[parent[c]] if label[parent[c]] >= 0 else c if taken[c] else -1
    found = np.array(label)[left] if count else left
    strength = np.zeros(count)
    numbered = np.full(count, -1, dtype=np.int64)
    _, first = np.unique(found, return_index=True)
    for number, i in enumerate(sorted(i for i in first if found[i] >= 0)):
        mine = found == found[i]
        numbered[mine] = number
        strength[mine] = leaving[mine] / leaving[mine].max()
    return numbered, strength


def hierarchy_labels(
    rows: DataFrame, group: Sequence[str] = (KEY,), metric: str = "euclidean", settings: Settings = Settings()
) -> DataFrame:
    """(group, id, cluster, strength) for every row; -1 is noise, with strength 0. Clusters are numbered from 0.

    Columns min_samples and min_cluster_size may be given per row; settings fill what is missing. Distances are exact,
    so work grows with the square of a group; rows are compared in pairs of blocks, and no pair leaves a task. The last
    step walks a group's spanning tree in one task, with three numbers per row.
    """
    group = list(group)
    defaults = {"min_samples": settings.min_samples, "min_cluster_size": settings.min_cluster_size}
    rows = rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})
    rows = cut_lineage(rows.select(*group, "id", "n", "idx", "w", *defaults))
    return cut_tree_labels(spanning_trees(rows, group, metric, settings), rows, group)


def cut_tree_labels(trees: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, id, cluster, strength) from spanning trees and the rows' n and min_cluster_size."""
    sizes = rows.select(*group, F.col("id").alias("a"), "n", "min_cluster_size")
    both = trees.select(*group, "a", "b", "d").join(sizes, [*group, "a"])

    def kernel(table: pa.Table) -> pa.Table:
        a, b, d = strings(table, "a"), table.column("b").to_pylist(), numbers(table, "d")
        is_row = np.array([x is None for x in b])
        order = np.argsort(a[is_row], kind="stable")
        ids = a[is_row][order]
        at = {x: i for i, x in enumerate(ids)}
        edges = [(float(w), at[x], at[y]) for x, y, w in zip(a, b, d) if y is not None]
        core, n = d[is_row][order], numbers(table, "n")[is_row][order]
        cluster, strength = condensed_labels(edges, core, n, int(numbers(table, "min_cluster_size")[0]))
        return pa.table({**constants(table, group, len(ids)), "id": pa.array(ids), "cluster": pa.array(cluster.astype(np.int32)), "strength": pa.array(strength)})

    return map_groups(both, group, kernel, group_schema(rows, group, "id string, cluster int, strength double"))


#: Grid of the search: smallest cluster, occurrences that make a row dense, and distance.
SEARCH_GRID = tuple((least, samples, metric) for least in (3, 5, 10, 15) for samples in (1, 2, 3, 5) for metric in METRICS)


def _silhouette(distances: np.ndarray, cluster: np.ndarray, n: np.ndarray) -> float:
    """Mean silhouette of n occurrences a row, as the silhouette operator has it; rows alone in their cluster count 0."""
    names, code = np.unique(cluster, return_inverse=True)
    member = np.zeros((len(cluster), len(names)))
    member[np.arange(len(cluster)), code] = n
    totals, size = distances @ member, member.sum(0)
    own = code[:, None] == np.arange(len(names))[None, :]
    mates = size[code]
    a = np.divide(totals[own], mates - 1, out=np.zeros(len(cluster)), where=mates > 1)
    b = np.where(own, np.inf, totals / size[None, :]).min(axis=1)
    wide = np.maximum(a, b)
    s = np.divide(b - a, wide, out=np.zeros(len(cluster)), where=(wide > 0) & (mates > 1))
    return float((s * n).sum() / n.sum())


def _search_small(rows: DataFrame, group: list[str], grid: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Every cell of the grid for groups of one block: distances once per metric, trees once per metric and samples."""

    def kernel(table: pa.Table) -> pa.Table | None:
        table = _by_id(table)
        dense, n = sparse_rows(table), numbers(table, "n").astype(np.int64)
        plain = row_distances(dense, dense, "euclidean")
        np.fill_diagonal(plain, 0.0)
        found = []
        for metric in dict.fromkeys(m for _, _, m in grid):
            far = plain if metric == "euclidean" else row_distances(dense, dense, metric)
            np.fill_diagonal(far, 0.0)
            for samples in dict.fromkeys(s for _, s, m in grid if m == metric):
                core = _core(far, n, samples)
                edges = [(w, a, b) for a, b, w in _prim(np.maximum(far, np.maximum(core[:, None], core[None, :])))]
                for cell, (least, s, m) in enumerate(grid):
                    if (s, m) == (samples, metric):
                        label = condensed_labels(edges, core, n, least)[0]
                        if label.min() != label.max():
                            found.append((cell, _silhouette(plain, label, n)))
        if not found:
            return None
        return pa.table({**constants(table, group, len(found)), "cell": pa.array([c for c, _ in found], pa.int32()), "silhouette": pa.array([s for _, s in found])})

    return map_groups(rows, group, kernel, group_schema(rows, group, "cell int, silhouette double"))


def search_scores(
    rows: DataFrame, group: Sequence[str] = (KEY,), grid: Sequence[tuple[int, int, str]] = SEARCH_GRID, settings: Settings = Settings()
) -> DataFrame:
    """(group, cell, silhouette) of every cell of the grid that gives more than one label; noise is a label like others.

    The silhouette is euclidean for all cells, so that they can be compared. Groups of one block are searched in one go
    without a copy of their rows; larger ones once per metric, with a copy per number of samples, and their spanning trees
    are cut for every smallest cluster.
    """
    group = list(group)
    rows = cut_lineage(rows.select(*group, "id", "n", "idx", "w"))
    blocked = cut_lineage(add_blocks(rows, group, "id", settings.block_rows))
    out = _search_small(blocked.where("nb = 1").drop("nb", "b"), group, grid)
    large = blocked.where("nb > 1").drop("nb", "b")
    if large.isEmpty():
        return out
    for metric in dict.fromkeys(m for _, _, m in grid):
        cells = [(i, least, samples) for i, (least, samples, m) in enumerate(grid) if m == metric]
        options = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(c).alias("min_cluster_size"), F.lit(s).alias("min_samples")) for i, c, s in cells])
        copied = large.withColumn("o", F.explode(options)).select(*group, "id", "n", "idx", "w", "o.*")
        # one tree per number of samples, then cut for every cell
        per_tree = copied.dropDuplicates([*group, "id", "min_samples"]).drop("cell", "min_cluster_size")
        trees = cut_lineage(spanning_trees(per_tree, [*group, "min_samples"], metric, settings))
        cell_table = rows.sparkSession.createDataFrame(cells, "cell int, min_cluster_size int, min_samples int")
        each = trees.join(cell_table, "min_samples")
        labels = cut_tree_labels(each, copied, [*group, "cell"])
        labelled = cut_lineage(large.join(labels, [*group, "id"]))
        several = labelled.groupBy(*group, "cell").agg(F.count_distinct("cluster").alias("_c")).where("_c > 1").select(*group, "cell")
        # the search takes noise for one more cluster, the silhouette operator leaves negative labels out
        scored = labelled.join(several, [*group, "cell"], "left_semi").withColumn("cluster", F.col("cluster") + 1)
        out = out.unionByName(silhouette(scored, [*group, "cell"], settings))
    return out


def search_hierarchy(
    rows: DataFrame, group: Sequence[str] = (KEY,), grid: Sequence[tuple[int, int, str]] = SEARCH_GRID, settings: Settings = Settings()
) -> DataFrame:
    """(group, min_cluster_size, min_samples, metric, score): the cell of the grid with the best silhouette per group; a tie
    goes to the earlier cell, groups without a cell of several labels are left out."""
    best = F.max_by(F.struct("cell", "silhouette"), F.struct("silhouette", (-F.col("cell")).alias("_o")))
    chosen = search_scores(rows, group, grid, settings).groupBy(*group).agg(best.alias("_b"))
    options = F.array(*[F.struct(F.lit(c).alias("least"), F.lit(s).alias("samples"), F.lit(m).alias("metric")) for c, s, m in grid])
    option = F.get(options, F.col("_b.cell"))
    return chosen.select(
        *group, option["least"].alias("min_cluster_size"), option["samples"].alias("min_samples"), option["metric"].alias("metric"),
        F.col("_b.silhouette").alias("score"),
    )
