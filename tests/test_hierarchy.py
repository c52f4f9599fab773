"""The density hierarchy against a plain-Python version that cuts the whole distance graph level by level."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators import hierarchy
from formscribe.operators.profile import KEY

SCHEMA = f"{KEY} string, id string, n int, idx array<int>, w array<double>"


def blobs(seed, sizes, dim=3, noise=6):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-20, 20, dim), 0.3 + i, (n, dim)) for i, n in enumerate(sizes)]
    points = np.concatenate([*parts, rng.uniform(-30, 30, (noise, dim))])
    return points[rng.permutation(len(points))]


def table(spark, points, key="k", counts=None):
    rows = [(key, f"{i:04d}", int(counts[i]) if counts is not None else 1, list(range(points.shape[1])), [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def distance(a, b, metric):
    if metric == "manhattan":
        return sum(abs(x - y) for x, y in zip(a, b))
    if metric == "cosine":
        return 1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    return sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5


def plain_labels(points, metric, min_samples, least):
    """Sets of row numbers: the clusters that a full hierarchy of components takes."""
    size = len(points)
    d = [[distance(a, b, metric) if i != j else 0.0 for j, b in enumerate(points)] for i, a in enumerate(points)]
    core = [sorted(row)[min(min_samples, size) - 1] for row in d]
    far = [[max(d[i][j], core[i], core[j]) for j in range(size)] for i in range(size)]

    def parts(rows, below):
        rows, out = set(rows), []
        while rows:
            todo, part = [rows.pop()], set()
            while todo:
                x = todo.pop()
                part.add(x)
                near = {y for y in rows if far[x][y] < below}
                rows -= near
                todo += near
            out.append(part)
        return out

    def best(rows, born, top):
        """(stability, taken sets) of the cluster that begins with these rows."""
        alive, total = set(rows), 0.0
        while True:
            levels = sorted({far[x][y] for x in alive for y in alive if x < y}, reverse=True)
            for level in levels:
                split = parts(alive, level)
                if len(split) > 1:
                    break
            else:
                return total + sum(1 / max(core[x], 1e-9) - born for x in alive), [set(rows)]
            big = [p for p in split if len(p) >= least]
            if len(big) > 1:
                total += len(alive) * (1 / level - born)
                below = [best(p, 1 / level, False) for p in big]
                inner = sum(b[0] for b in below)
                if top or inner > total:
                    return inner, [s for b in below for s in b[1]]
                return total, [set(rows)]
            kept = big[0] if big else set()
            total += (len(alive) - len(kept)) * (1 / level - born)
            alive = kept
            if not alive:
                return total, [] if top else [set(rows)]

    stability, taken = best(range(size), 0.0, True)
    return [] if taken == [set(range(size))] else taken


@pytest.mark.parametrize("metric", hierarchy.METRICS)
@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_plain_python(spark, metric, seed):
    points = blobs(seed, (12, 9, 20))
    settings = Settings(min_samples=3, min_cluster_size=5)
    got = hierarchy.hierarchy_labels(table(spark, points), metric=metric, settings=settings).collect()
    found = {}
    for r in got:
        if r.cluster >= 0:
            found.setdefault(r.cluster, set()).add(int(r.id))
        assert (r.strength == 0) == (r.cluster < 0) and 0 <= r.strength <= 1
    want = plain_labels(points.tolist(), metric, 3, 5)
    assert len(want) >= 2 and sorted(map(sorted, found.values())) == sorted(map(sorted, want))


@pytest.mark.parametrize("metric", hierarchy.METRICS)
def test_blocks_do_not_change_the_tree(spark, metric):
    points = blobs(5, (15, 25, 10))
    whole = Settings(min_samples=2, min_cluster_size=4)
    cut = Settings(min_samples=2, min_cluster_size=4, block_rows=16)
    both = table(spark, points).unionByName(table(spark, points[:7], "few"))
    edges = [sorted(map(tuple, hierarchy.spanning_trees(both.selectExpr("*", "2 as min_samples"), [KEY], metric, s).collect()), key=str) for s in (whole, cut)]
    assert edges[0] == edges[1] and len(edges[0]) == 2 * (56 + 7) - 2
    labels = [sorted(map(tuple, hierarchy.hierarchy_labels(both, metric=metric, settings=s).collect())) for s in (whole, cut)]
    assert labels[0] == labels[1]


def test_occurrences_count_like_copies(spark):
    rng = random.Random(4)
    points = blobs(7, (14, 18))
    counts = [rng.choice((1, 1, 2, 3)) for _ in points]
    settings = Settings(min_samples=3, min_cluster_size=6)
    once = {r.id: r.cluster for r in hierarchy.hierarchy_labels(table(spark, points, counts=counts), settings=settings).collect()}
    owner = np.repeat(np.arange(len(points)), counts)
    copies = hierarchy.hierarchy_labels(table(spark, points[owner]), settings=settings).collect()
    each = {}
    for r in copies:
        each.setdefault(f"{owner[int(r.id)]:04d}", set()).add(r.cluster)
    assert max(once.values()) >= 1
    groups = lambda labels: sorted(sorted(i for i in labels if labels[i] == c) for c in set(labels.values()))
    assert groups(once) == groups({i: min(c) for i, c in each.items()}) and all(len(c) == 1 for c in each.values())


def test_small_and_empty_groups(spark):
    points = np.array([[0.0, 1.0], [0.0, 1.0], [5.0, 5.0]])
    few = table(spark, points, "few").unionByName(table(spark, points[:1], "one"))
    got = hierarchy.hierarchy_labels(few).collect()
    assert len(got) == 4 and {r.cluster for r in got} == {-1}
    assert hierarchy.hierarchy_labels(few.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unknown metric"):
        hierarchy.hierarchy_labels(few, metric="hamming")


def test_no_distance_has_to_be_chosen(spark):
    """A dense and a wide cluster: no single cut keeps both, the hierarchy does."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.05, (30, 2)), rng.normal(40, 6, (30, 2)), rng.normal(0.8, 0.05, (30, 2))])
    got = {int(r.id): r.cluster for r in hierarchy.hierarchy_labels(table(spark, points), settings=Settings(min_samples=3, min_cluster_size=8)).collect()}
    kinds = [{got[i] for i in part} - {-1} for part in (range(30), range(30, 60), range(60, 90))]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == 3


def test_search_over_the_grid(spark):
    """Every cell as the labels and the silhouette operator give it, in one block and in many."""
    from formscribe.operators.silhouette import silhouette

    both = table(spark, blobs(9, (12, 16, 9)), "a").unionByName(table(spark, blobs(10, (20, 8)), "b"))
    grid = [(3, 1, "euclidean"), (5, 2, "cosine"), (200, 1, "euclidean")]
    scores = [{(r[KEY], r.cell): r.silhouette for r in hierarchy.search_scores(both, grid=grid, settings=s).collect()} for s in (Settings(), Settings(block_rows=16))]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][x] - scores[1][x]) < 1e-9 for x in scores[0])
    assert not any(cell == 2 for _, cell in scores[0]) and len(scores[0]) >= 3
    for cell, (least, samples, metric) in enumerate(grid[:2]):
        labels = hierarchy.hierarchy_labels(both, metric=metric, settings=Settings(min_samples=samples, min_cluster_size=least))
        for r in silhouette(both.join(labels, [KEY, "id"]).withColumn("cluster", F.col("cluster") + 1)).collect():
            if (r[KEY], cell) in scores[0]:
                assert abs(r.silhouette - scores[0][r[KEY], cell]) < 1e-9
    best = {r[KEY]: r.score for r in hierarchy.search_hierarchy(both, grid=grid).collect()}
    assert all(abs(best[k] - max(v for (a, _), v in scores[0].items() if a == k)) < 1e-9 for k in best)


def test_starts_never_cost_more(spark):
    from formscribe.operators import kmeans

    rows = table(spark, blobs(11, (20, 20, 20, 20)), "a").unionByName(table(spark, blobs(12, (5, 40)), "b")).selectExpr("*", "4 as k")
    for block_rows in (24,):
        settings = Settings(kmeans_starts=4, block_rows=block_rows)
        _, costs = kmeans.train_starts(rows, settings=settings)
        by = {}
        for r in costs.collect():
            by.setdefault(r[KEY], {})[r.start] = r.cost
        kept = {r[KEY]: r.cost for r in kmeans.centre_costs(rows, kmeans.train_centres(rows, settings=settings), [KEY]).collect()}
        assert set(kept) == {"a", "b"} and all(set(c) == {0, 1, 2, 3} and kept[key] <= min(c.values()) + 1e-9 for key, c in by.items())
        again = kmeans.train_starts(rows.repartition(3), settings=settings)[1].collect()
        assert {(r[KEY], r.start, round(r.cost, 6)) for r in again} == {(key, s, round(c, 6)) for key, cs in by.items() for s, c in cs.items()}
    few = table(spark, np.array([[1.0], [1.0], [2.0]])).selectExpr("*", "3 as k")
    assert kmeans.centre_costs(few, kmeans.train_centres(few, settings=Settings(kmeans_starts=3)), [KEY]).first().cost == 0
