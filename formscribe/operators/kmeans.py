"""K-means for all groups at once, on rows (group, id, n, idx, w)."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.blocks import add_blocks, block_counts, constants, group_schema, map_groups, numbers, sparse_rows, strings
from formscribe.operators.profile import KEY
from formscribe.session import cut_lineage


def fit_centres(rows: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Weighted Lloyd iterations from farthest-point seeds; deterministic for a given row order."""
    middle = np.average(rows, axis=0, weights=weights)
    seeds = [int(((rows - middle) ** 2).sum(1).argmin())]
    gap = ((rows - rows[seeds[0]]) ** 2).sum(1)
    while len(seeds) < k and gap.max() > 0:
        seeds.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[seeds[-1]]) ** 2).sum(1))
    centres = rows[seeds].copy()
    labels = None
    for _ in range(rounds):
        now = nearest(rows, centres)
        if labels is not None and (now == labels).all():
            break
        labels = now
        sums, mass = cluster_sums(rows, weights, labels, len(centres))
        filled = mass > 0
        centres[filled] = sums[filled] / mass[filled, None]
    return centres


def cluster_sums(rows: np.ndarray, weights: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums and weight of each of k clusters; rows are added one after the other."""
    mass = np.bincount(labels, weights=weights, minlength=k)
    if k > rows.shape[1] > 1:
        return np.stack([np.bincount(labels, weights=column * weights, minlength=k) for column in rows.T], axis=1), mass
    sums = np.zeros((k, rows.shape[1]))
    for c in np.unique(labels):
        mine = labels == c
        sums[c] = (rows[mine] * weights[mine, None]).sum(axis=0)
    return sums, mass


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (centres * centres).sum(1)[None, :] - 2.0 * (rows @ centres.T)
    return squares.argmin(axis=1)


def seed_centres(rows: DataFrame, group: Sequence[str], k: str, settings: Settings, whole: bool = False) -> DataFrame:
    """At most k starting centres (group, cluster, idx, w) per group, from all of its rows.

    Each block is reduced to its own k centres, weighted by the rows nearest to them; those are rows of the next level,
    until a group is one block. Every level divides the rows by the block size over k.
    """
    group = list(group)
    most = rows.agg(F.max(k)).first()[0] or 1
    size = max(settings.block_rows, 4 * int(most))

    def kernel(table: pa.Table) -> pa.Table:
        order = np.argsort(strings(table, "id"), kind="stable")
        table = table.take(pa.array(order))
        dense, weight = sparse_rows(table), numbers(table, "n").astype(float)
        centres = fit_centres(dense, weight, int(numbers(table, k)[0]))
        centres = centres[np.lexsort(centres.T[::-1])]
        mass = np.bincount(nearest(dense, centres), weights=weight, minlength=len(centres))
        entries = [np.arange(len(c)) if whole else np.flatnonzero(c) for c in centres]
        block = int(numbers(table, "b")[0])
        return pa.table(
            {
                **constants(table, kept, len(centres)),
                "id": pa.array([f"{block:09d}-{i:06d}" for i in range(len(centres))]),
                "n": pa.array(np.maximum(mass, 1).astype(np.int64)),
                "idx": pa.array([e.astype(np.int32) for e in entries], pa.list_(pa.int32())),
                "w": pa.array([c[e] for c, e in zip(centres, entries)], pa.list_(pa.float64())),
            }
        )

    # the wanted number may be one of the group columns
    kept = [*group, *([] if k in group else [k])]
    schema = group_schema(rows, kept, "id string, n bigint, idx array<int>, w array<double>")
    current = rows.select(*dict.fromkeys([*group, "id", "n", k, "idx", "w"]))
    while True:
        blocked = add_blocks(current, group, "id", size)
        blocks = blocked.agg(F.max("nb")).first()[0]
        # few rows are dealt once more, so that the checkpoint's second job finds them and does not fit again
        current = cut_lineage(map_groups(blocked.drop("nb"), [*group, "b"], kernel, schema).repartition(*group, "id"))
        if blocks is None or blocks <= 1:
            return current.select(*group, F.substring("id", 11, 6).cast("int").alias("cluster"), "idx", "w")


def _packed(blocked: DataFrame, group: list[str]) -> DataFrame:
    """(group, b, n, sizes, idx, w): a block of rows as one row, their entries end to end."""

    def kernel(table: pa.Table) -> pa.Table:
        idx, w = pa.concat_arrays(table.column("idx").chunks), pa.concat_arrays(table.column("w").chunks)
        sizes = np.diff(idx.offsets.to_numpy()).astype(np.int32)
        return pa.table(
            {
                **constants(table, [*group, "b"], 1),
                "n": pa.array([numbers(table, "n").astype(float)], pa.list_(pa.float64())),
                "sizes": pa.array([sizes], pa.list_(pa.int32())),
                "idx": pa.ListArray.from_arrays(pa.array([0, sizes.sum()], pa.int32()), idx.flatten()),
                "w": pa.ListArray.from_arrays(pa.array([0, sizes.sum()], pa.int32()), w.flatten()),
            }
        )

    rows = blocked.select(*group, "b", "n", "idx", F.col("w").cast("array<double>").alias("w"))
    return map_groups(rows, [*group, "b"], kernel, group_schema(blocked, group, "b int, n array<double>, sizes array<int>, idx array<int>, w array<double>"))


def _moved(packed: DataFrame, centres: DataFrame, group: list[str], whole: bool) -> DataFrame:
    """One Lloyd round over all rows: centres (group, nb, cluster, idx, w) as the means of their rows, and `moved`.

    `packed` has the rows of each block in one row (`_packed`), and a group has `nb` blocks. Blocks send a weighted sum per
    cluster and entry; a centre without rows stays where it is.
    """
    # at most k centres per group
    every = F.array_sort(F.collect_list(F.struct("cluster", "idx", "w")))
    spread = centres.groupBy(*group, "nb").agg(every.alias("c")).select(
        *group,
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"),
        F.transform("c", lambda c: c["cluster"]).alias("c"),
        F.transform("c", lambda c: F.size(c["idx"])).alias("sizes"),
        F.flatten(F.transform("c", lambda c: c["idx"])).alias("idx"),
        F.flatten(F.transform("c", lambda c: c["w"])).alias("w"),
    )
    columns = [*group, "b", "c", "n", "sizes", "idx", "w"]
    both = packed.withColumn("c", F.lit(None).cast("array<int>")).select(*columns).unionByName(
        spread.withColumn("n", F.lit(None).cast("array<double>")).select(*columns)
    )

    def kernel(table: pa.Table) -> pa.Table | None:
        is_centre = table.column("n").is_null().to_numpy()
        # a block may be empty
        if is_centre.all():
            return None
        at, to = int(np.flatnonzero(~is_centre)[0]), int(np.flatnonzero(is_centre)[0])
        part = {name: [table.column(name)[i].values for i in (at, to)] for name in ("sizes", "idx", "w")}
        sizes, idx, w = (np.concatenate([x.to_numpy() for x in part[name]]) for name in ("sizes", "idx", "w"))
        dense = np.zeros((len(sizes), int(idx.max()) + 1 if len(idx) else 1))
        dense[np.repeat(np.arange(len(sizes)), sizes), idx] = w
        names, n = table.column("c")[to].values.to_numpy(), table.column("n")[at].values.to_numpy()
        x, m = dense[: len(n)], dense[len(n) :]
        label = nearest(x, m)
        present = np.unique(label)
        sums, mass = cluster_sums(x, n, label, len(m))
        entries = [np.arange(len(r)) if whole else np.flatnonzero(r) for r in sums[present]]
        return pa.table(
            {
                **constants(table, group, len(present)),
                "cluster": pa.array(names[present].astype(np.int32)),
                "n": pa.array(mass[present]),
                "idx": pa.array([e.astype(np.int32) for e in entries], pa.list_(pa.int32())),
                "w": pa.array([r[e] for r, e in zip(sums[present], entries)], pa.list_(pa.float64())),
            }
        )

    key = [*group, "cluster"]
    parts = map_groups(both, [*group, "b"], kernel, group_schema(packed, group, "cluster int, n double, idx array<int>, w array<double>"))
    # the weight goes along as entry -1
    pieces = F.concat(F.array(F.struct(F.lit(-1).alias("idx"), F.col("n").alias("w"))), F.arrays_zip("idx", "w"))
    entries = parts.select(*key, F.explode(pieces).alias("e")).groupBy(*key, F.col("e.idx").alias("i")).agg(F.sum("e.w").alias("s"))
    gone = {"i": "int", "s": "double", "nb": "int", "idx": "array<int>", "w": "array<double>"}

    def filled(df: DataFrame) -> DataFrame:
        return df.select(*key, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in gone.items()])

    together = filled(entries).unionByName(filled(centres)).groupBy(*key).agg(
        # one entry per term or dimension of the group
        F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "s")))).alias("e"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("nb", "idx", "w")],
    )
    # sums of blocks may arrive in any order; the last digits are cut off
    means = F.transform(F.slice("e", 2, F.size("e")), lambda x: F.round(x["s"] / F.col("e")[0]["s"], 12))
    sized = together.withColumns(
        {"m_idx": F.when(F.size("e") > 0, F.transform(F.slice("e", 2, F.size("e")), lambda x: x["i"])), "m_w": F.when(F.size("e") > 0, means)}
    )
    return sized.select(
        *group,
        "nb",
        "cluster",
        F.coalesce("m_idx", "idx").alias("idx"),
        F.coalesce("m_w", "w").alias("w"),
        (F.col("m_w").isNotNull() & ((F.col("m_w") != F.col("w")) | (F.col("m_idx") != F.col("idx")))).alias("moved"),
    )


def _nearest_gaps(rows: DataFrame, centres: DataFrame, group: list[str], settings: Settings) -> DataFrame:
    """(group, id, n, cluster, gap): the nearest centre of every row and the squared distance to it."""
    blocked = add_blocks(rows.select(*group, "id", "n", "idx", "w"), group, "id", settings.block_rows)
    places = blocked.select(*group, "b").distinct()
    spread = centres.join(places, group).select(*group, "b", F.col("cluster").alias("c"), F.lit("").alias("id"), F.lit(0).cast("long").alias("n"), "idx", "w")
    both = blocked.select(*group, "b", F.lit(-1).alias("c"), "id", F.col("n").cast("long").alias("n"), "idx", "w").unionByName(spread)

    def kernel(table: pa.Table) -> pa.Table | None:
        c, dense = numbers(table, "c"), sparse_rows(table)
        is_centre = c >= 0
        order = np.argsort(c[is_centre])
        x, m = dense[~is_centre], dense[is_centre][order]
        label = nearest(x, m)
        return pa.table(
            {
                **constants(table, group, len(x)),
                "id": pa.array(strings(table, "id")[~is_centre]),
                "n": pa.array(numbers(table, "n")[~is_centre].astype(np.int64)),
                "cluster": pa.array(c[is_centre][order][label].astype(np.int32)),
                "gap": pa.array(((x - m[label]) ** 2).sum(1)),
            }
        )

    return map_groups(both, [*group, "b"], kernel, group_schema(rows, group, "id string, n long, cluster int, gap double"))


#: Rounds of drawing, and rows drawn in a round for each wanted centre, about.
DRAW_ROUNDS, DRAWN = 4, 2


def drawn_centres(rows: DataFrame, group: Sequence[str], k: str, settings: Settings = Settings()) -> DataFrame:
    """At most k starting centres (group, cluster, idx, w) per group, drawn from all of its rows.

    From one row on, every round draws rows with a chance in proportion to their squared distance from what is drawn so
    far, about `DRAWN` times k of them. The candidates, weighted by the rows nearest to them, are then reduced to k. Draws
    follow from group, id and seed, so they are the same whatever the partitions. Rounds are passes in blocks; a group has
    some `DRAW_ROUNDS * DRAWN * k` candidates however many rows it has.
    """
    group = list(group)
    rows = cut_lineage(rows.select(*dict.fromkeys([*group, "id", "n", k, "idx", "w"])))

    def chance(salt: int) -> Column:
        named = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]
        return F.pmod(F.xxhash64(*named, F.col("id"), F.lit(settings.seed), F.lit(salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))

    first = rows.groupBy(*group).agg(F.min_by("id", F.struct(chance(0).alias("u"), "id")).alias("id"))
    chosen = first
    numbered = Window.partitionBy(*group).orderBy("id")

    def candidates() -> DataFrame:
        return rows.join(chosen, [*group, "id"]).withColumn("cluster", F.row_number().over(numbered) - 1)

    for turn in range(1, DRAW_ROUNDS + 1):
        gaps = cut_lineage(_nearest_gaps(rows, candidates(), group, settings))
        total = gaps.groupBy(*group).agg(F.sum(F.col("n") * F.col("gap")).alias("total")).where("total > 0")
        wanted = rows.select(*dict.fromkeys([*group, "id", k])).join(gaps, [*group, "id"]).join(total, group)
        drawn = wanted.where(chance(turn) * F.col("total") < F.col("n") * F.col("gap") * F.col(k) * DRAWN).select(*group, "id")
        chosen = cut_lineage(chosen.unionByName(drawn).distinct())
    mass = _nearest_gaps(rows, candidates(), group, settings).groupBy(*group, "cluster").agg(F.sum("n").alias("mass"))
    weighted = candidates().drop("n").join(mass, [*group, "cluster"]).withColumnRenamed("mass", "n")

    def kernel(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(strings(table, "id"), kind="stable")))
        centres = fit_centres(sparse_rows(table), numbers(table, "n").astype(float), int(numbers(table, k)[0]))
        centres = centres[np.lexsort(centres.T[::-1])]
        entries = [np.flatnonzero(c) for c in centres]
        return pa.table(
            {
                **constants(table, group, len(centres)),
                "cluster": pa.array(np.arange(len(centres), dtype=np.int32)),
                "idx": pa.array([e.astype(np.int32) for e in entries], pa.list_(pa.int32())),
                "w": pa.array([c[e] for c, e in zip(centres, entries)], pa.list_(pa.float64())),
            }
        )

    return map_groups(weighted, group, kernel, group_schema(rows, group, "cluster int, idx array<int>, w array<double>"))


def _rounds(rows: DataFrame, centres: DataFrame, group: list[str], whole: bool, settings: Settings) -> DataFrame:
    """Lloyd rounds until no centre moves, `kmeans_rounds` at most. Rows are packed into their blocks once, not in every round."""
    rows = rows.select(*group, "id", "n", "idx", "w")
    packed = cut_lineage(_packed(add_blocks(rows, group, "id", settings.block_rows), group))
    centres = cut_lineage(centres.join(block_counts(rows, group, settings.block_rows), group))
    for _ in range(settings.kmeans_rounds):
        moved = cut_lineage(_moved(packed, centres, group, whole))
        centres = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return centres.drop("nb")


def centre_costs(rows: DataFrame, centres: DataFrame, group: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """(group, cost): the sum of squared distances of all occurrences to their nearest centre."""
    group = list(group)
    return _nearest_gaps(rows, centres, group, settings).groupBy(*group).agg(F.sum(F.col("n") * F.col("gap")).alias("cost"))


def train_starts(
    rows: DataFrame, group: Sequence[str] = (KEY,), k: str = "k", whole: bool = False, settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """Centres (group, start, cluster, idx, w) of `kmeans_starts` runs and their costs (group, start, cost).

    The start is one more group column, so all runs take the same rounds at once. Start 0 begins with `seed_centres`, the
    others with `drawn_centres`.
    """
    group, per_start = list(group), [*group, "start"]
    rows = rows.select(*dict.fromkeys([*group, "id", "n", k, "idx", "w"]))
    begun = seed_centres(rows, group, k, settings, whole).withColumn("start", F.lit(0))
    copied = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(settings.kmeans_starts - 1))))
    copied = cut_lineage(copied)
    if settings.kmeans_starts > 1:
        begun = begun.unionByName(drawn_centres(copied.where("start > 0"), per_start, k, settings).select(*begun.columns))
    centres = _rounds(copied, cut_lineage(begun), per_start, whole, settings)
    return centres, centre_costs(copied, centres, per_start, settings)


def train_centres(
    rows: DataFrame, group: Sequence[str] = (KEY,), k: str = "k", whole: bool = False, settings: Settings = Settings()
) -> DataFrame:
    """Centres (group, cluster, idx, w) by Lloyd rounds over all rows.

    A round is one pass in blocks; the loop ends when no centre moves, or after `kmeans_rounds`. With several
    `kmeans_starts` the cheapest run is taken, the earlier one of equal runs. With `whole` the arrays also keep zero
    entries, so that w is the dense centre of rows that have all entries.
    """
    group = list(group)
    if settings.kmeans_starts <= 1:
        return _rounds(rows, seed_centres(rows, group, k, settings, whole), group, whole, settings)
    centres, costs = train_starts(rows, group, k, whole, settings)
    best = costs.groupBy(*group).agg(F.min_by("start", F.struct("cost", "start")).alias("start"))
    return cut_lineage(centres.join(best, [*group, "start"]).drop("start"))


def assign_centres(
    rows: DataFrame, centres: DataFrame, group: Sequence[str] = (KEY,), settings: Settings = Settings()
) -> DataFrame:
    """(group, id, cluster) for every row. Centres are few per group and go to each of its blocks."""
    group = list(group)
    blocked = add_blocks(rows, group, "id", settings.block_rows)
    places = blocked.select(*group, "b").distinct()
    spread = centres.join(places, group).select(*group, "b", F.col("cluster").alias("c"), F.lit("").alias("id"), "idx", "w")
    both = blocked.select(*group, "b", F.lit(-1).alias("c"), "id", "idx", "w").unionByName(spread)

    def kernel(table: pa.Table) -> pa.Table | None:
        c = numbers(table, "c")
        dense = sparse_rows(table)
        is_centre = c >= 0
        order = np.argsort(c[is_centre])
        labels = c[is_centre][order][nearest(dense[~is_centre], dense[is_centre][order])]
        return pa.table(
            {
                **constants(table, group, len(labels)),
                "id": pa.array(strings(table, "id")[~is_centre]),
                "cluster": pa.array(labels.astype(np.int32)),
            }
        )

    return map_groups(both, [*group, "b"], kernel, group_schema(rows, group, "id string, cluster int"))


def kmeans_labels(
    rows: DataFrame, group: Sequence[str] = (KEY,), k: str = "k", settings: Settings = Settings()
) -> DataFrame:
    """(group, id, cluster) with the column `k` as the wanted number of clusters of the group."""
    rows = cut_lineage(rows)
    return assign_centres(rows, train_centres(rows, group, k, settings=settings), group, settings)
