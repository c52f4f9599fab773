"""Exact neighbour search and similar pairs within keys."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.blocks import (
    block_of,
    block_pairs,
    map_groups,
    matrix,
    numbers,
    pair_counts,
    strings,
    tiles,
    unit_rows,
)
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import top_per_group
from formscribe.operators.vectors import Encoder, embed_column, value_id, with_vectors
from formscribe.session import cut_lineage

_METRICS = {"cosine": "cosine", "l2": "l2", "euclidean": "l2"}


#: Rows of the one and of the other block that are compared at a time.
TILE_ROWS, TILE_COLUMNS = 512, 2048
#: Blocks of a group's queries, at most, as long as they hold no more rows than `PAIR_ROWS`.
ASKING_BLOCKS = 16


def similarities(queries: np.ndarray, stored: np.ndarray, metric: str) -> np.ndarray:
    """Cosine of unit rows, or 1 / (1 + squared distance)."""
    if metric == "cosine":
        return queries @ stored.T
    squares = (queries * queries).sum(1)[:, None] + (stored * stored).sum(1)[None, :] - 2.0 * (queries @ stored.T)
    return 1.0 / (1.0 + np.maximum(squares, 0.0))


def metric_name(metric: str) -> str:
    if metric not in _METRICS:
        raise ValueError(f"metric must be one of {sorted(_METRICS)}")
    return _METRICS[metric]


def best_columns(
    score: Callable[[slice, slice], np.ndarray],
    ask_ids: np.ndarray,
    ids: np.ndarray,
    k: int,
    threshold: float | None,
    skip_same_id: bool,
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    margin: float = 0.0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best finite scores of each row, ties to the smaller id.

    `score` gives a tile of the scores, whose columns are in the order of `ids`, sorted. Of each tile only scores that reach
    a row's k-th best so far are looked at again, and these are cut back to k when they have doubled. With `exact`, the tiles
    may be off by `margin` and only choose what is scored by `exact(rows, columns)`.
    """
    first, last = np.searchsorted(ids, ask_ids, "left"), np.searchsorted(ids, ask_ids, "right")
    found = []
    for mine in tiles(len(ask_ids), TILE_ROWS):
        n = mine.stop - mine.start
        floor = np.full(n, -np.inf if threshold is None else threshold)
        kept, fresh, held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), [], 0
        for theirs in tiles(len(ids), TILE_COLUMNS):
            scores = score(mine, theirs)
            if skip_same_id:
                begin, end = np.maximum(first[mine], theirs.start), np.minimum(last[mine], theirs.stop)
                for i in np.flatnonzero(begin < end):
                    scores[i, begin[i] - theirs.start : end[i] - theirs.start] = -np.inf
            if theirs.start == 0 and k < scores.shape[1]:
                # the k-th best of some columns is a bound for all; NaN would sort as the largest
                some = scores[:, : max(16 * k, 256)]
                some = np.where(np.isnan(some), -np.inf, some)
                if k < some.shape[1]:
                    floor = np.maximum(floor, np.partition(some, -k, axis=1)[:, -k].astype(float) - margin)
            place = np.flatnonzero(scores >= (floor - margin).astype(scores.dtype)[:, None])
            row, column = np.divmod(place, scores.shape[1])
            s = scores.ravel()[place].astype(float)
            real = np.isfinite(s)
            row, column, s = row[real], column[real] + theirs.start, s[real]
            if exact is not None and len(s):
                s = exact(row + mine.start, column)
                real = np.isfinite(s) & (s >= floor[row])
                row, column, s = row[real], column[real], s[real]
            fresh.append((row, column, s))
            held += len(s)
            if held > len(kept[0]) or theirs.stop == len(ids):
                kept, fresh, held = _best_of([kept, *fresh], k), [], 0
                r, _, s = kept
                full = np.arange(len(r)) - np.searchsorted(r, r, "left") == k - 1
                floor[r[full]] = s[full]
        found.append((kept[0] + mine.start, *kept[1:]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _best_of(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row, best first. Where scores of a row are equal, columns come in ascending order."""
    r, c, s = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(-s, kind="stable")
    # rows of a tile fit into 16 bits, which are sorted without comparing
    order = order[np.argsort(r[order].astype(np.int16), kind="stable")]
    r, c, s = r[order], c[order], s[order]
    best = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
    return r[best], c[best], s[best]


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = Settings.top_k,
    metric: str = "cosine",
    threshold: float | None = None,
    skip_same_id: bool = False,
    settings: Settings = Settings(),
    group: tuple[str, ...] = (KEY,),
) -> DataFrame:
    """The k most similar stored vectors of the same key for every query (composite_key, id, vec).

    Exact. Query and candidate blocks meet pairwise, in tiles; each meeting keeps at most k rows per query, and the
    partial lists are merged. Keys without stored vectors give no rows; rows without a vector neither ask nor answer.
    """
    kind = metric_name(metric)
    queries, vectors = with_vectors(queries), with_vectors(vectors)
    group = tuple(group)
    # one row per key that has both queries and stored vectors
    # a query has a partial list per block of candidates, so these are fewer
    counts = pair_counts(vectors, group, settings.block_rows, "c", most=2).join(
        pair_counts(queries, group, settings.block_rows, "q", most=ASKING_BLOCKS), list(group)
    )
    asked = queries.select(*group, "id", "vec").join(counts, list(group)).withColumn("qb", block_of("id", "qnb"))
    left = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("cnb") - 1)))
    stored = vectors.select(*group, "id", "vec").join(counts, list(group)).withColumn("cb", block_of("id", "cnb"))
    right = stored.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qnb") - 1)))
    columns = [*group, "id", "vec", "qb", "cb"]
    both = left.select(*columns, F.lit(True).alias("asks")).unionByName(right.select(*columns, F.lit(False).alias("asks")))
    names = list(group)

    def kernel(table: pa.Table) -> pa.Table | None:
        asks = numbers(table, "asks").astype(bool)
        if asks.all() or not asks.any():
            return None
        ids, rows = strings(table, "id"), matrix(table.column("vec"))
        if kind == "cosine":
            rows = unit_rows(rows)
        order = np.argsort(ids[~asks], kind="stable")
        ask_ids, stored_ids, asked, stored = ids[asks], ids[~asks][order], rows[asks], rows[~asks][order]
        exact, margin, left, right = None, 0.0, asked, stored
        if kind == "cosine" and len(stored) > TILE_COLUMNS:
            # products of unit rows in 32 bits are off by less than this
            margin = (asked.shape[1] + 8) * float(np.finfo(np.float32).eps)
            left, right = asked.astype(np.float32), stored.astype(np.float32)

            def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
                return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", asked[r[p]], stored[c[p]]) for p in tiles(len(r), 16 * TILE_COLUMNS))])

        r, c, scores = best_columns(
            lambda q, s: similarities(left[q], right[s], kind), ask_ids, stored_ids, k, threshold, skip_same_id, exact, margin
        )
        fixed = {g: pa.array([table.column(g)[0].as_py()] * len(r), table.schema.field(g).type) for g in names}
        return pa.table({**fixed, "query_id": pa.array(ask_ids[r]), "id": pa.array(stored_ids[c]), "similarity": scores})

    fields = {f.name: f.dataType.simpleString() for f in queries.schema}
    schema = ", ".join(f"{g} {fields[g]}" for g in group) + ", query_id string, id string, similarity double"
    partial = map_groups(both, [*group, "qb", "cb"], kernel, schema)
    return top_per_group(partial, [*group, "query_id"], [F.col("similarity").desc(), F.col("id")], k)


def similar_pairs(vectors: DataFrame, threshold: float = 0.8, settings: Settings = Settings()) -> DataFrame:
    """All pairs (id1 < id2) of one key with cosine >= threshold. Rows without a vector are in no pair.

    Exact: the blocks of a key meet pairwise, and only pairs above the threshold leave the task. The work grows with
    the square of a key; `similar_pairs_approx` is the form for keys of millions of vectors.
    """
    meeting = block_pairs(with_vectors(vectors).select(KEY, "id", "vec"), [KEY], "id", settings.block_rows, tiled=True)
    return _pairs_of(meeting, [KEY], threshold)


def _pairs_of(meeting: DataFrame, group: list[str], threshold: float) -> DataFrame:
    def kernel(table: pa.Table) -> pa.Table | None:
        block, ids = numbers(table, "b"), strings(table, "id")
        units = unit_rows(matrix(table.column("vec")))
        first = block == numbers(table, "lo")[0]
        same = numbers(table, "lo")[0] == numbers(table, "hi")[0]
        second = first if same else ~first
        left, right, found = units[first], units[second], []
        for rows in tiles(len(left), TILE_ROWS):
            for columns in tiles(len(right), TILE_COLUMNS):
                if same and columns.stop <= rows.start:
                    continue
                scores = left[rows] @ right[columns].T
                r, c = np.divmod(np.flatnonzero(scores >= threshold), scores.shape[1])
                if same:
                    once = r + rows.start < c + columns.start
                    r, c = r[once], c[once]
                found.append((r + rows.start, c + columns.start, scores[r, c]))
        r, c, scores = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        if not len(r):
            return None
        a, b = ids[first][r], ids[second][c]
        swap = a > b
        key = pa.array([table.column(KEY)[0].as_py()] * len(r), pa.string())
        return pa.table(
            {KEY: key, "id1": pa.array(np.where(swap, b, a)), "id2": pa.array(np.where(swap, a, b)), "similarity": scores}
        )

    return map_groups(meeting, [*group, "lo", "hi"], kernel, f"{KEY} string, id1 string, id2 string, similarity double")


def plane_bands(threshold: float, recall: float, bits: int) -> int:
    """Bands of `bits` random planes after which a pair at the threshold has shared one with the wanted recall."""
    agree = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - agree))))


def similar_pairs_approx(
    vectors: DataFrame, threshold: float = 0.8, recall: float = 0.95, bits: int = 8, settings: Settings = Settings()
) -> DataFrame:
    """Pairs of one key with cosine >= threshold, each found with probability `recall` or more.

    Every vector gets one code per band from the sides of random planes; rows of a key that share a band's code meet in
    blocks, and the exact cosine decides, so no wrong pair comes out. A row is moved once per band.
    """
    bands = plane_bands(threshold, recall, bits)
    seed = settings.seed

    @F.pandas_udf("array<long>")
    def codes(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        rows = np.stack([np.asarray(v, dtype=np.float64) for v in column])
        planes = np.random.default_rng(seed).normal(size=(rows.shape[1], bands * bits))
        sides = (rows @ planes > 0).reshape(len(rows), bands, bits)
        return pd.Series(list((sides << np.arange(bits)).sum(axis=2).astype(np.int64)))

    rows = with_vectors(vectors).select(KEY, "id", "vec")
    banded = rows.select(KEY, "id", "vec", F.posexplode(codes("vec")).alias("band", "code"))
    group = [KEY, "band", "code"]
    found = _pairs_of(block_pairs(banded, group, "id", settings.block_rows, at_least=2, tiled=True), group, threshold)
    # blocks of other shapes may differ in the last digits
    return found.groupBy(KEY, "id1", "id2").agg(F.max("similarity").alias("similarity"))


def duplicate_check(
    values: DataFrame,
    vectors: DataFrame,
    encoder: Callable[[], Encoder] | None = None,
    settings: Settings = Settings(),
    centres: DataFrame | None = None,
    on_error: str = "fail",
) -> DataFrame:
    """(key, normalised value) pairs with a stored neighbour at or above the threshold: best similarity and
    the first three examples.

    Each distinct text is encoded once and the vectors are stored, because the search reads them twice. With
    `centres`, `vectors` is a cell index and only the nearest cells are searched. An encoder that raises fails the job;
    with `on_error="status"` the values it failed on have no vector and are no duplicates.
    """
    asked = values.where(F.col("normalized").isNotNull()).select(KEY, "normalized").distinct()
    texts = asked.select("normalized").distinct().withColumn("vec", embed_column(F.col("normalized"), encoder, on_error=on_error))
    queries = asked.join(texts, "normalized").where(F.col("vec").isNotNull())
    queries = cut_lineage(queries.select(KEY, value_id(F.col("normalized")).alias("id"), "normalized", "vec"))
    limits = (settings.top_k, settings.similarity_threshold)
    if centres is None:
        found = search(queries, vectors, limits[0], settings.metric, limits[1], settings=settings)
    else:
        from formscribe.operators.ann import search_cells

        found = search_cells(queries, vectors, centres, *limits, settings=settings)
    return grouped_duplicates(found, queries, vectors)


def grouped_duplicates(found: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    named = found.where(F.col("rank") <= 3).join(vectors.select(KEY, "id", "value"), [KEY, "id"])
    grouped = named.groupBy(KEY, "query_id").agg(
        F.max("similarity").alias("similarity"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("nearest_examples"),
    )
    asked = queries.select(KEY, F.col("id").alias("query_id"), "normalized")
    return grouped.join(asked, [KEY, "query_id"]).select(KEY, "normalized", "similarity", "nearest_examples")
