"""Blocked group work: Spark cuts groups into blocks of bounded size, a task sees one block pair at a time.

Used where pairs inside a group have to be compared. No group is ever whole in one task, and only results
leave a task, never the compared pairs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Kernel = Callable[[pa.Table], "pa.Table | None"]

#: Where blocks meet pairwise, a row is moved once per block. A group has no more than so many blocks until one would hold
#: more than `PAIR_ROWS` rows; the kernels walk two blocks in tiles (`tiles`), so no task holds a block's square.
PAIR_BLOCKS, PAIR_ROWS = 6, 32768


def block_counts(df: DataFrame, group: Sequence[str], block_rows: int, prefix: str = "", at_least: int = 1) -> DataFrame:
    """(group, `<prefix>nb`): number of blocks of every group with `at_least` rows. Reads the group columns only."""
    count = F.count(F.lit(1))
    sizes = df.groupBy(*group).agg(F.ceil(count / block_rows).cast("int").alias(f"{prefix}nb"), count.alias("_n"))
    return sizes.where(F.col("_n") >= at_least).drop("_n")


def pair_counts(
    df: DataFrame, group: Sequence[str], block_rows: int, prefix: str = "", at_least: int = 1, most: int = PAIR_BLOCKS, rows: int = PAIR_ROWS
) -> DataFrame:
    """`block_counts` for blocks that meet pairwise in tiles: at most `most` blocks until one would hold more than `rows`, so
    that the moved rows grow with the input."""
    count = F.count(F.lit(1))
    few = F.least(F.ceil(count / block_rows), F.lit(most))
    blocks = F.greatest(few, F.ceil(count / max(block_rows, rows))).cast("int")
    return df.groupBy(*group).agg(blocks.alias(f"{prefix}nb"), count.alias("_n")).where(F.col("_n") >= at_least).drop("_n")


def add_blocks(
    df: DataFrame, group: Sequence[str], item: str, block_rows: int, prefix: str = "", at_least: int = 1
) -> DataFrame:
    """Adds `<prefix>nb`, the number of blocks of the row's group, and `<prefix>b`, the row's block. Groups of
    fewer than `at_least` rows are left out."""
    counts = block_counts(df, group, block_rows, prefix, at_least)
    return df.join(counts, list(group)).withColumn(f"{prefix}b", block_of(item, f"{prefix}nb"))


def block_of(item: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(item), F.col(blocks)).cast("int")


def block_pairs(
    df: DataFrame, group: Sequence[str], item: str, block_rows: int, at_least: int = 1, tiled: bool = False
) -> DataFrame:
    """Each row once per block pair (lo <= hi) that contains its block `b`. `tiled` is for kernels that walk a pair of
    blocks in tiles: blocks are few and large (`pair_counts`)."""
    counts = (pair_counts if tiled else block_counts)(df, group, block_rows, at_least=at_least)
    blocked = df.join(counts, list(group)).withColumn("b", block_of(item, "nb"))
    paired = blocked.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return paired.withColumns({"lo": F.least("b", "_x"), "hi": F.greatest("b", "_x")}).drop("_x", "nb")


def map_groups(df: DataFrame, group: Sequence[str], kernel: Kernel, schema: str | StructType, order: Sequence[str] = ()) -> DataFrame:
    """Apply `kernel` to the rows of every group; groups must be of bounded size.

    Rows arrive sorted by group in Arrow batches, so many small groups share one batch and no group pays for
    its own transfer. The partition count is left to the session, so that adaptive execution can merge small
    partitions without ever splitting a group.
    """
    group = list(group)
    arranged = df.repartition(*group).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, group):
            result = kernel(table)
            if result is not None and result.num_rows:
                yield from result.to_batches()

    return arranged.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], group: Sequence[str]) -> Iterator[pa.Table]:
    """Contiguous groups of a sorted stream; a group may span batches."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(g).to_numpy() for g in group]
        change = np.zeros(table.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for begin, end in zip(starts[:-1], starts[1:]):
            if end == begin:
                continue
            key = tuple(c[begin] for c in columns)
            if held and key != held_key:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(begin, end - begin))
            held_key = key
    if held:
        yield pa.concat_tables(held).combine_chunks()


def tiles(rows: int, size: int) -> Iterator[slice]:
    """Consecutive slices of at most `size` rows."""
    return (slice(i, min(i + size, rows)) for i in range(0, rows, size))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal-length vectors as float64 rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    if array.null_count:
        raise ValueError("a vector is NULL; leave such rows out first (see vectors.with_vectors)")
    sizes = np.diff(array.offsets.to_numpy()) if len(array) else np.zeros(0, int)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of one key have different lengths")
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def strings(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def sparse_rows(table: pa.Table, width: int | None = None) -> np.ndarray:
    """Columns idx, w (positions and weights of the non-zero entries) as dense float64 rows."""
    idx, weights = table.column("idx").combine_chunks(), table.column("w").combine_chunks()
    if isinstance(idx, pa.ChunkedArray):
        idx, weights = pa.concat_arrays(idx.chunks), pa.concat_arrays(weights.chunks)
    sizes = np.diff(idx.offsets.to_numpy()) if len(idx) else np.zeros(0, int)
    columns = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    values = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = max(width or 0, int(columns.max()) + 1 if len(columns) else 1)
    out = np.zeros((len(idx), wide))
    out[np.repeat(np.arange(len(idx)), sizes), columns] = values
    return out


def constants(table: pa.Table, names: Sequence[str], rows: int) -> dict[str, pa.Array]:
    """The group's own columns repeated for the result rows."""
    return {n: pa.array([table.column(n)[0].as_py()] * rows, table.schema.field(n).type) for n in names}


def group_schema(df: DataFrame, group: Sequence[str], rest: str) -> str:
    """Schema text: the group columns with their types, then `rest`."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"{g} {types[g]}" for g in group), rest])
