"""Ascending id ranges of about equal size, for work in the order of ids without one global sort."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Ranges per shuffle partition: enough that hashing ranges to partitions stays even.
RANGES_PER_PARTITION = 6


def id_bounds(df: DataFrame, id_col: str, per_partition: int = RANGES_PER_PARTITION) -> list[int]:
    """Bounds between id ranges: approximate quantiles over all ids, `per_partition` for each shuffle partition.

    The list has that many numbers at most, however many rows there are. Null ids have no part in it.
    """
    n = per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.approxQuantile(id_col, [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted({min(int(x), 2**63 - 1) for x in found})


def id_range(id_col: Column, bounds: list[int]) -> Column:
    """Number of the range that an id lies in; null ids come after all others."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    return F.when(id_col.isNull(), F.lit(len(bounds) + 1)).otherwise(find(F.coalesce(id_col, F.lit(0))))
