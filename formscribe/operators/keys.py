"""Composite keys and checks on the input table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings

SEPARATOR = "||"


def composite_key(parts: Sequence[Column]) -> Column:
    """Parts joined by two pipes. A NULL part reads `nan`; concat_ws alone would drop it."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


def add_composite_key(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    if "composite_key" in df.columns:
        return df
    missing = [c for c in settings.key_columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing key columns: {missing}")
    return df.withColumn("composite_key", composite_key([F.col(c) for c in settings.key_columns]))


def key_parts(key: Column) -> Column:
    return F.split(key, r"\|\|", -1)


def valid_key_parts(parts: Column, expected: int = 3) -> Column:
    """Exactly `expected` parts, none NULL or blank."""
    from formscribe.functions.text import strip

    filled = F.forall(parts, lambda p: p.isNotNull() & (strip(p) != ""))
    return F.coalesce((F.size(parts) == expected) & filled, F.lit(False))


def canonical_columns(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Configured key and value columns under fixed names: key_part1..n, value and, if set, row_id."""
    chosen = [F.col(c).alias(f"key_part{i}") for i, c in enumerate(settings.key_columns, 1)]
    chosen.append(F.col(settings.value_column).alias("value"))
    if settings.order_column:
        chosen.append(F.col(settings.order_column).alias("row_id"))
    return df.select(*chosen)


def check_table(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: is_valid, issues[], warnings[]. Column names are checked at plan time, rows in one pass."""
    wanted = [*settings.key_columns, settings.value_column]
    missing = [c for c in wanted if c not in df.columns]
    present = [c for c in wanted if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    )

    def warning(name: str) -> Column:
        label = "Value column" if name == settings.value_column else "Column"
        nulls = F.col(f"null_{name}")
        text = F.concat(F.lit(f"{label} '{name}' has "), nulls.cast("string"), F.lit(" null values"))
        return F.when(nulls > 0, text)

    no_text = F.lit(None).cast("string")
    missing_issue = F.lit(f"Missing required columns: {missing}") if missing else no_text
    return counts.select(
        (F.lit(not missing) & (F.col("rows") > 0)).alias("is_valid"),
        F.array_compact(
            F.array(missing_issue, F.when(F.col("rows") == 0, F.lit("DataFrame is empty")))
        ).alias("issues"),
        F.array_compact(F.array(*[warning(c) for c in present] or [no_text])).alias("warnings"),
    )
