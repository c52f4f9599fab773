"""Reading key-value tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from formscribe.config import Settings
from formscribe.operators.keys import add_composite_key, check_table
from formscribe.operators.profile import key_stats
from formscribe.sources.csv_ranges import read_records

# Cell texts that count as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
CORRUPT = "_corrupt_record"


def missing_to_null(value: Column) -> Column:
    return F.when(~value.isin(*MISSING), value)


def _header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Column names from the first line; only that line is read."""
    return spark.read.csv(path, header=True, encoding=encoding, escape='"', inferSchema=False).columns


def read_items(
    spark: SparkSession,
    path: str,
    settings: Settings = Settings(),
    columns: Sequence[str] | None = None,
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV table with all columns as text, missing-value texts as NULL and unreadable rows kept aside in
    `_corrupt_record` (see `split_corrupt`).

    Quoted cells may hold line breaks, and files are read in ranges all the same (see `csv_ranges`). A row whose quote is
    never closed is unreadable, alone. `multi_line=False` leaves out the pass that finds such cells, and is right only for
    files that are known to have no line break inside a cell. Line breaks are \\n or \\r\\n.
    """
    names = list(columns or _header(spark, path, settings.encoding))
    schema = StructType([StructField(n, StringType()) for n in [*names, CORRUPT]])
    options = {
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        # a cell may hold far more than the parser's usual bound
        "maxCharsPerColumn": "-1",
    }
    if multi_line:
        types = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
        records = read_records(spark, path, len(names), settings.encoding, header)
        parsed = records.select("record", "readable", F.from_csv(F.when(F.col("readable"), F.col("record")), types, options).alias("r"))
        broken = F.coalesce(F.col("r").getField(CORRUPT), F.when(~F.col("readable"), F.col("record")))
        raw = parsed.select(*[F.col("r").getField(n).alias(n) for n in names], broken.alias(CORRUPT))
    else:
        # with pruning, a line with too many cells would pass as long as the needed ones parse
        raw = spark.read.options(header=header, encoding=settings.encoding, columnPruning=False, **options).schema(schema).csv(path)
    return raw.select(*[missing_to_null(F.col(f"`{n}`")).alias(n) for n in names], CORRUPT)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined raw lines); one bad row no longer costs its whole chunk."""
    first = next(c for c in df.columns if c != CORRUPT)
    # Spark refuses to parse for the corrupt-record column alone, so the test reads another one with it
    readable = F.length(F.coalesce(first, F.lit(""))) >= 0
    good = df.where(F.col(CORRUPT).isNull() & readable).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull() & readable).select(CORRUPT)


def ingest(spark: SparkSession, path: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, key statistics), both lazy."""
    good, _ = split_corrupt(read_items(spark, path, settings))
    keyed = add_composite_key(good, settings)
    return keyed, key_stats(keyed, settings)


def ingest_checked(spark: SparkSession, path: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """`ingest` after the table check; raises when the table is empty or lacks columns."""
    good, _ = split_corrupt(read_items(spark, path, settings))
    report = check_table(good, settings).first()
    if not report.is_valid:
        raise ValueError(f"Data validation failed: {report.issues}")
    keyed = add_composite_key(good, settings)
    return keyed, key_stats(keyed, settings)


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """Type-inferred reading, for previews only."""
    return spark.read.csv(path, header=True, inferSchema=True, escape='"')


def preview(df: DataFrame, rows: int = 10, order: str | None = None) -> DataFrame:
    """The first rows with the table's row and column counts."""
    first = df.orderBy(order).limit(rows) if order else df.limit(rows)
    total = df.agg(F.count(F.lit(1))).scalar()
    return first.select("*", total.alias("total_rows"), F.lit(len(df.columns)).alias("total_columns"))
