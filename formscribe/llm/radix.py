"""A distributed radix sort: rows get their place in a total order by stable counting-sort passes, lowest digit first."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from formscribe.llm.stages import stored

#: Bits of a digit, and (as a power of two) rows of a block whose digits are counted together.
DIGIT_BITS, BLOCK_BITS = 12, 16


def _parts(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[tuple[Column, int]]:
    """(column of whole numbers from 0, bits) for each part of the composite key, lowest part first.

    A key gives its upper and lower 32 bits, so that the distance of two numbers never overflows, and a bit for null,
    which comes last. Parts that are equal in all rows have no bits and cost no pass.
    """
    upper = {k: F.shiftright(F.col(k).cast("long"), 32) for k, _ in keys}
    lower = {k: F.col(k).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) for k, _ in keys}
    asked = []
    for k, _ in keys:
        asked += [F.min(upper[k]).alias(f"a_{k}"), F.max(upper[k]).alias(f"b_{k}"), F.min(lower[k]).alias(f"c_{k}"), F.max(lower[k]).alias(f"d_{k}")]
        asked += [F.max(F.col(k).isNull().cast("int")).alias(f"n_{k}")]
    found = rows.agg(*asked).first()
    parts = []
    for k, falling in reversed(keys):
        for half, lo, hi in ((lower[k], found[f"c_{k}"], found[f"d_{k}"]), (upper[k], found[f"a_{k}"], found[f"b_{k}"])):
            if lo is not None and hi > lo:
                value = F.lit(hi) - half if falling else half - F.lit(lo)
                parts.append((F.coalesce(value, F.lit(0)), (hi - lo).bit_length()))
        if found[f"n_{k}"]:
            parts.append((F.col(k).isNull().cast("long"), 1))
    return parts


def _digit(parts: list[tuple[Column, int]], low: int, high: int) -> Column:
    """Bits low to high of all parts, one above the other."""
    out, base = F.lit(0).cast("long"), 0
    for value, bits in parts:
        a, b = max(low, base), min(high, base + bits)
        if a < b:
            field = F.shiftright(value, a - base).bitwiseAND(F.lit((1 << (b - a)) - 1))
            out = out + F.shiftleft(field, a - low)
        base += bits
    return out.cast("int")


def radix_places(rows: DataFrame, keys: list[tuple[str, bool]], digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows with `place`, counted from 0 in the order of the keys: (column of whole numbers, falling), highest first.

    A pass counts the digits of each block of consecutive rows, turns the counts into offsets (all smaller digits, then the
    same digit in earlier blocks), and moves each row to offset plus its number among the block's rows of that digit; ties
    keep their order. No task sees more than a block, and what reaches the driver is one number per digit. Rows equal in
    all keys come in any order; nulls come last. An empty table stays empty.
    """
    parts = _parts(rows, keys)
    bits = sum(n for _, n in parts)
    current = stored(rows.withColumn("place", F.monotonically_increasing_id()), "radix")
    spark = rows.sparkSession
    for low in range(0, max(bits, 1), digit_bits):
        dealt = current.withColumn("r_digit", _digit(parts, low, min(bits, low + digit_bits))).withColumn("r_block", F.shiftright("place", block_bits))
        counts = stored(dealt.groupBy("r_block", "r_digit").agg(F.count(F.lit(1)).alias("n")), "radix-counts")
        base, below = [], 0
        for r in sorted(counts.groupBy("r_digit").agg(F.sum("n").alias("n")).collect()):
            base.append((r.r_digit, below))
            below += r.n
        earlier = Window.partitionBy("r_digit").orderBy("r_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.join(spark.createDataFrame(base, "r_digit int, base long"), "r_digit").select(
            "r_block", "r_digit", (F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("r_offset")
        )
        among = F.row_number().over(Window.partitionBy("r_block", "r_digit").orderBy("place")) - 1
        moved = dealt.join(offsets, ["r_block", "r_digit"]).select(*rows.columns, (F.col("r_offset") + among).alias("place"))
        current = stored(moved, "radix")
    return current
