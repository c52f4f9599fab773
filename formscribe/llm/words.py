"""Word rules and small expressions that several operators of this package share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word is a run of anything but blanks, tabs, line breaks, vertical tabs and form feeds.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Stands for a null id on the way through pandas, which has no null among 64-bit integers.
NULL_ID = -(2**63)


def marked(id_col: Column) -> Column:
    return F.coalesce(id_col.cast("long"), F.lit(NULL_ID))


def unmarked(id_col: Column) -> Column:
    return F.nullif(id_col, F.lit(NULL_ID))


def lower_ascii(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """All words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(c: Column) -> Column:
    """Number of words without building them: every word shrinks to one character, blanks go."""
    shrunk = F.regexp_replace(F.coalesce(c, F.lit("")), f"{WORD}[\\x20\\x09-\\x0D]*", "w")
    return F.length(F.regexp_replace(shrunk, r"^[\x20\x09-\x0D]+", "")).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
