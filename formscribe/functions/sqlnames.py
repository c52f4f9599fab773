"""SQL names for native functions, as SQL functions that expand in place, so plans stay native."""
from __future__ import annotations

from pyspark.sql import SparkSession

from formscribe.functions.text import DIGIT, LETTER_RANGE, SPACE, SPACED_UNITS, WORD


def _bodies() -> dict[str, str]:
    runs = rf"\p{{L}}+|[{SPACE}]+|[{DIGIT}]+|[^\p{{L}}{SPACE}{DIGIT}]+"
    kind = rf"""CASE WHEN left(r, 1) BETWEEN 'a' AND 'z' OR left(r, 1) BETWEEN 'A' AND 'Z' THEN 'L' WHEN left(r, 1) = ' ' THEN '_'
        WHEN left(r, 1) BETWEEN '0' AND '9' THEN 'D' WHEN rlike(r, r'^\p{{L}}') THEN 'L' WHEN rlike(r, r'^[{SPACE}]') THEN '_'
        WHEN rlike(r, r'^[{DIGIT}]') THEN 'D' ELSE 'O' END"""
    size = "CASE WHEN substring(t, 2) = '' THEN '+' ELSE concat('{', substring(t, 2), '}') END"
    token = rf"""CASE left(t, 1) WHEN 'D' THEN concat(r'\d', {size}) WHEN 'L' THEN concat(r'{LETTER_RANGE}', {size})
        WHEN '_' THEN r'\s*' ELSE r'[^\w\s]+' END"""
    word = "concat(substring(upper(left(w, 1)), 1, 1), lower(concat(substring(upper(left(w, 1)), 2), substring(w, 2))))"
    units = "|".join(SPACED_UNITS)
    return {
        "signature": rf"""array_join(transform(regexp_extract_all(coalesce(v, ''), r'{runs}', 0),
            r -> concat({kind}, CASE WHEN length(r) > 1 THEN cast(length(r) AS STRING) ELSE '' END)), '')""",
        "signature_regex": rf"""CASE WHEN coalesce(v, '') = '' THEN '.*'
            ELSE array_join(transform(regexp_extract_all(v, r'[DL_O][0-9]*', 0), t -> {token}), '') END""",
        "collapse_whitespace": rf"""regexp_replace(regexp_replace(coalesce(v, ''), r'[{SPACE}]+', ' '), r'^ | $', '')""",
        "join_number_and_unit": rf"""regexp_replace(coalesce(v, ''), r'(?<=\p{{Nd}})[{SPACE}]+(?=(?:{units})(?:[{SPACE}]|$))', '')""",
        "drop_thousands_separators": r"""regexp_replace(coalesce(v, ''), r'(?<=\p{Nd}),(?=\p{Nd}{3}(?:\P{Nd}|$))', '')""",
        "drop_leading_zeros": rf"""regexp_replace(v, r'(?<![{WORD}])0+(?=\p{{Nd}})', '')""",
        "collapse_punctuation": rf"""regexp_replace(v, r'([^{WORD}{SPACE}])\1+', '$1')""",
        "title_case": rf"""array_join(transform(regexp_extract_all(v, r'[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+', 0), w -> {word}), '')""",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions, each of one string, and return their names."""
    bodies = _bodies()
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN {body}")
    return list(bodies)
