"""String functions as native column expressions.

Python's `str` and `re` define the semantics, so character classes are spelled out: Java's `\\w`, `\\s`
and `\\b` differ from Python's on combining marks, separators and non-ASCII digits.
"""
from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

# Characters for which Python's str.isspace() holds.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters as SPACE, named by fewer classes: a pattern tries one after the other at every character.
BLANK = r"\p{IsWhite_Space}\x1c-\x1f"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Units whose leading space is dropped after a number, and the two unit-word lists.
SPACED_UNITS = ("V", "A", "W", "Hz", "MHz", "GHz", "kHz", "Ω", "Ohm", "F", "H", "C", "K", "J")
UNIT_SYMBOLS = "V|A|W|Hz|MHz|GHz|kHz|Ω|Ohm|F|H|C|K|J"
UNIT_WORDS = "volts?|amps?|watts?|hertz|ohms?|farads?|henries?|celsius|kelvin|joules?"
# Fixed value: the letters a learnt pattern accepts, as pattern text.
LETTER_RANGE = "[A-Za-z\\u0600-\\u06FF]"

WORD = r"\p{L}\p{N}_"


def _digits_outside_nd() -> str:
    """Ranges of characters that count as digits in Python without being decimal digits (superscripts, ...)."""
    points = [c for c in range(0x20000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    ranges: list[list[int]] = []
    for point in points:
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


DIGIT = r"\p{Nd}" + _digits_outside_nd()


def _replace(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, F.lit(pattern), F.lit(replacement))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once. An outer expression used inside a lambda would be computed
    for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def signature(value: Column) -> Column:
    """Run-length shape of a value: D digits, L letters, _ white space, O other; "" for NULL."""
    parts = rf"\p{{L}}+|[{BLANK}]+|[{DIGIT}]+|[^\p{{L}}{BLANK}{DIGIT}]+"
    runs = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(parts), F.lit(0))

    def starts(run: Column, first: str, after: str) -> Column:
        """Does the run start with a character from `first` up to, but not including, `after`?"""
        return (run >= first) & (run < after)

    def kind(run: Column) -> Column:
        # comparing whole runs with the bounds of ASCII ranges settles nearly all of them without a pattern
        plain = (
            F.when(starts(run, "a", "{") | starts(run, "A", "["), F.lit("L"))
            .when(starts(run, " ", "!"), F.lit("_"))
            .when(starts(run, "0", ":"), F.lit("D"))
            .when(run >= "!", F.lit("O"))
            .when(starts(run, "\t", "\x0e") | (run >= "\x1c"), F.lit("_"))
            .otherwise(F.lit("O"))
        )
        return (
            F.when(run < "\x80", plain)
            .when(F.rlike(run, F.lit(r"^\p{L}")), F.lit("L"))
            .when(F.rlike(run, F.lit(f"^[{BLANK}]")), F.lit("_"))
            .when(F.rlike(run, F.lit(f"^[{DIGIT}]")), F.lit("D"))
            .otherwise(F.lit("O"))
        )

    def run_text(run: Column) -> Column:
        size = F.length(run)
        return F.when(size == 1, kind(run)).otherwise(F.concat(kind(run), size.cast("string")))

    return F.array_join(F.transform(runs, run_text), "")


#: Characters that are looked at in one go.
SIGNED_AT_ONCE = 1 << 21


@functools.cache
def _kinds() -> np.ndarray:
    """The signature's kind of every code point; 0 where it hangs on the release of Unicode, which may be another in Java."""

    def kind(category: str) -> str:
        return "L" if category[0] == "L" else "D" if category == "Nd" else "O"

    kinds = np.zeros(0x110000, dtype=np.uint8)
    for point, char in enumerate(map(chr, range(len(kinds)))):
        category = unicodedata.category(char)
        now = kind(category)
        if category != "Cn" and now == kind(unicodedata.ucd_3_2_0.category(char)):
            kinds[point] = ord(now)
        if category != "Nd" and point < 0x20000 and char.isdigit():
            kinds[point] = ord("D")
    kinds[[ord(c) for c in BLANKS]] = ord("_")
    return kinds


def _row_slices(ends: np.ndarray) -> Iterator[slice]:
    """Consecutive rows of together SIGNED_AT_ONCE characters at most, or one longer row."""
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SIGNED_AT_ONCE, "right")))
        yield slice(start, stop)
        start = stop


def _signed(values: pa.Array) -> pa.Array:
    """Signatures of some texts, NULL for those that hold a code point without a kind, and for all if one is not UTF-8."""
    try:
        raw = "".join(values.to_pylist())
    except UnicodeDecodeError:
        return pa.nulls(len(values), pa.string())
    sizes = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = _kinds()[np.frombuffer(raw.encode("utf-32-le"), dtype=np.uint32)]
    begins = np.cumsum(sizes) - sizes
    first = np.zeros(len(kinds) + 1, dtype=bool)
    first[1:-1] = kinds[1:] != kinds[:-1]
    first[begins], first[-1] = True, False
    runs = np.flatnonzero(first)
    lengths = np.diff(runs, append=len(kinds))
    digits = np.where(lengths > 1, np.floor(np.log10(np.maximum(lengths, 1)) + 1e-12).astype(np.int64) + 1, 0)
    places = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.empty(places[-1], dtype=np.uint8)
    out[places[:-1]] = kinds[runs]
    for d in range(int(digits.max(initial=0))):
        wide = digits > d
        out[(places[:-1] + digits - d)[wide]] = 48 + lengths[wide] // 10**d % 10
    offsets = places[np.searchsorted(runs, np.append(begins, len(kinds)))].astype(np.int32)
    unknown = np.zeros(len(values), dtype=bool)
    unknown[np.searchsorted(begins, np.flatnonzero(kinds == 0), "right") - 1] = True
    texts = pa.StringArray.from_buffers(len(values), pa.py_buffer(offsets), pa.py_buffer(out))
    return pc.if_else(pa.array(unknown), pa.scalar(None, pa.string()), texts)


@F.arrow_udf(StringType())
def _signatures(values: pa.Array) -> pa.Array:
    values = pc.fill_null(values, "")
    ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
    parts = [_signed(values[rows]) for rows in _row_slices(ends)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def signature_in_batches(value: Column) -> Column:
    """`signature` for columns of long texts, worked out for whole Arrow batches; not for use inside a lambda.

    Texts with characters whose class is newer than Unicode 3.2 take the native expression.
    """
    return F.coalesce(_signatures(value), signature(value))


def signature_regex(sig: Column) -> Column:
    """Pattern text for a signature; lengths are kept for digits and letters only."""
    tokens = F.regexp_extract_all(sig, F.lit("[DL_O][0-9]*"), F.lit(0))

    def piece(token: Column) -> Column:
        head = F.substring(token, 1, 1)
        size = F.substring(token, 2, 10)
        counted = F.when(size == "", F.lit("+")).otherwise(F.concat(F.lit("{"), size, F.lit("}")))
        return (
            F.when(head == "D", F.concat(F.lit("\\d"), counted))
            .when(head == "L", F.concat(F.lit(LETTER_RANGE), counted))
            .when(head == "_", F.lit("\\s*"))
            .otherwise(F.lit("[^\\w\\s]+"))
        )

    return F.when(F.coalesce(sig, F.lit("")) == "", F.lit(".*")).otherwise(
        F.array_join(F.transform(tokens, piece), "")
    )


#: Java's matcher recurses once per pattern element; longer pattern texts would exhaust a task's stack.
LONG_PATTERN = 8000
#: One element of a learnt pattern, and how many of them are matched in one go when a pattern is long.
PIECE = r"(?:\\d|\\s|\[\^\\w\\s\]|\[A-Za-z\\u0600-\\u06FF\])(?:\{\d+\}|[+*])?"
PIECES = 400


def _java_classes(pattern: Column) -> Column:
    java = F.replace(pattern, F.lit("[^\\w\\s]"), F.lit(f"[^{WORD}{SPACE}]"))
    java = F.replace(java, F.lit("\\d"), F.lit("\\p{Nd}"))
    java = F.replace(java, F.lit("\\s"), F.lit(f"[{SPACE}]"))
    return F.replace(java, F.lit("\\w"), F.lit(f"[{WORD}]"))


def _matches_in_pieces(value: Column, pieces: Column) -> Column:
    """Match PIECES elements after another, each where the last ones ended.

    The classes of neighbouring elements have no character in common, so a greedy match never has to give one back.
    """
    last = F.floor((F.size(pieces) - 1) / PIECES).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.concat(F.lit("^("), _java_classes(F.array_join(F.slice(pieces, i * PIECES + 1, PIECES), "")), F.lit(")")),
    )

    def step(state: Column, part: Column) -> Column:
        rest = state["rest"]
        size = F.length(F.call_function("regexp_extract", rest, part, F.lit(1)))
        left = F.substring(rest, size + 1, F.length(rest))
        held = state["ok"] & F.rlike(rest, part)
        return F.when(held, F.struct(left.alias("rest"), F.lit(True).alias("ok"))).otherwise(
            F.struct(F.lit("").alias("rest"), F.lit(False).alias("ok"))
        )

    return F.aggregate(parts, F.struct(value.alias("rest"), F.lit(True).alias("ok")), step)["ok"]


def matches_prefix(value: Column, pattern: Column) -> Column:
    """Does the value start with a match of the row's own pattern? Python classes, any pattern column.

    All native. A learnt pattern of more than LONG_PATTERN characters is matched a few hundred elements at a time; any
    other pattern goes to the matcher whole.
    """
    pieces = F.regexp_extract_all(pattern, F.lit(PIECE), F.lit(0))
    learnt = (F.length(pattern) > LONG_PATTERN) & (F.array_join(pieces, "") == pattern)
    whole = F.rlike(value, F.concat(F.lit("^(?:"), _java_classes(pattern), F.lit(")")))
    return F.when(value.isNotNull() & learnt, _matches_in_pieces(value, pieces)).otherwise(whole)


def collapse_whitespace(value: Column) -> Column:
    # a lone blank stays as it is
    runs = f"[{BLANK}](?:(?<! )[{BLANK}]*|[{BLANK}]+)"
    return strip(_replace(F.coalesce(value, F.lit("")), runs, " "))


def join_number_and_unit(value: Column) -> Column:
    """`5 V` -> `5V`. One pass: removing one gap never opens another, so unit order does not matter."""
    units = "|".join(SPACED_UNITS)
    gap = rf"(?<=\p{{Nd}})[{BLANK}]+(?=(?:{units})(?:[{BLANK}]|$))"
    return _replace(F.coalesce(value, F.lit("")), gap, "")


def drop_thousands_separators(value: Column) -> Column:
    comma = r"(?<=\p{Nd}),(?=\p{Nd}{3}(?:\P{Nd}|$))"
    return _replace(F.coalesce(value, F.lit("")), comma, "")


def parenthetical(value: Column) -> Column:
    """struct(cleaned, comment): all bracketed parts leave the value, the first one is the comment."""
    text = F.coalesce(value, F.lit(""))
    found = F.rlike(text, F.lit(r"\([^)]+\)"))
    cleaned = strip(_replace(text, rf"[{BLANK}]*\([^)]+\)[{BLANK}]*", " "))
    return F.struct(
        F.when(found, cleaned).otherwise(text).alias("cleaned"),
        F.when(found, F.regexp_extract(text, r"\(([^)]+)\)", 1)).alias("comment"),
    )


def title_case(value: Column) -> Column:
    words = F.regexp_extract_all(value, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))

    def titled(word: Column) -> Column:
        # the upper form of one letter can be two letters, of which only the first stays upper
        first = F.upper(F.substring(word, 1, 1))
        rest = F.concat(F.substring(first, 2, 2), F.substr(word, F.lit(2), F.length(word)))
        return F.concat(F.substring(first, 1, 1), F.lower(rest))

    return F.array_join(F.transform(words, titled), "")


def change_case(value: Column, case: Column) -> Column:
    """`case` is one of lower, upper, title, preserve; NULL means lower."""
    kind = F.coalesce(case, F.lit("lower"))
    return (
        F.when(kind == "lower", F.lower(value))
        .when(kind == "upper", F.upper(value))
        .when(kind == "title", title_case(value))
        .otherwise(value)
    )


def collapse_punctuation(value: Column) -> Column:
    return _replace(value, rf"([^{WORD}{BLANK}])\1+", "$1")


def _edge(word: str, *, start: bool) -> str:
    """The side of `\\b` that fits the first or last character of a fixed word."""
    inside = word[0] if start else word[-1]
    is_word = inside.isalnum() or inside == "_"
    if start:
        return f"(?<![{WORD}])" if is_word else f"(?<=[{WORD}])"
    return f"(?![{WORD}])" if is_word else f"(?=[{WORD}])"


def map_units(value: Column, mapping: Mapping[str, str]) -> Column:
    """Whole-word, case-insensitive replacement with a mapping known when the plan is built."""
    for old, new in mapping.items():
        if not old:
            continue
        pattern = f"(?iu){_edge(old, start=True)}\\Q{old}\\E{_edge(old, start=False)}"
        value = _replace(value, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
    return value


def map_units_from(value: Column, mapping: Column) -> Column:
    """The same with a map column, for rules kept in a table."""
    is_word = f"^[{WORD}]"

    def step(text: Column, entry: Column) -> Column:
        old, new = entry["key"], entry["value"]
        left = F.when(F.rlike(old, F.lit(is_word)), F.lit(f"(?<![{WORD}])")).otherwise(F.lit(f"(?<=[{WORD}])"))
        right = F.when(F.rlike(old, F.lit(f"[{WORD}]$")), F.lit(f"(?![{WORD}])")).otherwise(
            F.lit(f"(?=[{WORD}])")
        )
        pattern = F.concat(F.lit("(?iu)"), left, F.lit("\\Q"), old, F.lit("\\E"), right)
        literal = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.when(old == "", text).otherwise(F.regexp_replace(text, pattern, literal))

    entries = F.coalesce(F.map_entries(mapping), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(entries, value, step)


def drop_leading_zeros(value: Column) -> Column:
    return _replace(value, rf"(?<![{WORD}])0+(?=\p{{Nd}})", "")


def number_and_unit(value: Column) -> Column:
    """struct(number double, unit string); both NULL when the value is not `<number><unit>`."""
    text = strip(F.coalesce(value, F.lit("")))
    pattern = rf"^([0-9]+(?:\.[0-9]+)?)[{BLANK}]*([A-Za-z]+)$"
    found = F.rlike(text, F.lit(pattern))
    return F.struct(
        F.when(found, F.regexp_extract(text, pattern, 1).try_cast("double")).alias("number"),
        F.when(found, F.regexp_extract(text, pattern, 2)).alias("unit"),
    )


def basic_form(value: Column) -> Column:
    return F.lower(strip(value))


def embedding_text(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit("")))


def has_digit(value: Column) -> Column:
    return F.rlike(value, F.lit(r"\p{Nd}"))


def has_letter(value: Column) -> Column:
    return F.rlike(value, F.lit("[A-Za-z]"))


def has_special(value: Column) -> Column:
    return F.rlike(value, F.lit(f"[^A-Za-z0-9{BLANK}]"))


def has_whitespace(value: Column) -> Column:
    return F.rlike(value, F.lit(f"[{BLANK}]"))


def has_parentheses(value: Column) -> Column:
    return F.rlike(value, F.lit(r"\([^)]+\)"))


def has_comma(value: Column) -> Column:
    return F.contains(value, F.lit(","))


def has_dash(value: Column) -> Column:
    return F.contains(value, F.lit("-"))


def has_unit_word(value: Column) -> Column:
    words = f"(?iu)(?<![{WORD}])(?:{UNIT_SYMBOLS}|{UNIT_WORDS})(?![{WORD}])"
    return F.rlike(value, F.lit(words))


def is_number_with_unit(value: Column) -> Column:
    return F.rlike(value, F.lit(rf"^[{BLANK}]*\p{{Nd}}+(?:\.\p{{Nd}}+)?[{BLANK}]*[A-Za-z]+[{BLANK}]*$"))


def correction_kind(original: Column, corrected: Column, compat: bool = False) -> Column:
    """What a reviewer's correction did. `compat` keeps the published branch order, where the second
    test is inverted and hides the third."""
    shorter = F.length(original) > F.length(corrected)
    if compat:
        return (
            F.when(shorter, F.lit("trimming"))
            .when(F.lower(original) != F.lower(corrected), F.lit("case_normalization"))
            .when(
                F.contains(original, F.lit(" ")) & ~F.contains(corrected, F.lit(" ")), F.lit("space_removal")
            )
        )
    without_spaces = F.replace(original, F.lit(" "), F.lit(""))
    return (
        F.when(original == corrected, F.lit(None).cast("string"))
        .when(F.lower(original) == F.lower(corrected), F.lit("case_normalization"))
        .when(F.contains(original, F.lit(" ")) & (without_spaces == corrected), F.lit("space_removal"))
        .when(shorter, F.lit("trimming"))
    )


def transformation_kind(original: Column, normalized: Column) -> Column:
    return (
        F.when(original == normalized, F.lit(None).cast("string"))
        .when(F.lower(original) == normalized, F.lit("to_lowercase"))
        .when(strip(original) == normalized, F.lit("trim_whitespace"))
        .when(F.length(original) > F.length(normalized), F.lit("remove_extra_chars"))
    )


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - edits / longer length on lower-cased text, fully native."""
    a, b = F.lower(left), F.lower(right)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


@F.pandas_udf(DoubleType())
def text_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; meant for pairs that already passed a native bound."""
    from difflib import SequenceMatcher

    return pd.Series(
        [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(left, right)], dtype="float64"
    )


def key_label(key: Column) -> Column:
    """Readable storage label; not unique, storage itself uses a hash bucket."""
    return F.translate(key, "/\\:", "___")
