"""String functions against golden values and against plain Python on random text."""
import random
import re
import string
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from formscribe.functions import text

def column(function, *args, **options):
    """A column expression of `v`, built when a session runs."""
    return lambda: function(F.col("v"), *args, **options)


def apply(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", build().alias("x")).orderBy("i").collect()]


def random_texts(n=400, seed=7):
    rng = np.random.default_rng(seed)
    letters = string.ascii_letters + "éßÑЖمعω漢"
    pools = [letters, string.digits + "٣²", " \t\n  \x1c", "()-,._!!''́Ω€😀", "VAHz"]
    out = []
    for _ in range(n):
        size = int(rng.integers(0, 14))
        out.append("".join(str(rng.choice(list(pools[int(rng.integers(len(pools)))]))) for _ in range(size)))
    return out


def python_signature(v):
    kinds = ["D" if c.isdigit() else "L" if c.isalpha() else "_" if c.isspace() else "O" for c in v]
    runs = []
    for k in kinds:
        if runs and runs[-1][0] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    return "".join(k + (str(n) if n > 1 else "") for k, n in runs)


def test_signature_golden(spark):
    values = ["k9", "Zoë 7", "-12.5 °C", " ", "a_b", "", None]
    assert apply(spark, values, column(text.signature)) == [python_signature(v or "") for v in values]


def test_signature_random(spark):
    values = random_texts()
    assert apply(spark, values, column(text.signature)) == [python_signature(v) for v in values]


def test_signature_digits_outside_decimals(spark):
    values = [chr(c) for c in range(0x3000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    assert set(apply(spark, values, column(text.signature))) == {"D"}


def test_signature_regex_golden(spark):
    letters = "[A-Za-z\\u0600-\\u06FF]"
    want = [letters + r"{3}\d{3}", r"\d+", letters + "+", ".*", r"\s*[^\w\s]+"]
    assert apply(spark, ["L3D3", "D", "L", "", "_3O2"], column(text.signature_regex)) == want


def test_values_match_their_own_pattern(spark):
    values = [v for v in random_texts() if v and all(not c.isalpha() or c in string.ascii_letters for c in v)]
    values = [v for v in values if "²" not in v and "_" not in v]
    matched = apply(spark, values, lambda: text.matches_prefix(F.col("v"), text.signature_regex(text.signature(F.col("v")))))
    assert all(matched)


def test_prefix_match_is_anchored_at_the_start_only(spark):
    pattern = F.lit("[A-Za-z\\u0600-\\u06FF]{3}\\d{3}")
    assert apply(spark, ["ABC1234", "xABC123", "AB123"], column(text.matches_prefix, pattern)) == [True, False, False]


def test_very_long_patterns(spark):
    """Far more runs than a Java stack can hold; one value matches its own pattern, the other one does not."""
    base = spark.range(2).select("id", F.repeat(F.lit("ab1 "), 20000).alias("v"))
    pattern = text.signature_regex(text.signature(F.col("v")))
    value = F.when(F.col("id") == 0, F.col("v")).otherwise(F.concat(F.lit("7"), "v"))
    rows = base.select("id", text.matches_prefix(value, pattern).alias("m")).orderBy("id").collect()
    assert [r.m for r in rows] == [True, False]


def test_letter_outside_the_pattern_range_misses(spark):
    """The pattern accepts ASCII and Arabic letters only, although Ω counts as a letter."""
    assert apply(spark, ["5Ω"], lambda: text.matches_prefix(F.col("v"), text.signature_regex(text.signature(F.col("v"))))) == [False]


def test_collapse_whitespace(spark):
    values = ["  hello   world  ", "a\nb", None, *random_texts()]
    assert apply(spark, values, column(text.collapse_whitespace)) == [" ".join((v or "").split()) for v in values]


def test_strip(spark):
    values = random_texts()
    assert apply(spark, values, column(text.strip)) == [v.strip() for v in values]


def test_join_number_and_unit(spark):
    values = ["1 V", "100 Hz", "hello world", "5 kHz 6 V", "3 Vx", "1 V\n", None]
    want = ["1V", "100Hz", "hello world", "5kHz 6V", "3 Vx", "1V\n", ""]
    assert apply(spark, values, column(text.join_number_and_unit)) == want


def test_thousands(spark):
    values = ["1,000", "1,000,000", "hello,world", "1,2345", "12,345 and 6,789"]
    want = ["1000", "1000000", "hello,world", "1,2345", "12345 and 6789"]
    assert apply(spark, values, column(text.drop_thousands_separators)) == want


def test_parenthetical(spark):
    values = ["Hello (world)", "Hello world", "", None, "a (b) c (d)", "a ()"]
    got = apply(spark, values, column(text.parenthetical))
    want = [("Hello", "world"), ("Hello world", None), ("", None), ("", None), ("a c", "b"), ("a ()", None)]
    assert [tuple(g) for g in got] == want


def test_title_case(spark):
    values = [v for v in random_texts() if "ω" not in v] + ["o'neil usb-c 3mm", "ßa"]
    assert apply(spark, values, column(text.title_case)) == [v.title() for v in values]


def test_collapse_punctuation(spark):
    values = random_texts()
    want = [re.sub(r"([^\w\s])\1+", r"\1", v) for v in values]
    assert apply(spark, values, column(text.collapse_punctuation)) == want


def test_leading_zeros(spark):
    values = ["007", "x007", "0", "000", "1.05", "a-001"]
    assert apply(spark, values, column(text.drop_leading_zeros)) == [re.sub(r"\b0+(\d+)", r"\1", v) for v in values]


def test_map_units(spark):
    mapping = {"volts": "V", "ohm": "Ω", "$": "USD"}
    values = ["5 Volts", "5volts", "volts", "OHM x", "a$b $ c"]

    def plain(v):
        for old, new in mapping.items():
            v = re.sub(r"\b" + re.escape(old) + r"\b", new, v, flags=re.IGNORECASE)
        return v

    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    assert apply(spark, values, column(text.map_units, mapping)) == [plain(v) for v in values]
    assert apply(spark, values, column(text.map_units_from, table)) == [plain(v) for v in values]


def test_number_and_unit(spark):
    got = apply(spark, ["12 V", " 3.5mm ", "x", "4 V 5", None], column(text.number_and_unit))
    assert [tuple(g) for g in got] == [(12.0, "V"), (3.5, "mm"), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize("name", ["has_digit", "has_letter", "has_special", "has_whitespace", "has_parentheses"])
def test_character_tests(spark, name):
    patterns = {
        "has_digit": r"\d",
        "has_letter": r"[A-Za-z]",
        "has_special": r"[^A-Za-z0-9\s]",
        "has_whitespace": r"\s",
        "has_parentheses": r"\([^)]+\)",
    }
    values = random_texts()
    got = apply(spark, values, column(getattr(text, name)))
    assert got == [bool(re.search(patterns[name], v)) for v in values]


def test_unit_words(spark):
    values = ["5 V", "5V", "ohms", "Volt meter", "v", "aVb", "10 Ω", "kelvin"]
    symbols = r"\b(V|A|W|Hz|MHz|GHz|kHz|Ω|Ohm|F|H|C|K|J)\b"
    words = r"\b(volts?|amps?|watts?|hertz|ohms?|farads?|henries?|celsius|kelvin|joules?)\b"
    want = [bool(re.search(symbols, v, re.I) or re.search(words, v, re.I)) for v in values]
    assert apply(spark, values, column(text.has_unit_word)) == want


def test_text_similarity(spark):
    from difflib import SequenceMatcher

    pairs = [("Abcd", "abed"), ("", ""), ("x", "y")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in df.select("i", text.text_similarity("a", "b").alias("s")).orderBy("i").collect()]
    assert got == [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in pairs]


def test_correction_kinds(spark):
    df = spark.createDataFrame(
        [(0, "abc ", "abc"), (1, "ABC", "abc"), (2, "a b", "ab"), (3, "abc", "abd"), (4, "same", "same")],
        "i int, a string, b string",
    )
    got = df.select(
        "i",
        text.correction_kind(F.col("a"), F.col("b")).alias("fixed"),
        text.correction_kind(F.col("a"), F.col("b"), compat=True).alias("compat"),
    ).orderBy("i").collect()
    assert [r.fixed for r in got] == ["space_removal", "case_normalization", "space_removal", None, None]
    assert [r.compat for r in got] == ["trimming", None, "trimming", "case_normalization", None]


def test_signature_in_batches(spark, monkeypatch):
    rng = random.Random(5)
    signs = "aB9 .,\t\x1c\x85\xa0\u3000\xe9\xdf\u0663\xb3\u65e5\U00010400\U0001f600\u0861\u0870\u0378\x00\x7f\u2460"
    drawn = ["".join(rng.choices(signs[: rng.choice((4, 10, len(signs)))], k=rng.randint(0, 60))) for _ in range(400)]
    values = ["", None, "x" * 9, "x" * 10, "x" * 12345 + "1" * 99 + " " * 100, *drawn, None, ""]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    for r in df.select("v", text.signature_in_batches(F.col("v")).alias("a"), text.signature(F.col("v")).alias("b")).collect():
        assert r.a == r.b, repr(r.v)
    # several slices of a batch
    monkeypatch.setattr(text, "SIGNED_AT_ONCE", 7)
    assert [(s.start, s.stop) for s in text._row_slices(np.cumsum([3, 3, 3, 20, 0, 0, 7, 1]))] == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]
