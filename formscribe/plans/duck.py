"""Text fragments for the checking SQL: the same functions written for DuckDB's RE2 patterns."""
from __future__ import annotations

from formscribe.functions.text import DIGIT, SPACE, SPACED_UNITS, UNIT_SYMBOLS, UNIT_WORDS, WORD


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def signature(v: str) -> str:
    runs = lit(rf"[{DIGIT}]+|\p{{L}}+|[{SPACE}]+|[^{DIGIT}\p{{L}}{SPACE}]+")
    return f"""array_to_string(list_transform(regexp_extract_all(coalesce({v}, ''), {runs}), lambda r:
        (case when regexp_matches(r, {lit(f'^[{DIGIT}]')}) then 'D' when regexp_matches(r, '^\\p{{L}}') then 'L'
              when regexp_matches(r, {lit(f'^[{SPACE}]')}) then '_' else 'O' end)
        || (case when length(r) > 1 then cast(length(r) as varchar) else '' end)), '')"""


def signature_regex(sig: str) -> str:
    return f"""(case when coalesce({sig}, '') = '' then '.*' else
      array_to_string(list_transform(regexp_extract_all({sig}, '[DL_O][0-9]*'), lambda t:
        case left(t, 1)
          when 'D' then (case when length(t) > 1 then '\\d{{' || substr(t, 2) || '}}' else '\\d+' end)
          when 'L' then '[A-Za-z\\u0600-\\u06FF]'
                        || (case when length(t) > 1 then '{{' || substr(t, 2) || '}}' else '+' end)
          when '_' then '\\s*' else '[^\\w\\s]+' end), '') end)"""


def _sub(v: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({v}, {lit(pattern)}, {lit(to)}, '{flags}')"


def strip(v: str) -> str:
    return _sub(v, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_whitespace(v: str) -> str:
    return strip(_sub(f"coalesce({v}, '')", f"[{SPACE}]+", " "))


def join_number_and_unit(v: str) -> str:
    units = "|".join(SPACED_UNITS)
    return _sub(f"coalesce({v}, '')", rf"(\p{{Nd}})[{SPACE}]+({units})([{SPACE}]|$)", r"\1\2\3")


def drop_thousands_separators(v: str) -> str:
    text = f"coalesce({v}, '')"
    for _ in range(4):
        text = _sub(text, r"(\p{Nd}),(\p{Nd}{3})(\P{Nd}|$)", r"\1\2\3")
    return text


def has_parentheses(v: str) -> str:
    return rf"regexp_matches({v}, '\([^)]+\)')"


def cleaned(v: str) -> str:
    return f"(case when {has_parentheses(v)} then {strip(_sub(v, rf'[{SPACE}]*\([^)]+\)[{SPACE}]*', ' '))} else {v} end)"


def comment(v: str) -> str:
    return rf"(case when {has_parentheses(v)} then regexp_extract({v}, '\(([^)]+)\)', 1) end)"


def title_case(v: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all({v}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+'),
        lambda w: (case when w[1] = 'ß' then 'Ss' else upper(w[1]) end) || lower(substr(w, 2))), '')"""


def collapse_punctuation(v: str) -> str:
    """In every run of punctuation, drop each character that equals its predecessor."""
    runs = f"regexp_extract_all({v}, {lit(f'[^{WORD}{SPACE}]+|[{WORD}{SPACE}]+')})"
    return rf"""array_to_string(list_transform({runs}, lambda r: case when regexp_matches(r, {lit(f'^[{WORD}{SPACE}]')}) then r
        else array_to_string(list_filter(string_split(r, ''), lambda c, i: i = 1 or c <> string_split(r, '')[i - 1]), '') end), '')"""


def drop_leading_zeros(v: str) -> str:
    return _sub(v, rf"(^|[^{WORD}])0+(\p{{Nd}})", r"\1\2")


def map_unit(v: str, old: str, new: str) -> str:
    once = _sub(v, rf"(^|[^{WORD}])(?i:{old})([^{WORD}]|$)", rf"\1{new}\2")
    return _sub(once, rf"(^|[^{WORD}])(?i:{old})([^{WORD}]|$)", rf"\1{new}\2")


def matches_prefix(v: str, regex: str) -> str:
    fixed = regex
    for old, new in (
        (r"[^\w\s]", f"[^{WORD}{SPACE}]"),
        (r"\d", r"\p{Nd}"),
        (r"\s", f"[{SPACE}]"),
        (r"\u0600-\u06FF", r"\x{0600}-\x{06FF}"),
    ):
        fixed = f"replace({fixed}, {lit(old)}, {lit(new)})"
    return f"regexp_matches({v}, '^(?:' || {fixed} || ')')"


def number_unit_pattern(v: str) -> str:
    return rf"regexp_matches({v}, {lit(rf'^[{SPACE}]*\p{{Nd}}+(?:\.\p{{Nd}}+)?[{SPACE}]*[A-Za-z]+[{SPACE}]*$')})"


def unit_word(v: str) -> str:
    pattern = rf"(?i)(^|[^{WORD}])({UNIT_SYMBOLS}|{UNIT_WORDS})([^{WORD}]|$)"
    return f"regexp_matches({v}, {lit(pattern)})"


def digit(v: str) -> str:
    return rf"regexp_matches({v}, '\p{{Nd}}')"


def letter(v: str) -> str:
    return f"regexp_matches({v}, '[A-Za-z]')"


def special(v: str) -> str:
    return f"regexp_matches({v}, {lit(f'[^A-Za-z0-9{SPACE}]')})"


def whitespace(v: str) -> str:
    return f"regexp_matches({v}, {lit(f'[{SPACE}]')})"


def key(*parts: str) -> str:
    return " || '||' || ".join(f"coalesce({p}, 'nan')" for p in parts or ("key_part1", "key_part2", "key_part3"))


def keyed(view: str, name: str = "keyed") -> str:
    """CTE body adding the composite key and the signature to the non-null values of a view."""
    return f"{name} as (select {key()} as composite_key, value, row_id, {signature('value')} as sig from {view} where value is not null)"
