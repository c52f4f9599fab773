"""String functions over every value of four item views."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.functions import text
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.views import view, with_views

UNIT_MAP = {"V": "volt", "Hz": "hertz", "ring": "loop"}


def _each_value(name: str, columns: Callable[[Column], dict[str, Column]], sql_columns: dict[str, str]) -> None:
    """A query of `columns(value)`; they are built per run, as columns need a running session."""
    listed = ", ".join(f"{body} as {alias}" for alias, body in sql_columns.items())
    sql = f"{with_views('v_mixed')} select src, row_id, {listed} from v_mixed"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = view(spark, sf_dir, "v_mixed")
        return df.select("src", "row_id", *[c.alias(a) for a, c in columns(F.col("value")).items()])


_each_value("signature", lambda v: {"sig": text.signature(v)}, {"sig": duck.signature("value")})
_each_value(
    "signature_regex",
    lambda v: {"regex": text.signature_regex(text.signature(v))},
    {"regex": duck.signature_regex(duck.signature("value"))},
)
_each_value(
    "collapse_whitespace", lambda v: {"cleaned": text.collapse_whitespace(v)}, {"cleaned": duck.collapse_whitespace("value")}
)
_each_value(
    "join_number_and_unit", lambda v: {"cleaned": text.join_number_and_unit(v)}, {"cleaned": duck.join_number_and_unit("value")}
)
_each_value(
    "thousands_separators",
    lambda v: {"cleaned": text.drop_thousands_separators(v)},
    {"cleaned": duck.drop_thousands_separators("value")},
)
_each_value(
    "parenthetical_comment",
    lambda v: {"cleaned": text.parenthetical(v)["cleaned"], "comment": text.parenthetical(v)["comment"]},
    {"cleaned": duck.cleaned("value"), "comment": duck.comment("value")},
)
_each_value(
    "change_case",
    lambda v: {
        "lowered": text.change_case(v, F.lit("lower")),
        "uppered": text.change_case(v, F.lit("upper")),
        "titled": text.change_case(v, F.lit("title")),
        "kept": text.change_case(v, F.lit("preserve")),
    },
    {
        "lowered": "lower(value)",
        "uppered": "upper(replace(value, 'ß', 'SS'))",
        "titled": duck.title_case("value"),
        "kept": "value",
    },
)
_each_value(
    "collapse_punctuation", lambda v: {"cleaned": text.collapse_punctuation(v)}, {"cleaned": duck.collapse_punctuation("value")}
)


def _mapped(v: str) -> str:
    for old, new in UNIT_MAP.items():
        v = duck.map_unit(v, old, new)
    return v


_each_value("map_units", lambda v: {"cleaned": text.map_units(v, UNIT_MAP)}, {"cleaned": _mapped("value")})
_each_value(
    "map_units_from_table",
    lambda v: {"cleaned": text.map_units_from(v, F.create_map(*[F.lit(x) for kv in UNIT_MAP.items() for x in kv]))},
    {"cleaned": _mapped("value")},
)
_each_value("leading_zeros", lambda v: {"cleaned": text.drop_leading_zeros(v)}, {"cleaned": duck.drop_leading_zeros("value")})
_each_value(
    "number_and_unit",
    lambda v: {"number": text.number_and_unit(v)["number"], "unit": text.number_and_unit(v)["unit"]},
    {
        "number": r"try_cast(nullif(regexp_extract(trim(value), '^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)$', 1), '') as double)",
        "unit": r"nullif(regexp_extract(trim(value), '^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)$', 2), '')",
    },
)
_each_value(
    "character_tests",
    lambda v: {
        "digits": text.has_digit(v),
        "letters": text.has_letter(v),
        "special": text.has_special(v),
        "whitespace": text.has_whitespace(v),
        "parentheses": text.has_parentheses(v),
        "commas": text.has_comma(v),
        "dashes": text.has_dash(v),
    },
    {
        "digits": duck.digit("value"),
        "letters": duck.letter("value"),
        "special": duck.special("value"),
        "whitespace": duck.whitespace("value"),
        "parentheses": duck.has_parentheses("value"),
        "commas": "contains(value, ',')",
        "dashes": "contains(value, '-')",
    },
)
_each_value(
    "unit_tests",
    lambda v: {"unit_word": text.has_unit_word(v), "number_with_unit": text.is_number_with_unit(v)},
    {"unit_word": duck.unit_word("value"), "number_with_unit": duck.number_unit_pattern("value")},
)
_each_value("embedding_text", lambda v: {"cleaned": text.embedding_text(v)}, {"cleaned": duck.strip("coalesce(value, '')")})


@query(
    "basic_normalization",
    f"""{with_views('v_mixed')}, b as (select src, row_id, value, lower({duck.strip('value')}) as normalized from v_mixed)
    select src, row_id, value as original, normalized from b where normalized <> value""",
)
def basic_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.mining import changed_examples

    return changed_examples(view(spark, sf_dir, "v_mixed")).select("src", "row_id", "original", "normalized")


@query(
    "prefix_match",
    f"""{with_views('v_parts', 'v_customers')}, allv as (select * from v_parts union all select * from v_customers),
    keyed as (select *, {duck.key()} as composite_key, {duck.signature('value')} as sig from allv),
    cnt as (select composite_key, sig, count(*) as n, min(row_id) as p from keyed group by 1, 2),
    best as (select composite_key, sig as best_sig from cnt
             qualify row_number() over (partition by composite_key order by n desc, p, sig) = 1)
    select composite_key, row_id, {duck.matches_prefix('value', duck.signature_regex('best_sig'))} as matched
    from keyed join best using (composite_key)""",
)
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.config import Settings
    from formscribe.operators.keys import add_composite_key
    from formscribe.operators.profile import key_patterns

    items = view(spark, sf_dir, "v_parts").unionByName(view(spark, sf_dir, "v_customers"))
    patterns = key_patterns(items, Settings(min_signature_frequency=1, rare_signature_pct=0.0))
    joined = add_composite_key(items).join(patterns.select("composite_key", "candidate_regex"), "composite_key")
    return joined.select("composite_key", "row_id", text.matches_prefix(F.col("value"), F.col("candidate_regex")).alias("matched"))


@query(
    "edit_similarity",
    f"""{with_views('v_parts')}, d as (select distinct {duck.key()} as composite_key, value from v_parts),
    n as (select composite_key, value, lead(value) over (partition by composite_key order by value) as other from d)
    select composite_key, value, other,
           round(1.0 - levenshtein(lower(value), lower(other)) / greatest(length(value), length(other)), 6) as similarity
    from n where other is not null""",
)
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    from formscribe.operators.keys import add_composite_key

    values = add_composite_key(view(spark, sf_dir, "v_parts")).select("composite_key", "value").distinct()
    nearest = values.withColumn("other", F.lead("value").over(W.partitionBy("composite_key").orderBy("value")))
    similarity = F.round(text.edit_similarity(F.col("value"), F.col("other")), 6)
    return nearest.where(F.col("other").isNotNull()).select("composite_key", "value", "other", similarity.alias("similarity"))


@query(
    "correction_kind",
    f"""{with_views('v_reviews')}
    select id, case when original_value = corrected_value then null
        when lower(original_value) = lower(corrected_value) then 'case_normalization'
        when contains(original_value, ' ') and replace(original_value, ' ', '') = corrected_value then 'space_removal'
        when length(original_value) > length(corrected_value) then 'trimming' end as kind,
      case when length(original_value) > length(corrected_value) then 'trimming'
        when lower(original_value) <> lower(corrected_value) then 'case_normalization'
        when contains(original_value, ' ') and not contains(corrected_value, ' ') then 'space_removal' end as compat_kind
    from v_reviews where decision = 'edit'""",
)
def correction_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = view(spark, sf_dir, "v_reviews").where("decision = 'edit'")
    before, after = F.col("original_value"), F.col("corrected_value")
    return edits.select(
        "id",
        text.correction_kind(before, after).alias("kind"),
        text.correction_kind(before, after, compat=True).alias("compat_kind"),
    )


@query(
    "transformation_kind",
    f"""{with_views('v_mixed')}, b as (select src, row_id, value, lower({duck.strip('value')}) as normalized from v_mixed)
    select src, row_id, case when value = normalized then null when lower(value) = normalized then 'to_lowercase'
        when {duck.strip('value')} = normalized then 'trim_whitespace'
        when length(value) > length(normalized) then 'remove_extra_chars' end as kind from b""",
)
def transformation_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "v_mixed")
    return df.select("src", "row_id", text.transformation_kind(F.col("value"), text.basic_form(F.col("value"))).alias("kind"))
