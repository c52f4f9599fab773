"""Cleaning rules: hints, rule rows, application, evaluation, pattern coverage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import SMALL_DATA
from formscribe.operators import coverage as C
from formscribe.operators import normalize as N
from formscribe.operators.keys import add_composite_key
from formscribe.operators.profile import KEY, key_patterns, key_profiles
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.profiles import profile_cte
from formscribe.plans.views import view

NAMES = [name for name, _ in N.HINTED_RULES]
_TESTS = ("pct_whitespace > 10", "pct_parentheses > 5", "pct_commas > 10", "is_numeric_unit", "pct_letters > 80", "pct_special > 20")


def hints_cte(source: str = "prof", name: str = "hints", compat: bool = False) -> str:
    """CTE with one flag per rule, the rule list as text, and the confidence."""
    tests = [("false" if compat and i in (0, 5) else t) for i, t in enumerate(_TESTS)]
    flags = ", ".join(f"({t}) as h{i}" for i, t in enumerate(tests, 1))
    listed = ", ".join(f"case when {t} then '{n}' end" for t, n in zip(tests, NAMES))
    n_rules = " + ".join(f"(case when {t} then 1 else 0 end)" for t in tests)
    spaces = "false" if compat else "pct_whitespace > 20"
    return f"""{name} as (select composite_key, {flags}, concat_ws('|', {listed}) as hints, {n_rules} as n_rules,
      case when {n_rules} = 0 then 0.0 else round(0.5 + case when {spaces} then 0.1 else 0.0 end
        + case when pct_parentheses > 10 then 0.1 else 0.0 end + case when is_numeric_unit then 0.2 else 0.0 end, 6) end
        as confidence from {source})"""


_STEPS = (
    duck.collapse_whitespace,
    duck.cleaned,
    duck.drop_thousands_separators,
    duck.join_number_and_unit,
    lambda v: f"lower({v})",
    duck.collapse_punctuation,
)


def normalized_ctes(source: str, value: str = "value") -> str:
    """CTEs s1..s6 over a source with flags h1..h6; the last one has column `normalized`."""
    ctes = [f"s0 as (select *, {value} as w0 from {source})"]
    for i, step in enumerate(_STEPS, 1):
        w = f"w{i - 1}"
        ctes.append(f"s{i} as materialized (select *, case when coalesce(h{i}, false) then {step(w)} else {w} end as w{i} from s{i - 1})")
    ctes.append("normed as (select *, w6 as normalized from s6)")
    return ", ".join(ctes)


@query(
    "rule_hints",
    f"""{profile_cte('parts')}, {hints_cte()}, {hints_cte(name='c', compat=True)}
    select hints.composite_key, hints.hints, c.hints as compat_hints from hints join c using (composite_key)""",
)
def rule_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = key_profiles(view(spark, sf_dir, "v_parts"))
    both = N.profile_hints(profiles).withColumnRenamed("hints", "fixed")
    both = N.profile_hints(both, compat=True)
    return both.select(KEY, F.array_join("fixed", "|").alias("hints"), F.array_join("hints", "|").alias("compat_hints"))


def _register_rules(name: str, compat: bool) -> None:
    suffix = "_compat" if compat else ""

    @query(
        f"rule_rows_{name}{suffix}",
        f"""{profile_cte(name)}, {hints_cte(compat=compat)} select composite_key, hints as rules, cast(n_rules as bigint) as n_rules,
        cast(confidence as double) as confidence from hints""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = N.rules_from_profiles(key_profiles(view(spark, sf_dir, f"v_{name}")), compat)
        names = F.transform("rules", lambda r: r["name"])
        return rules.select(
            KEY,
            F.array_join(names, "|").alias("rules"),
            F.size("rules").cast("long").alias("n_rules"),
            F.round("confidence", 6).alias("confidence"),
        )


for _view in ("parts", "pages", "sizes"):
    _register_rules(_view, False)
_register_rules("parts", True)


def _applied(name: str) -> str:
    return f"""{profile_cte(name)}, {hints_cte()},
    src as (select k.composite_key, k.row_id, k.value, h.* exclude (composite_key) from keyed k left join hints h using (composite_key)),
    {normalized_ctes('src')}"""


def _register_normalize(name: str) -> None:
    @query(
        f"normalize_{name}",
        f"""{_applied(name)} select composite_key, row_id, value, normalized, hints as applied_rules,
        case when h2 then {duck.comment('w1')} end as comment, normalized <> value as changed from normed""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = view(spark, sf_dir, f"v_{name}")
        rules = N.rules_from_profiles(key_profiles(items))
        out = N.normalize_values(add_composite_key(items), rules)
        return out.select(
            KEY,
            "row_id",
            "value",
            "normalized",
            F.array_join("applied_rules", "|").alias("applied_rules"),
            "comment",
            (F.size("changed_by") > 0).alias("changed"),
        )


for _view in ("parts", "docs", "pages"):
    _register_normalize(_view)


@query(
    "evaluate_rules",
    f"""{profile_cte('parts')}, {hints_cte()}, k2 as (select * from hints where composite_key not like 'PROMO%'),
    src as (select k.composite_key, k.row_id, k.value, k2.* exclude (composite_key) from keyed k left join k2 using (composite_key)),
    {normalized_ctes('src')},
    f as (select composite_key, normalized, row_number() over (partition by composite_key order by row_id, value) as r from normed)
    select composite_key, count(*) as total_values, count(*) filter (where n_rules > 0) as values_touched,
      count(*) filter (where normalized <> value) as values_changed,
      round(count(*) filter (where n_rules > 0) * 1.0 / count(*), 6) as change_rate,
      (select string_agg(normalized, '^' order by r) from f where f.composite_key = normed.composite_key and r <= 5) as normalized_values,
      case when any_value(n_rules) is null then 'No rules found for key' end as error
    from normed group by composite_key""",
)
def evaluate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_parts")
    rules = N.rules_from_profiles(key_profiles(items)).where(~F.col(KEY).startswith("PROMO"))
    out = N.evaluate_rules(add_composite_key(items), rules)
    return out.withColumns(
        {"change_rate": F.round("change_rate", 6), "normalized_values": F.array_join("normalized_values", "^")}
    )


_COVERAGE = f"""{profile_cte('parts', 2, 5.0)},
    t as (select composite_key, value, sig, candidate_regex,
      case when candidate_regex is null then false else {duck.matches_prefix('value', 'candidate_regex')} end as matched
      from keyed join prof using (composite_key)),
    cov as (select composite_key, count(*) as total_tested, count(*) filter (where matched) as matches,
      count(*) filter (where not matched) as non_matches, count(*) filter (where matched) * 1.0 / count(*) as coverage,
      count(distinct sig) filter (where not matched) as missed_signatures from t group by 1)"""


@query(
    "pattern_coverage",
    f"{_COVERAGE} select * exclude (coverage), round(coverage, 6) as coverage from cov",
)
def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_parts")
    covered = C.pattern_coverage(add_composite_key(items), key_patterns(items, SMALL_DATA))
    return covered.withColumn("coverage", F.round("coverage", 6))


@query(
    "pattern_suggestions",
    f"""{_COVERAGE} select composite_key, concat_ws('|',
      case when coverage < 0.8 and non_matches > 0 and missed_signatures <= 3
           then 'Consider adding patterns for common non-matching signatures' end,
      case when coverage < 0.8 and non_matches > 0 and missed_signatures > 3
           then 'Many unique patterns in non-matches - may need clustering analysis' end,
      case when coverage < 0.5 then 'Low pattern coverage - consider if this key needs different approach' end) as suggestions
    from cov""",
)
def pattern_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_parts")
    covered = C.pattern_coverage(add_composite_key(items), key_patterns(items, SMALL_DATA))
    return C.pattern_suggestions(covered).select(KEY, F.array_join("suggestions", "|").alias("suggestions"))

