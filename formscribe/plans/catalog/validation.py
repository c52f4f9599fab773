"""Batch validation with and without neighbours."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import SMALL_DATA
from formscribe.operators import validate as D
from formscribe.operators.keys import add_composite_key
from formscribe.operators.normalize import rules_from_profiles
from formscribe.operators.profile import KEY, key_profiles, key_stats
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.profiles import joined_signatures, profile_cte
from formscribe.plans.catalog.rules import hints_cte, normalized_ctes
from formscribe.plans.views import VIEWS, sql_view, view
from formscribe.session import cut_lineage

AS_OF = "2024-02-01 00:00:00"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts (known keys), all customers (unknown keys) and all page addresses with two key parts only."""

    def of(name: str, parts: list[str]) -> DataFrame:
        key_parts = F.array(*[F.col(p) for p in parts])
        request = F.concat(F.lit(f"{name}-"), F.col("row_id").cast("string"))
        return view(spark, sf_dir, f"v_{name}").select(request.alias("request_id"), key_parts.alias("key_parts"), "value")

    three = ["key_part1", "key_part2", "key_part3"]
    return of("parts", three).unionByName(of("customers", three)).unionByName(of("pages", three[:2]))


REQUESTS_CTE = f"""reqs as (
    select 'parts-' || row_id as request_id, 3 as n_parts, {duck.key()} as composite_key, value from v_parts
    union all select 'customers-' || row_id, 3, {duck.key()}, value from ({sql_view('v_customers')})
    union all select 'pages-' || row_id, 2, null, value from ({sql_view('v_pages')}))"""

_PREPARED = f"""{profile_cte('parts', 2, 5.0)}, {hints_cte()}, {REQUESTS_CTE},
    src as (select r.*, p.composite_key is not null as known, p.candidate_regex, h.* exclude (composite_key)
            from reqs r left join prof p on r.composite_key = p.composite_key
                 left join hints h on r.composite_key = h.composite_key),
    {normalized_ctes('src')},
    prep as (select *, case when candidate_regex is null then true
      else {duck.matches_prefix('normalized', 'candidate_regex')} end as format_ok from normed)"""


@query(
    "validate_values",
    f"""{_PREPARED} select request_id, composite_key, value as original_value,
      case when n_parts <> 3 then 'rejected' when not known then 'needs_review' else 'accepted' end as verdict,
      case when n_parts <> 3 then 'invalid_key_parts' when not known then 'unknown_key'
           when not format_ok then 'format_mismatch' else '' end as issues,
      cast(null as varchar) as suggested_fix,
      cast(case when n_parts <> 3 or not known then 0.0 when format_ok then 1.0 else 0.6 end as double) as confidence,
      case when known then hints else '' end as rules_applied
    from prep""",
)
def validate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_validated(spark, sf_dir))


@query(
    "validate_values_review_mismatch",
    f"""{_PREPARED} select request_id, composite_key, value as original_value,
      case when n_parts <> 3 then 'rejected' when not known or not format_ok then 'needs_review' else 'accepted' end as verdict,
      case when n_parts <> 3 then 'invalid_key_parts' when not known then 'unknown_key'
           when not format_ok then 'format_mismatch' else '' end as issues,
      cast(null as varchar) as suggested_fix,
      cast(case when n_parts <> 3 or not known then 0.0 when format_ok then 1.0 else 0.6 end as double) as confidence,
      case when known then hints else '' end as rules_applied
    from prep""",
)
def validate_values_review_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_validated(spark, sf_dir, inclusive=True))


def learnt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, rules) as stored stage tables: validation reads them several times."""
    profiles = cut_lineage(key_profiles(view(spark, sf_dir, "v_parts"), SMALL_DATA))
    return profiles, rules_from_profiles(profiles)


def _validated(spark: SparkSession, sf_dir: str, inclusive: bool = False) -> DataFrame:
    profiles, rules = learnt(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("timestamp")
    return D.validate_values(requests(spark, sf_dir), profiles, rules, inclusive=inclusive, as_of=as_of)


def _flat(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "request_id",
        KEY,
        "original_value",
        "verdict",
        F.array_join("issues", "|").alias("issues"),
        "suggested_fix",
        "confidence",
        F.array_join("rules_applied", "|").alias("rules_applied"),
    )


@query(
    "validation_log",
    f"""{_PREPARED}, l as (select request_id, case when n_parts <> 3 then 'rejected' when not known then 'needs_review' else 'accepted' end as verdict,
      case when n_parts <> 3 or not known then 0.0 when format_ok then 1.0 else 0.6 end as confidence from prep)
    select verdict, cast(confidence as double) as confidence, '{AS_OF}' as logged_at, count(*) as "count" from l group by 1, 2""",
)
def validation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries carry one time stamp per batch."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    log = _validated(spark, sf_dir).select("verdict", "confidence", stamp.alias("logged_at"))
    return log.groupBy("verdict", "confidence", "logged_at").agg(F.count(F.lit(1)).alias("count"))


@query(
    "simple_verdict",
    f"""{profile_cte('parts', 2, 5.0)},
    m as (select k.composite_key, k.row_id, p.candidate_regex, string_split(p.samples, '^')[1] as first_sample,
      case when p.candidate_regex is null then false else {duck.matches_prefix('k.value', 'p.candidate_regex')} end as matched
      from keyed k join prof p using (composite_key))
    select composite_key, row_id,
      case when matched then 'accepted' when candidate_regex is not null then 'reformatted' else 'needs_review' end as verdict,
      case when candidate_regex is not null and not matched then 'format_mismatch' else '' end as issues,
      case when candidate_regex is not null and not matched then first_sample end as suggested_fix,
      cast(case when matched then 0.9 when candidate_regex is not null then 0.0 else 0.3 end as double) as confidence
    from m""",
)
def simple_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_parts")
    profiles = key_profiles(items, SMALL_DATA).select(KEY, "candidate_regex", "sample_values")
    outcome = D.simple_verdict(F.col("value"), F.col("candidate_regex"), F.col("sample_values"))
    joined = add_composite_key(items).join(profiles, KEY).withColumn("_v", outcome)
    return joined.select(
        KEY, "row_id", "_v.verdict", F.array_join("_v.issues", "|").alias("issues"), "_v.suggested_fix", "_v.confidence"
    )


@query(
    "verdict_table",
    """with s as (select event_id, props like '%5%' as format_ok,
        case when value / 100.0 < 0.82 then null when value > 100 then 1.0 else value / 100.0 end as similarity from events)
    select event_id, case when similarity > 0.95 then 'duplicate' when format_ok and (similarity is null or similarity <= 0.85) then 'accepted'
        when not format_ok and similarity is not null then 'reformatted' when similarity > 0.85 then 'duplicate' else 'accepted' end as verdict,
      case when similarity > 0.95 then 'near_duplicate' else concat_ws('|', case when not format_ok then 'format_mismatch' end,
        case when similarity > 0.85 then 'near_duplicate' end) end as issues,
      case when not format_ok and similarity <= 0.95 then 'nearest' end as suggested_fix,
      round(cast(case when similarity > 0.95 then similarity else case when similarity > 0.85 then 0.8 else 1.0 end
        * case when format_ok then 1.0 else 0.6 end end as double), 6) as confidence
    from s""",
)
def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the verdict, with event values standing in for similarities."""
    from formscribe.plans.views import load

    raw = F.col("value") / 100.0
    similarity = F.when(raw >= 0.82, F.least(raw, F.lit(1.0)))
    nearest = F.when(similarity.isNotNull(), F.array(F.lit("nearest"))).otherwise(F.array().cast("array<string>"))
    outcome = D.verdict(F.contains("props", F.lit("5")), similarity, nearest)
    events = load(spark, sf_dir, "events").withColumn("_v", outcome)
    return events.select(
        "event_id",
        "_v.verdict",
        F.array_join("_v.issues", "|").alias("issues"),
        "_v.suggested_fix",
        F.round("_v.confidence", 6).alias("confidence"),
    )


@query(
    "review_route",
    f"""with r as ({sql_view('v_reviews')}) select id, case when confidence >= 0.95 then 'auto_accept'
      when confidence >= 0.6 then 'review' else 'reject' end as route from r""",
)
def review_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_reviews").select("id", D.review_route(F.col("confidence")).alias("route"))


@query(
    "profile_lookup",
    f"""{profile_cte('parts', 2, 5.0)}, {REQUESTS_CTE}
    select request_id, reqs.composite_key, candidate_regex from reqs join prof using (composite_key)""",
)
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = key_profiles(view(spark, sf_dir, "v_parts"), SMALL_DATA)
    known = D.keyed_requests(requests(spark, sf_dir)).join(profiles, KEY)
    return known.select("request_id", KEY, "candidate_regex")


@query(
    "unknown_keys",
    f"""with v_parts as ({sql_view('v_parts')}), {REQUESTS_CTE}
    select request_id, composite_key from reqs where n_parts = 3
      and composite_key not in (select {duck.key()} from v_parts)""",
)
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = key_stats(view(spark, sf_dir, "v_parts"))
    keyed = D.keyed_requests(requests(spark, sf_dir)).where("key_ok")
    return D.unknown_keys(keyed, profiles).select("request_id", KEY)


@query(
    "values_of_known_keys",
    f"""with v_parts as ({sql_view('v_parts')}), {REQUESTS_CTE}
    select request_id, value from reqs where composite_key in (select {duck.key()} from v_parts)""",
)
def values_of_known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = key_stats(view(spark, sf_dir, "v_parts"))
    return D.values_of_known_keys(D.keyed_requests(requests(spark, sf_dir)), profiles).select("request_id", "value")


@query(
    "profiles_without_values",
    f"""with k as (select distinct {duck.key()} as composite_key from ({VIEWS['v_parts'].replace('{part}', 'part')}))
    select composite_key from k where composite_key not like 'PROMO%'""",
)
def profiles_without_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all parts against the values of promoted parts only."""
    items = add_composite_key(view(spark, sf_dir, "v_parts"))
    return D.profiles_without_values(key_stats(items), items.where(F.col("key_part1").startswith("PROMO")))


@query(
    "served_profiles",
    f"""{profile_cte('parts', 2, 5.0)}, {hints_cte()} select prof.composite_key, "count", signatures, candidate_regex,
      hints as rules, cast(0.82 as double) as similarity_threshold from prof join hints using (composite_key)""",
)
def served_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = key_profiles(view(spark, sf_dir, "v_parts"), SMALL_DATA)
    served = D.served_profiles(profiles, rules_from_profiles(profiles))
    names = F.transform("normalization_rules", lambda r: r["name"])
    return served.select(
        KEY,
        "count",
        joined_signatures(F.col("top_signatures")).alias("signatures"),
        "candidate_regex",
        F.array_join(names, "|").alias("rules"),
        "similarity_threshold",
    )
