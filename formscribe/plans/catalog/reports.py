"""Summaries over profiles and stage tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.operators import ranking
from formscribe.operators import report as S
from formscribe.operators.normalize import rules_from_profiles
from formscribe.operators.profile import KEY, key_profiles, key_stats
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.profiles import profile_cte
from formscribe.plans.views import load, sql_view, view, with_views

_KEYS = f"""{with_views('v_parts')}, k as (select {duck.key()} as composite_key, value, row_id from v_parts),
    st as (select composite_key, count(*) as cnt, count(distinct value) as uniq, count(distinct value) * 1.0 / count(*) as ratio
           from k group by 1)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_stats(view(spark, sf_dir, "v_parts"))


@query(
    "key_type_counts",
    f"""{profile_cte('parts')} select count(*) as total_keys, count(*) filter (where is_free_text) as free_text_keys,
      count(*) filter (where is_numeric_unit) as numeric_keys,
      count(*) - count(*) filter (where is_free_text) - count(*) filter (where is_numeric_unit) as structured_keys,
      count(*) filter (where is_free_text and is_numeric_unit) as overlap from prof""",
)
def key_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_type_counts(key_profiles(view(spark, sf_dir, "v_parts")))


def _histogram_sql(column: str) -> str:
    return f"""{_KEYS}, s as (select min({column}) as lo, max({column}) as hi from st)
    select cast(case when hi = lo then 0 else least(floor(({column} - lo) / ((hi - lo) / 20.0)), 19) end as bigint) as bin,
      count(*) as "count" from st, s group by 1"""


@query("count_histogram", _histogram_sql("cnt"))
def count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(_stats(spark, sf_dir), "count")


@query("ratio_histogram", _histogram_sql("ratio"))
def ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(_stats(spark, sf_dir), "unique_ratio")


@query(
    "key_overview",
    f"""{_KEYS} select count(*) as total_keys, cast(sum(cnt) as bigint) as total_values, round(avg(cnt), 6) as mean_values_per_key,
      cast(sum(uniq) as bigint) as total_unique, round(avg(ratio), 6) as mean_unique_ratio,
      count(*) filter (where ratio > 0.8) as free_text_keys from st""",
)
def key_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    overview = S.key_overview(_stats(spark, sf_dir))
    return overview.withColumns({c: F.round(c, 6) for c in ("mean_values_per_key", "mean_unique_ratio")})


@query(
    "largest_keys",
    f"""{_KEYS} select composite_key, cnt as "count", uniq as unique_values, round(ratio, 6) as unique_ratio
    from st order by cnt desc, composite_key limit 10""",
)
def largest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.largest_keys(_stats(spark, sf_dir)).withColumn("unique_ratio", F.round("unique_ratio", 6))


@query(
    "preview",
    "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, (select count(*) from part) as total_rows, "
    "6 as total_columns from part order by p_partkey limit 10",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.sources.tables import preview as shown

    return shown(load(spark, sf_dir, "part"), 10, order="p_partkey")


@query(
    "run_report",
    f"""{_KEYS} select count(*) as total_rows, (select count(*) from st) as unique_keys, (select count(*) from st) as key_profiles,
      (select count(*) from st) as normalization_rules, (select count(*) from st) as clustering_models,
      (select count(*) from embeddings) as embedding_vectors from k""",
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_parts")
    profiles = key_profiles(items)
    rules = rules_from_profiles(profiles)
    return S.run_report(items, profiles, rules, profiles.select(KEY), load(spark, sf_dir, "embeddings"))


@query(
    "service_counts",
    f"""{_KEYS}, r as ({sql_view('v_reviews')}) select count(*) as total_keys,
      (select count(*) from r where composite_key = 'view') as review_queue_size,
      (select count(distinct label) from embeddings) as indices_loaded, count(*) as normalization_rules_loaded from st""",
)
def service_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.review import pending_items
    from formscribe.plans.catalog.reviews import decisions, items

    profiles = key_profiles(view(spark, sf_dir, "v_parts"))
    pending = pending_items(items(spark, sf_dir), decisions(spark, sf_dir))
    vectors = load(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias(KEY))
    return S.service_counts(profiles, pending, vectors, rules_from_profiles(profiles))


_SPREAD = """count(confidence) as "count", round(coalesce(avg(confidence), 0), 6) as mean, round(coalesce(stddev_pop(confidence), 0), 6) as std,
      round(coalesce(min(confidence), 0), 6) as min, round(coalesce(max(confidence), 0), 6) as max,
      round(coalesce(median(confidence), 0), 6) as median"""


@query(
    "similarity_stats",
    f"""with r as ({sql_view('v_reviews')}) select composite_key, {_SPREAD} from r group by 1
    union all select '', {_SPREAD} from r""",
)
def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population std, extremes and exact median of a score, per key and overall."""
    scores = view(spark, sf_dir, "v_reviews")
    per_key = ranking.spread(scores, [KEY], "confidence")
    overall = ranking.spread(scores, [], "confidence").withColumn(KEY, F.lit(""))
    both = per_key.unionByName(overall)
    return both.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max", "median")})


@query(
    "most_common_unit",
    f"""{with_views('v_sizes')}, u as (select key_part1, regexp_extract(value, '([A-Za-z]+)$', 1) as unit from v_sizes)
    select key_part1, unit from (select key_part1, unit, row_number() over (partition by key_part1 order by count(*) desc, unit) as r
      from u group by 1, 2) where r = 1""",
)
def most_common_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.functions.text import number_and_unit

    units = view(spark, sf_dir, "v_sizes").withColumn("unit", number_and_unit(F.col("value"))["unit"])
    return ranking.most_common(units, ["key_part1"], "unit", F.lit(1), "unit")
