"""Streaming forms, run to the end of the given files and compared with their batch results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.operators.profile import KEY
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.rules import hints_cte, normalized_ctes
from formscribe.plans.catalog.profiles import profile_cte
from formscribe.plans.views import load, sql_view, with_views
from formscribe.session import scratch_path
from formscribe.streaming import streams as R


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = R.read_files(spark, f"{sf_dir}/events*.parquet", load(spark, sf_dir, "events"))
    value = F.col("value")
    decision = F.when(value < 20, "accept").when(value < 40, "edit").otherwise("reject")
    return stream.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias(KEY),
        decision.alias("decision"),
        F.col("props").alias("corrected_value"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = R.read_files(spark, f"{sf_dir}/orders*.parquet", load(spark, sf_dir, "orders"))
    return stream.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("key_part1"),
        F.year("o_orderdate").cast("string").alias("key_part2"),
        F.lit("priority").alias("key_part3"),
        F.col("o_orderpriority").alias("value"),
    )


def _complete(spark: SparkSession, stream: DataFrame, label: str, mode: str) -> DataFrame:
    out = scratch_path(spark, label)
    R.write_table(stream, f"{out}/table", f"{out}/progress", mode).awaitTermination()
    return spark.read.parquet(f"{out}/table") if mode == "append" else R.read_latest(spark, f"{out}/table")


def _windows(hours: int, step_hours: int, count: int) -> str:
    start = f"time_bucket(interval {step_hours} hour, ts, timestamp '1970-01-01')"
    return f"""with r as ({sql_view('v_reviews').replace('ts as reviewed_at', 'ts')}),
    w as (select composite_key, {start} - to_hours({step_hours} * i) as window_start from r, range({count}) t(i))"""


_STAMP = "strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "retrain_windows",
    f"""{_windows(24, 1, 24)}, c as (select composite_key, window_start, count(*) as labels from w group by 1, 2)
    select composite_key, {_STAMP}, labels from c where labels >= 10""",
)
def retrain_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_complete(spark, R.retrain_windows(_reviews(spark, sf_dir)), "retrain", "complete"))


@query(
    "weekly_rates",
    f"""{_windows(168, 24, 7)}, c as (select composite_key, window_start, count(*) as labels from w group by 1, 2)
    select composite_key, {_STAMP}, labels, cast(round(labels / 7.0, 6) as double) as learning_rate from c""",
)
def weekly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _shown(_complete(spark, R.weekly_rates(_reviews(spark, sf_dir)), "rates", "complete"))
    return rates.withColumn("learning_rate", F.round("learning_rate", 6))


@query(
    "first_submits",
    "select cast(event_id as varchar) as id, event_type as composite_key from events",
)
def first_submits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision is sent twice; one of each arrives."""
    reviews = _reviews(spark, sf_dir)
    twice = reviews.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return _complete(spark, R.first_submits(twice), "submits", "append").select("id", KEY)


@query(
    "stream_statistics",
    f"""{with_views('v_orders')}, {duck.keyed('v_orders')}
    select composite_key, count(*) as "count", count(distinct value) as unique_values, count(distinct sig) as signatures from keyed group by 1""",
)
def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "statistics")
    R.statistics_stream(_orders(spark, sf_dir), f"{out}/table", f"{out}/progress").awaitTermination()
    merged = R.merged_statistics(spark, f"{out}/table")
    return merged.select(KEY, "count", "unique_values", F.size("top_signatures").cast("long").alias("signatures"))


@query(
    "stream_validation",
    f"""{profile_cte('orders')}, {hints_cte()}, src as (select k.*, p.candidate_regex, h.* exclude (composite_key)
      from keyed k join prof p using (composite_key) join hints h using (composite_key)), {normalized_ctes('src')},
    f as (select row_id, composite_key, case when candidate_regex is null then true else {duck.matches_prefix('normalized', 'candidate_regex')} end as ok from normed)
    select row_id, composite_key, 'accepted' as verdict, cast(case when ok then 1.0 else 0.6 end as double) as confidence from f""",
)
def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.normalize import rules_from_profiles
    from formscribe.operators.profile import key_profiles
    from formscribe.plans.views import view
    from formscribe.session import cut_lineage

    out = scratch_path(spark, "validation")
    profiles = cut_lineage(key_profiles(view(spark, sf_dir, "v_orders")))
    rules = cut_lineage(rules_from_profiles(profiles))
    requests = _orders(spark, sf_dir).select("row_id", F.array("key_part1", "key_part2", "key_part3").alias("key_parts"), "value")
    R.validation_stream(requests, profiles, rules, f"{out}/table", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("row_id", KEY, "verdict", "confidence")


@query(
    "merged_medians",
    f"""with v_orders as ({sql_view('v_orders')}), k as (select {duck.key()} as composite_key, length(value) as n from v_orders where value is not null)
    select composite_key, count(*) as "count", round(avg(n), 6) as mean, cast(min(n) as bigint) as min, cast(max(n) as bigint) as max, true as near from k group by 1""",
)
def merged_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length statistics of several batches, some of them folded; the median's true rank is within the stated error."""
    from formscribe.operators.keys import add_composite_key
    from formscribe.operators.merge import RANK_ERROR, merge_length_sketches
    from formscribe.plans.views import view

    out, path = scratch_path(spark, "lengths"), scratch_path(spark, "items")
    items = view(spark, sf_dir, "v_orders")
    items.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(path)
    R.length_stream(stream, f"{out}/table", f"{out}/progress").awaitTermination()
    R.compact_batches(spark, f"{out}/table", merge_length_sketches)
    merged = R.merged_lengths(spark, f"{out}/table")
    each = add_composite_key(items).where("value is not null").join(merged.select(KEY, "median"), KEY)
    length = F.length("value")
    ranks = each.groupBy(KEY).agg(F.avg((length < F.col("median")).cast("double")).alias("below"), F.avg((length <= F.col("median")).cast("double")).alias("upto"))
    near = (F.col("below") <= 0.5 + RANK_ERROR) & (F.col("upto") >= 0.5 - RANK_ERROR)
    return merged.join(ranks, KEY).select(KEY, "count", F.round("mean", 6).alias("mean"), "min", "max", near.alias("near"))


@query("review_outcomes")
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and their decisions as two streams. Items without a decision are held until the watermark
    passes their time-out, so the last of them are still open when the files end."""
    reviews = _reviews(spark, sf_dir)
    items = reviews.select("id", KEY, (F.col("reviewed_at") - F.expr("interval 1 hour")).alias("ts"))
    decided = _reviews(spark, sf_dir).where(F.col(KEY) != "view")
    return _complete(spark, R.review_outcomes(items, decided), "outcomes", "append")
