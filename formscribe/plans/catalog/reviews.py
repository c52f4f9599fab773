"""Review loop over items and decisions derived from the events table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.operators import review as R
from formscribe.operators.profile import KEY
from formscribe.plans.catalog import query
from formscribe.plans.views import sql_view, view

AS_OF = "2024-01-25 12:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def shown(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an item that was queued an hour before its decision."""
    return view(spark, sf_dir, "v_reviews").select(
        "id",
        KEY,
        "original_value",
        F.lit("needs_review").alias("verdict"),
        "confidence",
        (F.col("reviewed_at") - F.expr("interval 1 hour")).alias("ts"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all but the `view` items, a late second decision on the `error` items, and decisions
    without an item for the signups."""
    base = view(spark, sf_dir, "v_reviews").where(F.col(KEY) != "view")
    columns = ["id", "decision", "corrected_value", "reviewed_at"]
    late = F.col("reviewed_at") + F.expr("interval 1 hour")
    second = base.where(F.col(KEY) == "error").select(
        "id", F.lit("reject").alias("decision"), F.lit(None).cast("string").alias("corrected_value"), late.alias("reviewed_at")
    )
    stray = base.where(F.col(KEY) == "signup").withColumn("id", F.concat(F.lit("x"), "id")).select(*columns)
    return base.select(*columns).unionByName(second).unionByName(stray)


_SQL = f"""with r as ({sql_view('v_reviews')}),
    items as (select id, composite_key, original_value, confidence, reviewed_at - interval 1 hour as ts from r),
    decided as (select id, decision, corrected_value, reviewed_at from r where composite_key <> 'view'),
    history as (select items.*, decision, case when decision = 'edit' then corrected_value end as corrected_value, reviewed_at
                from items join decided using (id)),
    pending as (select * from items where id not in (select id from decided))"""
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') as {0}"


@query(
    "review_queue",
    f"{_SQL} select id, composite_key, {_STAMP.format('ts')} from pending order by pending.ts, id limit 100",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = R.pending_items(items(spark, sf_dir), decisions(spark, sf_dir))
    return R.review_batch(pending).select("id", KEY, shown("ts"))


@query("pending_items", f"{_SQL} select id, composite_key, original_value from pending")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending_items(items(spark, sf_dir), decisions(spark, sf_dir)).select("id", KEY, "original_value")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.review_history(items(spark, sf_dir), decisions(spark, sf_dir))


@query(
    "review_history",
    f"{_SQL} select id, composite_key, original_value, decision, corrected_value, {_STAMP.format('reviewed_at')} from history",
)
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("id", KEY, "original_value", "decision", "corrected_value", shown("reviewed_at"))


@query("unmatched_decisions", f"{_SQL} select 'x' || id as id, decision from r where composite_key = 'signup'")
def unmatched_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unmatched_decisions(items(spark, sf_dir), decisions(spark, sf_dir)).select("id", "decision")


@query(
    "labeled_examples",
    f"""{_SQL} select composite_key, original_value, decision as human_decision, corrected_value,
      round(confidence, 6) as confidence, {_STAMP.format('reviewed_at')} from history""",
)
def labeled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = R.labeled_examples(history(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
    return labels.withColumn("reviewed_at", shown("reviewed_at"))


@query(
    "rule_updates",
    f"""{_SQL} select composite_key, original_value, corrected_value, decision, {_STAMP.format('reviewed_at')} from history
    where decision in ('accept', 'edit')""",
)
def rule_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rule_updates(history(spark, sf_dir)).withColumn("reviewed_at", shown("reviewed_at"))


@query(
    "retrain_keys",
    f"""{_SQL} select composite_key, count(*) as recent_labels from history
    where reviewed_at > timestamp '{AS_OF}' - interval 1 day and reviewed_at <= timestamp '{AS_OF}'
    group by 1 having count(*) >= 10""",
)
def retrain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrain_keys(R.labeled_examples(history(spark, sf_dir)), as_of())


@query(
    "keep_recent",
    f"{_SQL} select id, decision from history where reviewed_at > timestamp '{AS_OF}' - interval 14 day",
)
def keep_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_recent(history(spark, sf_dir), "reviewed_at", as_of(), days=14).select("id", "decision")


_STATS_SQL = """(select count(*) as total_reviewed, (select count(*) from pending) as pending_review,
      round(coalesce(avg(confidence), 0), 6) as confidence_mean, round(coalesce(stddev_pop(confidence), 0), 6) as confidence_std,
      round(coalesce(min(confidence), 0), 6) as confidence_min, round(coalesce(max(confidence), 0), 6) as confidence_max,
      count(distinct composite_key) as keys_with_examples,
      count(distinct composite_key) filter (where decision in ('accept', 'edit')) as keys_with_rule_updates from history)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("confidence_")})


@query("review_statistics", f"{_SQL} select * from {_STATS_SQL}")
def review_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.review_statistics(items(spark, sf_dir), decisions(spark, sf_dir)))


@query(
    "decision_distribution",
    f"""{_SQL} select '' as composite_key, decision, count(*) as "count" from history group by 2
    union all select composite_key, decision, count(*) from history group by 1, 2""",
)
def decision_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = history(spark, sf_dir)
    overall = R.decision_distribution(decided).withColumn(KEY, F.lit(""))
    return overall.unionByName(R.decision_distribution(decided, per_key=True))


_KIND = """case when original_value = corrected_value then null
        when lower(original_value) = lower(corrected_value) then 'case_normalization'
        when contains(original_value, ' ') and replace(original_value, ' ', '') = corrected_value then 'space_removal'
        when length(original_value) > length(corrected_value) then 'trimming' end"""
_PATTERNS = f"""pat as (select composite_key, {_KIND} as pattern, count(*) as n from history where decision = 'edit' group by 1, 2),
    top as (select composite_key, pattern, n, row_number() over (partition by composite_key order by n desc, pattern) as rank,
            e.edits from pat join (select composite_key, sum(n) as edits from pat group by 1) e using (composite_key)
            where pattern is not null and e.edits >= 3)"""


@query(
    "correction_patterns",
    f"""{_SQL}, {_PATTERNS} select composite_key, pattern, n as "count", rank, cast(edits as bigint) as edits from top where rank <= 3""",
)
def correction_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = R.correction_patterns(history(spark, sf_dir))
    return patterns.withColumn("rank", F.col("rank").cast("long"))


@query(
    "proposed_rules",
    f"""{_SQL}, {_PATTERNS}, named as (select composite_key, case pattern when 'trimming' then 'trim_whitespace'
        when 'space_removal' then 'remove_space_between_number_and_unit' else 'case_normalization' end as name,
        case pattern when 'trimming' then 1 when 'space_removal' then 4 else 5 end as priority from top where rank <= 3)
    select composite_key, string_agg(priority || ':' || name, '|' order by priority) as rules from named group by 1""",
)
def proposed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.proposed_rules(R.correction_patterns(history(spark, sf_dir)))
    listed = F.transform("rules", lambda r: F.concat_ws(":", r["priority"].cast("string"), r["name"]))
    return rules.select(KEY, F.array_join(listed, "|").alias("rules"))


_PROGRESS = f"""progress as (select composite_key, count(*) as total_examples,
      count(*) filter (where reviewed_at > timestamp '{AS_OF}' - interval 7 day) as recent_examples,
      count(*) filter (where decision in ('accept', 'edit')) as rule_updates,
      count(*) filter (where decision = 'accept') as n_accept, count(*) filter (where decision = 'edit') as n_edit,
      count(*) filter (where decision = 'reject') as n_reject, max(reviewed_at) as last_learning,
      round(count(*) filter (where reviewed_at > timestamp '{AS_OF}' - interval 7 day) / 7.0, 6) as learning_rate
    from history group by 1)"""


@query(
    "learning_progress",
    f"""{_SQL}, {_PROGRESS} select * replace (strftime(last_learning, '%Y-%m-%d %H:%M:%S.%f') as last_learning,
      cast(learning_rate as double) as learning_rate) from progress""",
)
def learning_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = R.learning_progress(history(spark, sf_dir), as_of())
    return progress.withColumns({"last_learning": shown("last_learning"), "learning_rate": F.round("learning_rate", 6)})


@query(
    "learning_report",
    f"""{_SQL}, {_PROGRESS}, s as {_STATS_SQL}
    select s.*, (select cast(sum(total_examples) as bigint) from progress) as total_examples,
      (select cast(sum(rule_updates) as bigint) from progress) as total_rule_updates,
      (select count(*) from progress) as keys_learning,
      concat_ws('|', case when pending_review > 50 then 'High review queue - consider increasing review capacity' end,
        case when confidence_mean < 0.7 then 'Low average confidence - consider improving pattern detection' end) as recommendations
    from s""",
)
def learning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = R.learning_report(items(spark, sf_dir), decisions(spark, sf_dir), as_of())
    return _rounded(report).withColumn("recommendations", F.array_join("recommendations", "|"))


@query(
    "key_recommendations",
    f"""{_SQL}, {_PROGRESS} select composite_key, 'Key ' || composite_key || ' has many rule updates - consider pattern refinement'
      as recommendation from progress where rule_updates > 20""",
)
def key_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.key_recommendations(R.learning_progress(history(spark, sf_dir), as_of()))


@query(
    "enqueue_reviews",
    f"""with v_customers as ({sql_view('v_customers')})
    select md5('customers-' || row_id) as id, key_part1 || '||' || key_part2 || '||' || key_part3 as composite_key,
      value as original_value, cast(0.0 as double) as confidence from v_customers""",
)
def enqueue_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of unknown keys all go to review, under the id of their request."""
    from formscribe.operators.validate import validate_values
    from formscribe.plans.catalog.validation import learnt, requests

    profiles, rules = learnt(spark, sf_dir)
    verdicts = validate_values(requests(spark, sf_dir), profiles, rules, as_of=as_of())
    return R.review_items(verdicts).select("id", KEY, "original_value", "confidence")
