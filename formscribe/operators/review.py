"""Review loop as append-only tables.

review_items(id, composite_key, original_value, verdict, confidence, ..., ts) and
review_decisions(id, decision, corrected_value, notes, reviewed_at); everything else is derived.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators.normalize import RULE_TYPE
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import top_per_group


def review_items(validated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Verdicts that need a human. The id is a hash of the request's own id, else of key, value and time.

    A repeated micro-batch makes equal ids if requests bring `request_id` or `requested_at`, or `as_of` was given; with
    the time of the run instead, the same request gets another id.
    """
    named = ["request_id"] if "request_id" in validated.columns else [KEY, "original_value", "ts"]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in named]
    wanted = validated.where(F.col("verdict") == "needs_review")
    return wanted.withColumn("id", F.md5(F.concat_ws("\x1f", *parts)))


def pending_items(items: DataFrame, decisions: DataFrame) -> DataFrame:
    return items.join(decisions.select("id"), "id", "left_anti")


def review_batch(pending: DataFrame, size: int = Settings.review_batch) -> DataFrame:
    """The oldest open items, first in first out."""
    return pending.orderBy("ts", "id").limit(size)


def first_decisions(decisions: DataFrame) -> DataFrame:
    """One decision per id: a second submit finds the item gone, so the earliest one holds."""
    rest = [c for c in decisions.columns if c not in ("id", "reviewed_at")]
    earliest = F.min(F.struct("reviewed_at", *rest)).alias("_d")
    return decisions.groupBy("id").agg(earliest).select("id", "_d.*")


def review_history(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decided items; a corrected value is kept for edits only."""
    corrected = F.when((F.col("decision") == "edit") & (F.col("corrected_value") != ""), F.col("corrected_value"))
    chosen = first_decisions(decisions).withColumn("corrected_value", corrected)
    return items.join(chosen, "id")


def unmatched_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(items.select("id"), "id", "left_anti")


def labeled_examples(history: DataFrame) -> DataFrame:
    return history.select(
        KEY, "original_value", F.col("decision").alias("human_decision"), "corrected_value", "confidence", "reviewed_at"
    )


def rule_updates(history: DataFrame) -> DataFrame:
    kept = [c for c in ("rules_applied",) if c in history.columns]
    return history.where(F.col("decision").isin("accept", "edit")).select(
        KEY, "original_value", "corrected_value", "decision", "reviewed_at", *kept
    )


def retrain_keys(labels: DataFrame, as_of: Column, settings: Settings = Settings()) -> DataFrame:
    """Keys with enough labels in the day before `as_of`."""
    recent = (F.col("reviewed_at") > as_of - F.expr("interval 1 day")) & (F.col("reviewed_at") <= as_of)
    return (
        labels.where(recent)
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("recent_labels"))
        .where(F.col("recent_labels") >= settings.retrain_labels)
    )


def keep_recent(df: DataFrame, time_column: str, as_of: Column, days: int = Settings.keep_days) -> DataFrame:
    return df.where(F.col(time_column) > as_of - F.make_interval(days=F.lit(days)))


def review_statistics(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: reviewed, pending, confidence spread, keys with examples and with rule updates."""
    history = review_history(items, decisions)
    pending = pending_items(items, decisions).agg(F.count(F.lit(1)))
    updated = F.when(F.col("decision").isin("accept", "edit"), F.col(KEY))
    stats = history.agg(
        F.count(F.lit(1)).alias("total_reviewed"),
        *[
            F.coalesce(f("confidence"), F.lit(0.0)).alias(f"confidence_{n}")
            for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
        ],
        F.count_distinct(KEY).alias("keys_with_examples"),
        F.count_distinct(updated).alias("keys_with_rule_updates"),
    )
    return stats.withColumn("pending_review", pending.scalar())


def decision_distribution(history: DataFrame, per_key: bool = False) -> DataFrame:
    keys = [KEY] if per_key else []
    return history.groupBy(*keys, "decision").agg(F.count(F.lit(1)).alias("count"))


def correction_patterns(history: DataFrame, compat: bool = False, top: int = 3, minimum: int = 3) -> DataFrame:
    """Most common kinds of correction per key, for keys with at least three edits."""
    edits = history.where((F.col("decision") == "edit") & (F.col("corrected_value") != ""))
    kind = text.correction_kind(F.col("original_value"), F.col("corrected_value"), compat)
    # kinds are a fixed handful, so the per-key groups that follow are tiny
    counted = edits.groupBy(KEY, kind.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
    sizes = counted.groupBy(KEY).agg(F.sum("count").alias("edits")).where(F.col("edits") >= minimum)
    ranked = top_per_group(
        counted.where(F.col("pattern").isNotNull()), [KEY], [F.col("count").desc(), F.col("pattern")], top
    )
    return ranked.join(sizes, KEY)


# The cleaning rule that each kind of correction suggests.
_RULE_FOR = (
    ("trimming", "trim_whitespace", 1),
    ("space_removal", "remove_space_between_number_and_unit", 4),
    ("case_normalization", "case_normalization", 5),
)


def proposed_rules(patterns: DataFrame) -> DataFrame:
    """Rules table rows from correction patterns, ready for `normalize_values`."""
    name = F.create_map(*[F.lit(x) for kind, rule, _ in _RULE_FOR for x in (kind, rule)])
    priority = F.create_map(*[F.lit(x) for kind, _, order in _RULE_FOR for x in (kind, order)])
    lower = F.when(F.col("pattern") == "case_normalization", F.create_map(F.lit("case"), F.lit("lower"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    # the priority leads the sort; a map cannot be compared, so params stay outside the sorted part
    rule = F.struct(
        priority[F.col("pattern")].alias("priority"), name[F.col("pattern")].alias("name"), F.map_entries(lower).alias("params")
    )
    collected = F.array_sort(F.collect_list(rule))
    rules = F.transform(
        collected,
        lambda r: F.struct(
            r["name"].alias("name"), r["priority"].alias("priority"), F.map_from_entries(r["params"]).alias("params")
        ),
    )
    return patterns.groupBy(KEY).agg(rules.cast(RULE_TYPE).alias("rules"))


def learning_progress(history: DataFrame, as_of: Column) -> DataFrame:
    """Per key: examples, examples of the last 7 days, rule updates, decisions, last label, rate per day."""
    recent = F.count_if(F.col("reviewed_at") > as_of - F.expr("interval 7 days"))
    return history.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_examples"),
        recent.alias("recent_examples"),
        F.count_if(F.col("decision").isin("accept", "edit")).alias("rule_updates"),
        *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("accept", "edit", "reject")],
        F.max("reviewed_at").alias("last_learning"),
        (recent / 7.0).alias("learning_rate"),
    )


def learning_report(items: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """One row of totals with the general recommendations."""
    progress = learning_progress(review_history(items, decisions), as_of)
    totals = progress.agg(
        F.struct(
            F.sum("total_examples").alias("total_examples"),
            F.sum("rule_updates").alias("total_rule_updates"),
            F.count(F.lit(1)).alias("keys_learning"),
        )
    )
    stats = review_statistics(items, decisions).withColumn("_t", totals.scalar())
    # The advice texts and the limits at which they are given.
    advice = F.array_compact(
        F.array(
            F.when(
                F.col("pending_review") > 50, F.lit("High review queue - consider increasing review capacity")
            ),
            F.when(
                F.col("confidence_mean") < 0.7,
                F.lit("Low average confidence - consider improving pattern detection"),
            ),
        )
    )
    return stats.select(*stats.columns[:-1], "_t.*", advice.alias("recommendations"))


def key_recommendations(progress: DataFrame) -> DataFrame:
    """The per-key recommendations, one row each."""
    # The advice texts and the limits at which they are given.
    advice = F.concat(
        F.lit("Key "), F.col(KEY), F.lit(" has many rule updates - consider pattern refinement")
    )
    return progress.where(F.col("rule_updates") > 20).select(KEY, advice.alias("recommendation"))
