"""Batch validation: a table of requests in, a table of verdicts out, one plan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators.keys import SEPARATOR, valid_key_parts
from formscribe.operators.normalize import apply_rules
from formscribe.operators.profile import KEY

NO_TEXTS = "array<string>"


def verdict(
    format_ok: Column, similarity: Column, nearest: Column, review_below: float = 0.6, inclusive: bool = False
) -> Column:
    """struct(verdict, issues, suggested_fix, confidence).

    `similarity` is the best neighbour at or above the threshold, NULL when there is none. A lone mismatch
    has confidence 0.6; with `inclusive` it goes to review, otherwise it is accepted as published.
    """
    has = similarity.isNotNull()
    same = has & (similarity > 0.95)
    near = has & (similarity > 0.85) & ~same
    bad = ~format_ok
    first = F.get(nearest, F.lit(0))
    fix = F.when(bad & ~same, first)
    confidence = F.when(same, similarity).otherwise(
        F.when(near, F.lit(0.8)).otherwise(F.lit(1.0)) * F.when(bad, F.lit(0.6)).otherwise(F.lit(1.0))
    )
    unsure = confidence <= review_below if inclusive else confidence < review_below
    issues = F.array_compact(
        F.array(
            F.when(bad & ~same, F.lit("format_mismatch")), F.when(same | near, F.lit("near_duplicate"))
        )
    )
    name = (
        F.when(same, F.lit("duplicate"))
        .when(~bad & ~near, F.lit("accepted"))
        .when(bad & fix.isNotNull() & (fix != ""), F.lit("reformatted"))
        .when(near, F.lit("duplicate"))
        .when(unsure, F.lit("needs_review"))
        .otherwise(F.lit("accepted"))
    )
    return F.struct(
        name.alias("verdict"), issues.alias("issues"), fix.alias("suggested_fix"), confidence.alias("confidence")
    )


def simple_verdict(value: Column, regex: Column, samples: Column) -> Column:
    """Verdict from the pattern and the first sample only."""
    checked = regex.isNotNull() & (regex != "")
    matched = F.coalesce(checked & text.matches_prefix(value, regex), F.lit(False))
    missed = checked & ~matched
    fix = F.when(missed, F.get(samples, F.lit(0)))
    has_fix = fix.isNotNull() & (fix != "")
    return F.struct(
        F.when(matched, F.lit("accepted"))
        .when(has_fix, F.lit("reformatted"))
        .otherwise(F.lit("needs_review"))
        .alias("verdict"),
        F.when(missed, F.array(F.lit("format_mismatch"))).otherwise(F.array().cast(NO_TEXTS)).alias("issues"),
        fix.alias("suggested_fix"),
        F.when(matched, F.lit(0.9)).when(has_fix, F.lit(0.0)).otherwise(F.lit(0.3)).alias("confidence"),
    )


def keyed_requests(requests: DataFrame, expected_parts: int = 3) -> DataFrame:
    """Adds key_ok and, for well-formed parts, composite_key."""
    ok = valid_key_parts(F.col("key_parts"), expected_parts)
    return requests.withColumns(
        {"key_ok": ok, KEY: F.when(ok, F.array_join("key_parts", SEPARATOR, "nan"))}
    )


def prepare_requests(requests: DataFrame, profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with their key's profile (or none), the normalised value and the format test."""
    keyed = keyed_requests(requests) if "key_ok" not in requests.columns else requests
    known = profiles.select(KEY, "candidate_regex", F.lit(True).alias("known"))
    joined = keyed.join(known, KEY, "left").join(rules.select(KEY, "rules"), KEY, "left")
    outcome = apply_rules(F.col("value"), F.col("rules"))
    checked = F.col("candidate_regex").isNotNull() & (F.col("candidate_regex") != "")
    return (
        joined.withColumn("_o", outcome)
        .select(*keyed.columns, "known", "candidate_regex", "_o.normalized", "_o.applied_rules")
        .withColumn(
            "format_ok",
            F.when(
                checked,
                F.coalesce(text.matches_prefix(F.col("normalized"), F.col("candidate_regex")), F.lit(False)),
            ).otherwise(F.lit(True)),
        )
    )


def validate_values(
    requests: DataFrame,
    profiles: DataFrame,
    rules: DataFrame,
    duplicates: DataFrame | None = None,
    inclusive: bool = False,
    as_of: Column | None = None,
) -> DataFrame:
    """Verdict rows for requests(key_parts, value, ...).

    `duplicates` has composite_key, normalized, similarity, nearest_examples for the (key, normalised value)
    pairs with a neighbour at or above the threshold; see `neighbours.duplicate_check`. Malformed keys are
    rejected, unknown keys go to review. The time `ts` is the request's `requested_at` where it has one, else `as_of`,
    else the time of the run.
    """
    now = as_of if as_of is not None else F.current_timestamp()
    stamp = F.coalesce(F.col("requested_at").cast("timestamp"), now) if "requested_at" in requests.columns else now
    prepared = prepare_requests(requests, profiles, rules)
    if duplicates is None:
        prepared = prepared.withColumns(
            {"similarity": F.lit(None).cast("double"), "nearest_examples": F.array().cast(NO_TEXTS)}
        )
    else:
        found = duplicates.select(KEY, "normalized", "similarity", "nearest_examples")
        prepared = prepared.join(found, [KEY, "normalized"], "left")
    nearest = F.coalesce(F.col("nearest_examples"), F.array().cast(NO_TEXTS))
    outcome = verdict(F.col("format_ok"), F.col("similarity"), nearest, inclusive=inclusive)
    unknown = F.col("known").isNull()
    nothing = F.array().cast(NO_TEXTS)

    def fixed(name: str, issue: str) -> Column:
        return F.struct(
            F.lit(name).alias("verdict"),
            F.array(F.lit(issue)).alias("issues"),
            F.lit(None).cast("string").alias("suggested_fix"),
            F.lit(0.0).alias("confidence"),
        )

    chosen = (
        F.when(~F.col("key_ok"), fixed("rejected", "invalid_key_parts"))
        .when(unknown, fixed("needs_review", "unknown_key"))
        .otherwise(outcome)
    )
    kept = [c for c in requests.columns if c not in (KEY, "key_ok", "value")]
    return prepared.withColumn("_v", chosen).select(
        *kept,
        KEY,
        F.col("value").alias("original_value"),
        "_v.*",
        F.when(unknown, nothing).otherwise(nearest).alias("nearest_examples"),
        F.when(unknown, nothing).otherwise(F.col("applied_rules")).alias("rules_applied"),
        stamp.alias("ts"),
    )


def review_route(confidence: Column, settings: Settings = Settings()) -> Column:
    return (
        F.when(confidence >= settings.auto_accept, F.lit("auto_accept"))
        .when(confidence >= settings.review_lower, F.lit("review"))
        .otherwise(F.lit("reject"))
    )


def served_profiles(
    profiles: DataFrame, rules: DataFrame, clusters: DataFrame | None = None, settings: Settings = Settings()
) -> DataFrame:
    """Profiles with their rules, clusters and threshold. Clusters per key are few (bounded by k)."""
    joined = profiles.join(rules.select(KEY, F.col("rules").alias("normalization_rules")), KEY, "left")
    if clusters is not None:
        fields = [c for c in clusters.columns if c != KEY]
        per_key = clusters.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("clusters"))
        joined = joined.join(per_key, KEY, "left")
    return joined.withColumn("similarity_threshold", F.lit(settings.similarity_threshold))


def unknown_keys(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    return requests.join(profiles.select(KEY), KEY, "left_anti")


def values_of_known_keys(values: DataFrame, profiles: DataFrame) -> DataFrame:
    return values.join(profiles.select(KEY), KEY, "left_semi")


def profiles_without_values(profiles: DataFrame, values: DataFrame) -> DataFrame:
    return profiles.join(values.select(KEY).distinct(), KEY, "left_anti").select(KEY)
