"""How well a key's candidate pattern covers test values."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formscribe.functions import text
from formscribe.operators.profile import KEY


def match_values(test_values: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each distinct test value of a known key with n (its occurrences) and matched. Keys without a pattern
    match nothing. One pattern test per distinct value."""
    counted = test_values.where(F.col("value").isNotNull()).groupBy(KEY, "value").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(patterns.select(KEY, "candidate_regex"), KEY)
    matched = F.coalesce(text.matches_prefix(F.col("value"), F.col("candidate_regex")), F.lit(False))
    return joined.withColumn("matched", matched)


def pattern_coverage(test_values: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per key: total_tested, matches, non_matches, coverage, number of distinct signatures that miss.

    The values themselves stay in `match_values`, one row each, because a key may miss without bound.
    """
    rows = match_values(test_values, patterns).withColumn("sig", text.signature(F.col("value")))
    missed = F.when(~F.col("matched"), F.col("n")).otherwise(0)
    per_signature = rows.groupBy(KEY, "sig").agg(F.sum("n").alias("n"), F.sum(missed).alias("missed"))
    return per_signature.groupBy(KEY).agg(
        F.sum("n").alias("total_tested"),
        F.sum(F.col("n") - F.col("missed")).alias("matches"),
        F.sum("missed").alias("non_matches"),
        (F.sum(F.col("n") - F.col("missed")) / F.sum("n")).alias("coverage"),
        F.count_if(F.col("missed") > 0).alias("missed_signatures"),
    )


def pattern_suggestions(coverage: DataFrame) -> DataFrame:
    """Texts for keys whose pattern covers too little."""
    low = (F.col("coverage") < 0.8) & (F.col("non_matches") > 0)
    few = F.col("missed_signatures") <= 3
    # The advice texts and the limits at which they are given.
    texts = F.array_compact(
        F.array(
            F.when(low & few, F.lit("Consider adding patterns for common non-matching signatures")),
            F.when(low & ~few, F.lit("Many unique patterns in non-matches - may need clustering analysis")),
            F.when(
                F.col("coverage") < 0.5,
                F.lit("Low pattern coverage - consider if this key needs different approach"),
            ),
        )
    )
    return coverage.withColumn("suggestions", texts)
