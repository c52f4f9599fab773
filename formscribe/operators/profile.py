"""Key statistics and key profiles.

All paths start from `value_table`: rows are counted per distinct (key, value) first, so signatures and
character tests run once per distinct value and repeated values collapse before any other shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators.keys import add_composite_key
from formscribe.operators.ranking import top_per_group

KEY = "composite_key"

_TESTS = {
    "has_digits": text.has_digit,
    "has_letters": text.has_letter,
    "has_special": text.has_special,
    "has_whitespace": text.has_whitespace,
    "has_parentheses": text.has_parentheses,
    "has_commas": text.has_comma,
    "has_dashes": text.has_dash,
    "number_unit": text.is_number_with_unit,
    "unit_words": text.has_unit_word,
}


def value_table(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per distinct non-null (key, value): n, first_pos (smallest order value, if there is one), sig."""
    keyed = add_composite_key(df, settings)
    order = settings.order_column or ("row_id" if "row_id" in df.columns else None)
    position = F.min(F.col(order).cast("long")) if order else F.lit(None).cast("long")
    counted = (
        keyed.where(F.col(settings.value_column).isNotNull())
        .groupBy(KEY, F.col(settings.value_column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), position.alias("first_pos"))
    )
    return counted.withColumn("sig", text.signature_in_batches(F.col("value")))


def signature_table(values: DataFrame, tests: bool = False) -> DataFrame:
    """Signature histogram per key. With `tests`, also the weighted counts of every character test.

    A signature fixes the length of its values, so this table is enough for all length statistics.
    """
    extra = [F.sum(F.when(test(F.col("value")), F.col("n")).otherwise(0)).alias(name) for name, test in _TESTS.items()]
    measures = [F.count(F.lit(1)).alias("n_distinct"), F.min(F.length("value")).alias("len"), *extra]
    return values.groupBy(KEY, "sig").agg(
        F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), *(measures if tests else measures[:1])
    )


def first_values(values: DataFrame, per_signature: int) -> DataFrame:
    """The first distinct values of every (key, signature) in row order, else by frequency and value."""
    order = [F.col("first_pos").asc_nulls_last(), F.col("n").desc(), F.col("value")]
    return top_per_group(values.select(KEY, "sig", "value", "n", "first_pos"), [KEY, "sig"], order, per_signature)


def ranked_signatures(signatures: DataFrame, k: int) -> DataFrame:
    """Most frequent signatures per key; ties go to the one seen first, then to the smaller text."""
    order = [F.col("n").desc(), F.col("first_pos").asc_nulls_last(), F.col("sig")]
    return top_per_group(signatures, [KEY], order, k)


def _ordered_values(rank: str) -> Column:
    """Values of a group whose size is bounded by a rank limit, in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("value").alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def _signature_lists(signatures: DataFrame, firsts: DataFrame, settings: Settings) -> DataFrame:
    """top_signatures per key before percentages: at most ten entries of at most three examples.

    The entries keep all measures of their signature, although few are shown: with equal columns Spark shares
    one shuffle of the signature table between this ranking and the totals.
    """
    examples = firsts.groupBy(KEY, "sig").agg(
        F.slice(_ordered_values("rank"), 1, settings.examples_per_signature).alias("examples")
    )
    ranked = ranked_signatures(signatures, settings.top_signatures)
    entry = F.struct("rank", "sig", "n", "examples", *[c for c in signatures.columns if c not in (KEY, "sig", "n")])
    return (
        ranked.join(examples, [KEY, "sig"], "left")
        .groupBy(KEY)
        .agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    )


def _with_percentages(ranked: Column, total: Column, least: Column | None = None) -> Column:
    kept = ranked if least is None else F.filter(ranked, lambda s: s["n"] >= least)
    return F.transform(
        kept,
        lambda s: F.struct(
            s["sig"].alias("sig"),
            s["n"].alias("count"),
            (s["n"] * 100.0 / total).alias("pct"),
            s["examples"].alias("examples"),
        ),
    )


def _sample_lists(firsts: DataFrame, k: int) -> DataFrame:
    """The first k distinct values per key; they are among the first k of each signature."""
    order = [F.col("first_pos").asc_nulls_last(), F.col("n").desc(), F.col("value")]
    picked = top_per_group(firsts.select(KEY, "value", "n", "first_pos"), [KEY], order, k, rank="pos")
    return picked.groupBy(KEY).agg(_ordered_values("pos").alias("sample_values"))


def _totals(settings: Settings) -> list[Column]:
    ratio = F.sum("n_distinct") / F.sum("n")
    return [
        F.sum("n").alias("count"),
        F.sum("n_distinct").alias("unique_values"),
        ratio.alias("unique_ratio"),
        (ratio > settings.free_text_ratio).alias("is_free_text"),
        F.min("first_pos").alias("first_row"),
    ]


def key_totals(signatures: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """count, unique_values, unique_ratio, is_free_text per key; the flag uses the unrounded ratio."""
    return signatures.groupBy(KEY).agg(*_totals(settings))


def rare_limit(total: Column, settings: Settings) -> Column:
    """Smallest count a signature needs not to be rare in its key."""
    return F.greatest(F.lit(settings.min_signature_frequency), F.floor(total * settings.rare_signature_pct / 100))


def key_stats(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Statistics per key with the most frequent signatures and sample values."""
    values = value_table(df, settings)
    signatures = signature_table(values)
    totals = key_totals(signatures, settings)
    firsts = first_values(values, max(settings.sample_values, settings.examples_per_signature))
    return (
        totals.join(_signature_lists(signatures, firsts, settings), KEY, "left")
        .join(_sample_lists(firsts, settings.sample_values), KEY, "left")
        .withColumn("top_signatures", _with_percentages(F.col("ranked"), F.col("count")))
        .drop("ranked")
    )


def _length_stats() -> Column:
    """Weighted length statistics from the signature table; sums of integers stay exact in a double."""
    n = F.sum("n")
    total = F.sum(F.col("n") * F.col("len")).cast("double")
    squares = F.sum((F.col("n") * F.col("len") * F.col("len")).cast("double"))
    variance = F.when(n > 1, F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))
    return F.struct(
        (total / n).alias("mean"),
        F.sqrt(variance).alias("std"),
        F.min("len").alias("min"),
        F.max("len").alias("max"),
        F.percentile(F.col("len"), F.lit(0.5), F.col("n")).alias("median"),
    )


def _analysis() -> list[Column]:
    total = F.sum("n")

    def share(name: str) -> Column:
        return F.sum(name) * 100.0 / total

    return [
        F.struct(
            _length_stats().alias("length_stats"),
            F.struct(
                *[F.sum(c).alias(c) for c in ("has_digits", "has_letters", "has_special", "has_whitespace")],
                share("has_digits").alias("pct_digits"),
                share("has_letters").alias("pct_letters"),
                share("has_special").alias("pct_special"),
                share("has_whitespace").alias("pct_whitespace"),
            ).alias("character_types"),
            F.struct(
                *[F.sum(c).alias(c) for c in ("has_parentheses", "has_commas", "has_dashes")],
                (F.sum("unit_words") > 0).alias("has_units"),
                share("has_parentheses").alias("pct_parentheses"),
                share("has_commas").alias("pct_commas"),
                share("has_dashes").alias("pct_dashes"),
            ).alias("patterns"),
        ).alias("value_analysis"),
        (F.sum("number_unit") / total).alias("number_unit_share"),
    ]


def value_analysis(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Length, character-class and pattern statistics per key."""
    signatures = signature_table(value_table(df, settings), tests=True)
    return signatures.groupBy(KEY).agg(F.sum("n").alias("count"), *_analysis())


def key_profiles(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The full profile, one nested row per key.

    Totals, ranked signatures and first values all read the distinct (key, value) table with the same
    columns, so Spark scans and shuffles the input once and reuses that exchange.
    """
    values = value_table(df, settings)
    signatures = signature_table(values, tests=True)
    summary = signatures.groupBy(KEY).agg(*_totals(settings), *_analysis())
    firsts = first_values(values, max(settings.sample_values, settings.examples_per_signature))
    joined = (
        summary.join(_signature_lists(signatures, firsts, settings), KEY, "left")
        .join(_sample_lists(firsts, settings.sample_values), KEY, "left")
        .withColumn(
            "top_signatures",
            _with_percentages(F.col("ranked"), F.col("count"), rare_limit(F.col("count"), settings)),
        )
    )
    leading = F.get("top_signatures", F.lit(0))["sig"]
    return joined.select(
        KEY,
        "count",
        "unique_values",
        "unique_ratio",
        "is_free_text",
        (F.col("number_unit_share") > settings.numeric_unit_share).alias("is_numeric_unit"),
        "top_signatures",
        F.when(leading.isNotNull(), text.signature_regex(leading)).alias("candidate_regex"),
        "value_analysis",
        "sample_values",
        "first_row",
    )


def key_patterns(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Leading signature and candidate pattern per key; NULL when every signature is rare."""
    signatures = signature_table(value_table(df, settings))
    order = F.struct((-F.col("n")).alias("w"), F.coalesce("first_pos", F.lit(0)).alias("p"), F.col("sig").alias("sig"))
    per_key = signatures.groupBy(KEY).agg(F.sum("n").alias("count"), F.min(order).alias("best"))
    sig = F.when(-F.col("best.w") >= rare_limit(F.col("count"), settings), F.col("best.sig"))
    return per_key.select(
        KEY,
        "count",
        sig.alias("leading_signature"),
        F.when(sig.isNotNull(), text.signature_regex(sig)).alias("candidate_regex"),
    )


def common_signatures(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All signatures that are not rare within their key."""
    signatures = signature_table(value_table(df, settings))
    totals = key_totals(signatures, settings).select(KEY, "count")
    return (
        signatures.join(totals, KEY)
        .where(F.col("n") >= rare_limit(F.col("count"), settings))
        .select(KEY, "sig", F.col("n").alias("count"), (F.col("n") * 100.0 / F.col("count")).alias("pct"))
    )


def keys_with_at_least(df: DataFrame, minimum: int, settings: Settings = Settings()) -> DataFrame:
    """Rows of the keys that have enough non-null values."""
    keyed = add_composite_key(df, settings).where(F.col(settings.value_column).isNotNull())
    sizes = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return keyed.join(sizes.select(KEY), KEY, "left_semi")


def group_sizes(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Row count and value-length range per combination of key parts."""
    length = F.length(settings.value_column)
    return df.groupBy(*settings.key_columns).agg(
        F.count(F.lit(1)).alias("count"), F.min(length).alias("min_length"), F.max(length).alias("max_length")
    )


def sample_value_list(profiles: DataFrame) -> DataFrame:
    """Distinct cleaned sample values over all keys, blanks dropped."""
    value = text.embedding_text(F.col("value"))
    exploded = profiles.select(F.explode("sample_values").alias("value"))
    return exploded.select(value.alias("value")).where(F.col("value") != "").distinct()


def value_owners(profiles: DataFrame) -> DataFrame:
    """Value -> key: the last key by name, and how many keys share the value."""
    exploded = profiles.select(KEY, F.explode("sample_values").alias("value")).distinct()
    return exploded.groupBy("value").agg(F.max(KEY).alias("last_key"), F.count(F.lit(1)).alias("n_keys"))
