"""Keys, profiles, rules, validation and review on small fixtures."""
import pytest
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators import keys, merge, normalize, profile, ranking, review, validate
from formscribe.operators.profile import KEY

ROWS = [
    (1, "A", "X", "1", "value1"),
    (2, "A", "X", "1", "value2"),
    (3, "B", "Y", "2", "value3"),
    (4, "B", "Y", "2", "value4"),
    (5, "C", "Z", "3", "value5"),
]
SCHEMA = "row_id long, key_part1 string, key_part2 string, key_part3 string, value string"


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_composite_keys(items):
    got = [r[KEY] for r in keys.add_composite_key(items).orderBy("row_id").collect()]
    assert got == ["A||X||1", "A||X||1", "B||Y||2", "B||Y||2", "C||Z||3"]


def test_null_part_is_kept(spark):
    df = spark.createDataFrame([("A", None, "C")], "key_part1 string, key_part2 string, key_part3 string")
    assert keys.add_composite_key(df).first()[KEY] == "A||nan||C"


def test_missing_key_columns(spark):
    with pytest.raises(ValueError, match="Missing key columns"):
        keys.add_composite_key(spark.createDataFrame([("A",)], "key_part1 string"))


def test_existing_key_is_left_alone(items):
    keyed = keys.add_composite_key(items)
    assert keys.add_composite_key(keyed) is keyed


def test_key_parts_check(spark):
    rows = [(["A", "B", "C"],), (["A", "B"],), (["A", "", "C"],), ([None, "B", "C"],), (["A", " \t", "C"],), (None,)]
    df = spark.createDataFrame(rows, "p array<string>")
    assert [r.ok for r in df.select(keys.valid_key_parts(F.col("p")).alias("ok")).collect()] == [True] + [False] * 5


def test_check_table(spark, items):
    good = keys.check_table(items).first()
    assert good.is_valid and good.issues == [] and good.warnings == []
    holes = spark.createDataFrame([(1, "A", None, "C", None), (2, "A", "B", "C", "v")], SCHEMA)
    assert keys.check_table(holes).first().warnings == [
        "Column 'key_part2' has 1 null values",
        "Value column 'value' has 1 null values",
    ]
    empty = keys.check_table(items.where("false")).first()
    assert not empty.is_valid and empty.issues == ["DataFrame is empty"]
    lacking = keys.check_table(items.drop("key_part3")).first()
    assert not lacking.is_valid and lacking.issues == ["Missing required columns: ['key_part3']"]


def test_key_stats(items):
    got = {r[KEY]: r for r in profile.key_stats(items).collect()}
    assert len(got) == 3
    first = got["A||X||1"]
    assert (first["count"], first.unique_values, first.is_free_text) == (2, 2, True)
    assert first.sample_values == ["value1", "value2"]
    assert [(s.sig, s["count"], s.pct, s.examples) for s in first.top_signatures] == [("L5D", 2, 100.0, ["value1", "value2"])]


def test_nulls_are_dropped_and_empty_keys_vanish(spark):
    df = spark.createDataFrame([(1, "A", "B", "C", None), (2, "D", "E", "F", None), (3, "D", "E", "F", "x")], SCHEMA)
    assert [(r[KEY], r["count"]) for r in profile.key_stats(df).collect()] == [("D||E||F", 1)]


def test_profile_of_one_row_has_no_std(spark):
    row = profile.key_profiles(spark.createDataFrame([(1, "A", "B", "C", "12 V")], SCHEMA)).first()
    assert row.value_analysis.length_stats.std is None and row.is_numeric_unit and row.candidate_regex is None
    assert row.top_signatures == []


def test_profile_does_not_depend_on_partitions(spark):
    rows = [(i, "A", "B", str(i % 3), f"item {i % 17} {'x' * (i % 5)}") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = [KEY]
    one = profile.key_profiles(df.coalesce(1)).orderBy(*order).collect()
    many = profile.key_profiles(df.repartition(7)).orderBy(*order).collect()
    assert one == many


def test_signature_examples_and_samples_keep_first_rows(spark):
    rows = [(i, "A", "B", "C", v) for i, v in enumerate(["zz", "aa", "zz", "11", "bb", "cc", "dd"])]
    row = profile.key_stats(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.sample_values == ["zz", "aa", "11", "bb", "cc"]
    assert row.top_signatures[0].examples == ["zz", "aa", "bb"]


def test_merge_sum_counts_repeated_values_per_batch(spark):
    first = spark.createDataFrame([(i, "A", "X", "1", v) for i, v in enumerate(["val1", "val2", "val3", "val4", "val4"])], SCHEMA)
    second = spark.createDataFrame([(i, "A", "X", "1", v) for i, v in enumerate(["val3", "val4", "val4"])], SCHEMA)
    both = merge.batch_stats(first).unionByName(merge.batch_stats(second))
    summed = merge.merge_batch_stats(both, mode="sum").first()
    assert (summed["count"], summed.unique_values) == (8, 6)
    assert merge.merge_batch_stats(both).first().unique_values == 4
    with pytest.raises(ValueError):
        merge.merge_batch_stats(both, mode="other")


def rules_df(spark, rules, key="A||X||1"):
    return spark.createDataFrame([(key, rules)], f"{KEY} string, rules {normalize.RULE_TYPE}")


def test_rules_run_in_list_order_and_unknown_names_are_skipped(spark):
    values = spark.createDataFrame([("A||X||1", "  10,000 V (max)!!"), ("A||X||1", ""), ("A||X||1", None), ("other", " x ")], f"{KEY} string, value string")
    rules = [
        ("trim_whitespace", 1, {}),
        ("no_such_rule", 2, {}),
        ("extract_parenthetical_comments", 3, {}),
        ("normalize_thousands_separators", 4, {}),
        ("remove_space_between_number_and_unit", 5, {}),
        ("case_normalization", 6, {"case": "upper"}),
        ("remove_extra_punctuation", 7, {}),
    ]
    got = {r.value: r for r in normalize.normalize_values(values, rules_df(spark, rules)).collect()}
    done = got["  10,000 V (max)!!"]
    assert done.normalized == "10000V !"
    assert done.comment == "max"
    assert done.applied_rules == [r[0] for r in rules if r[0] != "no_such_rule"]
    assert "case_normalization" not in done.changed_by and "trim_whitespace" in done.changed_by
    assert got[""].normalized == "" and got[""].applied_rules == []
    assert got[None].normalized is None
    assert got[" x "].normalized == " x " and got[" x "].applied_rules == []


def test_rules_with_unit_mappings_and_own_registry(spark):
    values = spark.createDataFrame([("A||X||1", "5 volts 007")], f"{KEY} string, value string")
    rules = [("normalize_units", 1, {"volts": "V"}), ("remove_leading_zeros", 2, {}), ("shout", 3, {})]
    registry = {**normalize.RULES, "shout": lambda v, p: F.concat(v, F.lit("!"))}
    assert normalize.normalize_values(values, rules_df(spark, rules), registry).first().normalized == "5 V 7!"


VERDICTS = [
    # format_ok, similarity, verdict, issues, fix, confidence
    (True, None, "accepted", [], None, 1.0),
    (False, None, "accepted", ["format_mismatch"], None, 0.6),
    (True, 0.97, "duplicate", ["near_duplicate"], None, 0.97),
    (False, 0.97, "duplicate", ["near_duplicate"], None, 0.97),
    (True, 0.9, "duplicate", ["near_duplicate"], None, 0.8),
    (False, 0.9, "reformatted", ["format_mismatch", "near_duplicate"], "n", 0.48),
    (True, 0.83, "accepted", [], None, 1.0),
    (False, 0.83, "reformatted", ["format_mismatch"], "n", 0.6),
]


def test_verdict_table(spark):
    df = spark.createDataFrame([(i, ok, s, ["n"] if s else []) for i, (ok, s, *_) in enumerate(VERDICTS)], "i int, ok boolean, s double, n array<string>")
    got = df.select("i", validate.verdict(F.col("ok"), F.col("s"), F.col("n")).alias("v")).orderBy("i").select("v.*").collect()
    for row, (_, _, name, issues, fix, confidence) in zip(got, VERDICTS):
        assert (row.verdict, row.issues, row.suggested_fix) == (name, issues, fix)
        assert row.confidence == pytest.approx(confidence)
    strict = validate.verdict(F.col("ok"), F.col("s"), F.col("n"), inclusive=True)
    assert df.where("i = 1").select(strict.alias("v")).first().v.verdict == "needs_review"


def test_validate_unknown_and_malformed_keys(spark, items):
    profiles = profile.key_profiles(items, Settings(min_signature_frequency=1))
    rules = normalize.rules_from_profiles(profiles)
    requests = spark.createDataFrame(
        [(["A", "X", "1"], "value9"), (["A", "X", "1"], "9"), (["Q", "Q", "Q"], "v"), (["A", "X"], "v")],
        "key_parts array<string>, value string",
    )
    got = {(len(r.key_parts), r.key_parts[0], r.original_value): r for r in validate.validate_values(requests, profiles, rules).collect()}
    assert got[(3, "A", "value9")].verdict == "accepted"
    assert got[(3, "A", "9")].issues == ["format_mismatch"]
    assert (got[(3, "Q", "v")].verdict, got[(3, "Q", "v")].issues) == ("needs_review", ["unknown_key"])
    assert (got[(2, "A", "v")].verdict, got[(2, "A", "v")].issues) == ("rejected", ["invalid_key_parts"])


def test_second_decision_finds_nothing(spark):
    items = spark.createDataFrame([("1", "k", "V", 0.5, "2024-01-01"), ("2", "k", "W", 0.5, "2024-01-01")], f"id string, {KEY} string, original_value string, confidence double, ts string")
    decisions = spark.createDataFrame(
        [("1", "edit", "v", "2024-01-02 10:00:00"), ("1", "reject", None, "2024-01-03 10:00:00"), ("9", "accept", None, "2024-01-02 10:00:00")],
        "id string, decision string, corrected_value string, reviewed_at string",
    ).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    history = review.review_history(items, decisions).collect()
    assert [(r.id, r.decision, r.corrected_value) for r in history] == [("1", "edit", "v")]
    assert [r.id for r in review.pending_items(items, decisions).collect()] == ["2"]
    assert [r.id for r in review.unmatched_decisions(items, decisions).collect()] == ["9"]


def test_exact_median(spark):
    import statistics

    groups = {"a": [1.0, 5.0, 2.0], "b": [4.0, 4.0, 4.0, 9.0], "c": [7.0], "d": [float(i * i % 101) for i in range(1000)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r.median for r in ranking.exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in groups.items()}
    everything = [v for vs in groups.values() for v in vs]
    assert ranking.exact_median(df, [], "v").first().median == statistics.median(everything)


def test_spread_of_nothing_is_zero(spark):
    row = ranking.spread(spark.createDataFrame([], "v double"), [], "v").first()
    assert (row["count"], row["mean"], row["std"], row["median"]) == (0, 0.0, 0.0, 0.0)


def test_top_per_group_above_the_pruning_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = ranking.top_per_group(df, ["g"], [F.col("id").desc()], 1500)
    assert got.count() == 3000 and got.agg(F.min("id")).first()[0] == 2000


def test_number_items(spark):
    df = spark.createDataFrame([("a", v) for v in ["q", "a", "zz", "b"]] + [("b", "x")], "g string, v string")
    want = {("a", "a"): 0, ("a", "b"): 1, ("a", "q"): 2, ("a", "zz"): 3, ("b", "x"): 0}
    for bucket in (F.substring("v", 1, 1), None):
        got = {(r.g, r.v): r.p for r in ranking.number_items(df, ["g"], "v", "p", bucket).collect()}
        assert got == want
