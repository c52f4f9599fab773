"""Key statistics, signature histograms and full profiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators import merge
from formscribe.operators import profile as P
from formscribe.operators.keys import add_composite_key
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.views import view, with_views

KEY = P.KEY
#: Views with few and with many distinct values per key, one hot key, and long texts.
ITEM_VIEWS = ("parts", "orders", "customers", "docs", "pages", "props")


def _base(name: str) -> str:
    return f"{with_views('v_' + name)}, {duck.keyed('v_' + name)}"


#: histogram, totals, ranked signatures, first values: shared by the checks below
_HIST = """hist as (select composite_key, sig, count(*) as n, min(row_id) as p from keyed group by 1, 2),
    tot as (select composite_key, count(*) as cnt, count(distinct value) as uniq, min(row_id) as first_row
            from keyed group by 1),
    ranked as (select h.*, t.cnt, row_number() over (partition by composite_key order by n desc, p, sig) as rk
               from hist h join tot t using (composite_key)),
    vals as (select composite_key, sig, value, min(row_id) as p from keyed group by 1, 2, 3),
    ex as (select *, row_number() over (partition by composite_key, sig order by p, value) as er,
                  row_number() over (partition by composite_key order by p, value) as sr from vals)"""


def joined_signatures(column: Column) -> Column:
    """A top_signatures array as one comparable text."""
    return F.array_join(
        F.transform(
            column,
            lambda s: F.concat_ws(
                "~", s["sig"], s["count"].cast("string"), F.array_join(s["examples"], "^")
            ),
        ),
        "|",
    )


_TOP_TEXT = """(select composite_key, string_agg(sig || '~' || n || '~' || examples, '|' order by rk) as signatures
     from (select r.composite_key, r.sig, r.n, r.rk, string_agg(e.value, '^' order by er) as examples
           from ranked r join ex e on r.composite_key = e.composite_key and r.sig = e.sig and e.er <= 3
           where r.rk <= 10 {rare} group by 1, 2, 3, 4) group by 1)"""
_SAMPLE_TEXT = """(select composite_key, string_agg(value, '^' order by sr) as samples from ex where sr <= 5 group by 1)"""


def _rare(frequency: int = 5, pct: float = 1.0) -> str:
    return f"and r.n >= greatest({frequency}, floor(r.cnt * {pct} / 100))"


_RARE = _rare()


def _register_stats(name: str) -> None:
    sql = f"""{_base(name)}, {_HIST}
    select tot.composite_key, cnt as "count", uniq as unique_values, round(uniq * 1.0 / cnt, 6) as unique_ratio,
           uniq * 1.0 / cnt > 0.8 as is_free_text, signatures, samples
    from tot left join {_TOP_TEXT.format(rare='')} a on tot.composite_key = a.composite_key
             left join {_SAMPLE_TEXT} b on tot.composite_key = b.composite_key"""

    @query(f"key_stats_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = P.key_stats(view(spark, sf_dir, f"v_{name}"))
        return stats.select(
            KEY,
            "count",
            "unique_values",
            F.round("unique_ratio", 6).alias("unique_ratio"),
            "is_free_text",
            joined_signatures(F.col("top_signatures")).alias("signatures"),
            F.array_join("sample_values", "^").alias("samples"),
        )


def flat_profile(profiles: DataFrame) -> DataFrame:
    """A key profile with scalar columns only."""
    a = "value_analysis."
    doubles = [
        *[F.round(f"{a}length_stats.{c}", 6).alias(f"length_{c}") for c in ("mean", "std", "median")],
        *[
            F.round(f"{a}character_types.pct_{c}", 6).alias(f"pct_{c}")
            for c in ("digits", "letters", "special", "whitespace")
        ],
        *[F.round(f"{a}patterns.pct_{c}", 6).alias(f"pct_{c}") for c in ("parentheses", "commas", "dashes")],
    ]
    return profiles.select(
        KEY,
        "count",
        "unique_values",
        F.round("unique_ratio", 6).alias("unique_ratio"),
        "is_free_text",
        "is_numeric_unit",
        joined_signatures(F.col("top_signatures")).alias("signatures"),
        "candidate_regex",
        *[F.col(f"{a}length_stats.{c}").cast("long").alias(f"length_{c}") for c in ("min", "max")],
        *doubles,
        F.col(f"{a}patterns.has_units").alias("has_units"),
        F.array_join("sample_values", "^").alias("samples"),
    )


_ANALYSIS = f"""ana as (select composite_key, min(length(value)) as length_min, max(length(value)) as length_max,
      round(avg(length(value)), 6) as length_mean, round(stddev_samp(length(value)), 6) as length_std,
      round(median(length(value)), 6) as length_median,
      round(count(*) filter (where {duck.digit('value')}) * 100.0 / count(*), 6) as pct_digits,
      round(count(*) filter (where {duck.letter('value')}) * 100.0 / count(*), 6) as pct_letters,
      round(count(*) filter (where {duck.special('value')}) * 100.0 / count(*), 6) as pct_special,
      round(count(*) filter (where {duck.whitespace('value')}) * 100.0 / count(*), 6) as pct_whitespace,
      round(count(*) filter (where {duck.has_parentheses('value')}) * 100.0 / count(*), 6) as pct_parentheses,
      round(count(*) filter (where contains(value, ',')) * 100.0 / count(*), 6) as pct_commas,
      round(count(*) filter (where contains(value, '-')) * 100.0 / count(*), 6) as pct_dashes,
      bool_or({duck.unit_word('value')}) as has_units,
      count(*) filter (where {duck.number_unit_pattern('value')}) * 1.0 / count(*) > 0.7 as is_numeric_unit
    from keyed group by 1)"""
_ANALYSIS_COLUMNS = """length_min, length_max, length_mean, length_std, length_median, pct_digits, pct_letters,
    pct_special, pct_whitespace, pct_parentheses, pct_commas, pct_dashes, has_units"""


def profile_cte(name: str, frequency: int = 5, pct: float = 1.0) -> str:
    """CTEs ending in `prof`, the flat profile of a view."""
    regex = duck.signature_regex("lead.sig")
    rare = _rare(frequency, pct)
    return f"""{_base(name)}, {_HIST}, {_ANALYSIS},
    lead as (select composite_key, sig from ranked r where rk = 1 {rare}),
    prof as (select tot.composite_key, cnt as "count", uniq as unique_values, round(uniq * 1.0 / cnt, 6) as unique_ratio,
        uniq * 1.0 / cnt > 0.8 as is_free_text, is_numeric_unit, coalesce(signatures, '') as signatures,
        case when lead.sig is not null then {regex} end as candidate_regex, {_ANALYSIS_COLUMNS}, samples
    from tot join ana on tot.composite_key = ana.composite_key left join lead on tot.composite_key = lead.composite_key
      left join {_TOP_TEXT.format(rare=rare)} a on tot.composite_key = a.composite_key
      left join {_SAMPLE_TEXT} b on tot.composite_key = b.composite_key)"""


def _register_profiles(name: str) -> None:
    @query(f"key_profiles_{name}", f"{profile_cte(name)} select * from prof")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat_profile(P.key_profiles(view(spark, sf_dir, f"v_{name}")))


for _name in ITEM_VIEWS:
    _register_stats(_name)
    _register_profiles(_name)


@query(
    "signature_histogram",
    f"""{_base('parts')}, {_HIST} select composite_key, sig, n as "count", round(n * 100.0 / cnt, 6) as pct from ranked""",
)
def signature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = P.signature_table(P.value_table(view(spark, sf_dir, "v_parts")))
    totals = P.key_totals(signatures).select(KEY, F.col("count").alias("total"))
    joined = signatures.join(totals, KEY)
    return joined.select(KEY, "sig", F.col("n").alias("count"), F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


@query(
    "top_signatures",
    f"""{_base('docs')}, {_HIST} select composite_key, sig, n as "count", rk as rank from ranked where rk <= 10""",
)
def top_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = P.ranked_signatures(P.signature_table(P.value_table(view(spark, sf_dir, "v_docs"))), 10)
    return ranked.select(KEY, "sig", F.col("n").alias("count"), F.col("rank").cast("long").alias("rank"))


@query(
    "signature_examples",
    f"""{_base('props')}, {_HIST} select composite_key, sig, value, er as rank from ex where er <= 3""",
)
def signature_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = P.first_values(P.value_table(view(spark, sf_dir, "v_props")), 3)
    return firsts.select(KEY, "sig", "value", F.col("rank").cast("long").alias("rank"))


@query(
    "common_signatures",
    f"""{_base('parts')}, {_HIST} select composite_key, sig, n as "count", round(n * 100.0 / cnt, 6) as pct
    from ranked r where true {_RARE}""",
)
def common_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.common_signatures(view(spark, sf_dir, "v_parts")).withColumn("pct", F.round("pct", 6))


@query(
    "candidate_regex",
    f"""{_base('customers')}, {_HIST}, lead as (select composite_key, sig from ranked r where rk = 1 {_RARE})
    select tot.composite_key, cnt as "count", lead.sig as leading_signature,
      case when lead.sig is not null then {duck.signature_regex('lead.sig')} end as candidate_regex
    from tot left join lead on tot.composite_key = lead.composite_key""",
)
def candidate_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_patterns(view(spark, sf_dir, "v_customers"))


@query(
    "length_stats",
    f"""{_base('docs')}, {_ANALYSIS} select composite_key, length_min, length_max, length_mean, length_std, length_median
    from ana""",
)
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.value_analysis(view(spark, sf_dir, "v_docs")).select(KEY, "value_analysis.length_stats.*")
    return stats.select(
        KEY,
        *[F.col(c).cast("long").alias(f"length_{c}") for c in ("min", "max")],
        *[F.round(c, 6).alias(f"length_{c}") for c in ("mean", "std", "median")],
    )


@query(
    "class_counts",
    f"""{_base('pages')} select composite_key, count(*) filter (where {duck.digit('value')}) as has_digits,
      count(*) filter (where {duck.letter('value')}) as has_letters, count(*) filter (where {duck.special('value')}) as has_special,
      count(*) filter (where {duck.whitespace('value')}) as has_whitespace,
      count(*) filter (where {duck.has_parentheses('value')}) as has_parentheses,
      count(*) filter (where contains(value, ',')) as has_commas, count(*) filter (where contains(value, '-')) as has_dashes
    from keyed group by 1""",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = P.value_analysis(view(spark, sf_dir, "v_pages"))
    names = {"character_types": ("digits", "letters", "special", "whitespace"), "patterns": ("parentheses", "commas", "dashes")}
    return analysis.select(KEY, *[F.col(f"value_analysis.{g}.has_{c}").alias(f"has_{c}") for g, cs in names.items() for c in cs])


@query(
    "numeric_unit_keys",
    f"""{_base('sizes')} select composite_key, count(*) as "count",
      round(count(*) filter (where {duck.number_unit_pattern('value')}) * 1.0 / count(*), 6) as share,
      count(*) filter (where {duck.number_unit_pattern('value')}) * 1.0 / count(*) > 0.7 as is_numeric_unit
    from keyed group by 1""",
)
def numeric_unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = P.value_analysis(view(spark, sf_dir, "v_sizes"))
    share = F.col("number_unit_share")
    return analysis.select(KEY, "count", F.round(share, 6).alias("share"), (share > 0.7).alias("is_numeric_unit"))


@query(
    "sample_value_list",
    f"""{_base('parts')}, {_HIST}, s as (select distinct {duck.strip('value')} as value from ex where sr <= 5)
    select value from s where value <> ''""",
)
def sample_value_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample_value_list(P.key_stats(view(spark, sf_dir, "v_parts")))


@query(
    "value_owners",
    f"""{_base('parts')}, {_HIST}, s as (select distinct composite_key, value from ex where sr <= 5)
    select value, max(composite_key) as last_key, count(*) as n_keys from s group by 1""",
)
def value_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_owners(P.key_stats(view(spark, sf_dir, "v_parts")))


@query(
    "group_sizes",
    f"""{with_views('v_props')} select key_part1, key_part2, key_part3, count(*) as "count",
      min(length(value)) as min_length, max(length(value)) as max_length from v_props group by 1, 2, 3""",
)
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = P.group_sizes(view(spark, sf_dir, "v_props"))
    return sizes.withColumns({c: F.col(c).cast("long") for c in ("min_length", "max_length")})


@query(
    "keys_with_enough_values",
    f"""{with_views('v_parts')}, k as (select *, {duck.key()} as composite_key from v_parts where value is not null)
    select composite_key, row_id, value from k
    where composite_key in (select composite_key from k group by 1 having count(*) >= 10)""",
)
def keys_with_enough_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keys_with_at_least(view(spark, sf_dir, "v_parts"), 10).select(KEY, "row_id", "value")


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders of the years before and from 1996 on, as two batches of the same keys (status only)."""
    items = view(spark, sf_dir, "v_orders")
    year = F.col("key_part2").cast("int")
    return [items.where(part).withColumn("key_part2", F.lit("all")) for part in (year < 1996, year >= 1996)]


_MERGE_SQL = """{views}, b as (select key_part1 || '||all||' || key_part3 as composite_key, value, row_id,
        cast(key_part2 as int) >= 1996 as late, {sig} as sig from v_orders)"""


@query(
    "merge_batches_sum",
    f"""{_MERGE_SQL.format(views=with_views('v_orders'), sig=duck.signature('value'))},
    per as (select composite_key, late, count(*) as n, count(distinct value) as u from b group by 1, 2),
    s as (select composite_key, sig, count(*) as n from b group by 1, 2),
    t as (select composite_key, string_agg(sig || '~' || n, '|' order by n desc, sig) as signatures from s group by 1)
    select composite_key, cast(sum(n) as bigint) as "count", cast(sum(u) as bigint) as unique_values,
      round(sum(u) * 1.0 / sum(n), 6) as unique_ratio, sum(u) * 1.0 / sum(n) > 0.8 as is_free_text,
      any_value(signatures) as signatures
    from per join t using (composite_key) group by 1""",
)
def merge_batches_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "sum")


@query(
    "merge_batches_sketch",
    f"""{_MERGE_SQL.format(views=with_views('v_orders'), sig=duck.signature('value'))},
    s as (select composite_key, sig, count(*) as n from b group by 1, 2),
    t as (select composite_key, string_agg(sig || '~' || n, '|' order by n desc, sig) as signatures from s group by 1)
    select composite_key, count(*) as "count", count(distinct value) as unique_values,
      round(count(distinct value) * 1.0 / count(*), 6) as unique_ratio, count(distinct value) * 1.0 / count(*) > 0.8 as is_free_text,
      any_value(signatures) as signatures
    from b join t using (composite_key) group by 1""",
)
def merge_batches_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "sketch")


def _merged(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    first, second = (merge.batch_stats(b) for b in _batches(spark, sf_dir))
    merged = merge.merge_batch_stats(first.unionByName(second), mode=mode)
    tops = F.transform("top_signatures", lambda s: F.concat_ws("~", s["sig"], s["count"].cast("string")))
    return merged.select(
        KEY,
        "count",
        "unique_values",
        F.round("unique_ratio", 6).alias("unique_ratio"),
        "is_free_text",
        F.array_join(tops, "|").alias("signatures"),
    )


@query(
    "merge_key_rows",
    f"""{_MERGE_SQL.format(views=with_views('v_orders'), sig=duck.signature('value'))},
    per as (select composite_key, late, count(*) as n, count(distinct value) as u from b group by 1, 2)
    select composite_key, cast(sum(n) as bigint) as "count", cast(sum(u) as bigint) as unique_values,
      round(avg(u * 1.0 / n), 6) as unique_ratio, bool_or(u * 1.0 / n > 0.8) as is_free_text from per group by 1""",
)
def merge_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (P.key_totals(P.signature_table(P.value_table(b))) for b in _batches(spark, sf_dir))
    return merge.merge_key_rows(first.unionByName(second)).withColumn("unique_ratio", F.round("unique_ratio", 6))


@query(
    "concat_batches",
    f"""{with_views('v_orders')} select row_id, {duck.key()} as composite_key, value from v_orders""",
)
def concat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_orders")
    year = F.col("key_part2").cast("int")
    keyed = [add_composite_key(b) for b in (items.where(year < 1996), items.where(year >= 1996))]
    return keyed[0].unionByName(keyed[1]).select("row_id", KEY, "value")


@query(
    "positional_ids",
    f"""{_base('parts')}, {_HIST} select composite_key, value, row_number() over (partition by composite_key order by value) - 1 as position
    from (select distinct composite_key, value from vals)""",
)
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.vectors import positions

    values = P.value_table(view(spark, sf_dir, "v_parts"))
    return positions(values.select(KEY, "value")).select(KEY, "value", "position")


