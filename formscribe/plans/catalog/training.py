"""Training examples."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.operators import mining as M
from formscribe.operators import report as S
from formscribe.operators.profile import KEY, value_table
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.views import view, with_views

_V = f"{with_views('v_parts')}, {duck.keyed('v_parts')}, d as (select composite_key, value, sig, count(*) as n from keyed group by 1, 2, 3)"
_ANCHORS = """g as (select composite_key, sig, count(*) as members, min(value) as least from d group by 1, 2),
    o as (select a.composite_key, a.sig, a.members, first(b.least order by b.sig) as negative from g a join g b
          on a.composite_key = b.composite_key and a.sig <> b.sig where a.members > 1 group by 1, 2, 3)"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_table(view(spark, sf_dir, "v_parts"))


@query(
    "triplet_anchors",
    f"""{_V}, {_ANCHORS} select d.composite_key, d.sig, d.value as anchor, members - 1 as n_positives, negative
    from d join o on d.composite_key = o.composite_key and d.sig = o.sig""",
)
def triplet_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.triplet_anchors(_values(spark, sf_dir))


@query(
    "first_triplets",
    f"""{_V}, {_ANCHORS} select a.composite_key, a.sig, a.value as anchor, p.value as positive, negative
    from d a join d p on a.composite_key = p.composite_key and a.sig = p.sig and a.value <> p.value
      join o on a.composite_key = o.composite_key and a.sig = o.sig order by 1, 2, 3, 4 limit 1000""",
)
def first_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_triplets(_values(spark, sf_dir), 1000)


@query(
    "similar_texts_edit",
    f"""{_V}, p as (select a.composite_key, a.value as l, b.value as r,
        1.0 - levenshtein(lower(a.value), lower(b.value)) / greatest(length(a.value), length(b.value)) as s
      from d a join d b on a.composite_key = b.composite_key and a.value < b.value)
    select composite_key, l as "left", r as "right", round(s, 6) as similarity from p where s > 0.8""",
)
def similar_texts_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.similar_texts(_values(spark, sf_dir), measure="edit")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("similar_texts")
def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.similar_texts(_values(spark, sf_dir))


@query(
    "drawn_partners",
    f"""{_V}, s as (select composite_key, ceil(count(*) / 1000.0) as nb from d group by 1),
    b as (select composite_key, value, md5(value) as h, cast('0x' || substr(md5(value), 1, 8) as bigint) % cast(nb as bigint) as b from d join s using (composite_key)),
    r as (select *, row_number() over (partition by composite_key, b order by h, value) as p from b)
    select x.composite_key, x.value as "left", y.value as "right" from r x join r y
      on x.composite_key = y.composite_key and x.b = y.b and y.p - x.p in (1, 2)""",
)
def drawn_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.drawn_partners(_values(spark, sf_dir))


@query("training_pairs")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.training_pairs(M.enough_values(_values(spark, sf_dir)))


@query("trainer_examples")
def trainer_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trainer_examples(M.enough_values(_values(spark, sf_dir)))


@query(
    "split_rows",
    f"""{with_views('v_parts')} select row_id, case when cast('0x' || substr(md5('42:' || row_id), 1, 8) as bigint) % 100 < 80 then 'train' else 'test' end as split
    from v_parts""",
)
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_rows(view(spark, sf_dir, "v_parts"), F.col("row_id")).select("row_id", "split")


@query(
    "format_variants",
    f"""{with_views('v_parts')}, v as (select row_id, value, case when contains(value, ' ') then replace(value, ' ', '  ')
        when upper(value) = value and lower(value) <> value then lower(value) end as variant,
        cast('0x' || substr(md5('42:' || row_id || chr(31) || value), 1, 8) as bigint) % 100 < 30 as drawn from v_parts)
    select row_id, value, false as is_variant from v union all select row_id, variant, true from v where drawn and variant is not null""",
)
def format_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.format_variants(view(spark, sf_dir, "v_parts")).select("row_id", "value", "is_variant")


@query(
    "learnt_transformations",
    f"""{with_views('v_parts')}, e as (select value, lower({duck.strip('value')}) as normalized from v_parts),
    k as (select case when lower(value) = normalized then 'to_lowercase' when {duck.strip('value')} = normalized then 'trim_whitespace'
        when length(value) > length(normalized) then 'remove_extra_chars' end as name from e where value <> normalized)
    select name, count(*) as frequency, round(count(*) * 1.0 / (select count(*) from k), 6) as confidence from k where name is not null
    group by 1 having count(*) > 0.1 * (select count(*) from k)""",
)
def learnt_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = M.learnt_transformations(M.changed_examples(view(spark, sf_dir, "v_parts")))
    return learnt.withColumn("confidence", F.round("confidence", 6))


_KEPT = "kept as (select d.* from d join (select composite_key from d group by 1 having sum(n) >= 10) using (composite_key))"


@query(
    "training_table_sizes",
    f"""{_V}, {_KEPT} select count(distinct composite_key) as keys, count(*) as labelled,
      (select count(*) from kept where lower({duck.strip('value')}) <> value) as changed,
      (select count(*) from (select distinct composite_key, sig from kept)) as signatures from kept""",
)
def training_table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = M.training_tables(_values(spark, sf_dir))
    return tables["clustering"].agg(F.count_distinct(KEY).alias("keys"), F.count(F.lit(1)).alias("labelled")).select(
        "keys",
        "labelled",
        tables["normalization"].agg(F.count(F.lit(1))).scalar().alias("changed"),
        tables["patterns"].select(KEY, "sig").distinct().agg(F.count(F.lit(1))).scalar().alias("signatures"),
    )


@query(
    "training_summary",
    f"""{_V}, {_KEPT}, p as (select a.composite_key from kept a join kept b on a.composite_key = b.composite_key and a.value < b.value
      and 1.0 - levenshtein(lower(a.value), lower(b.value)) / greatest(length(a.value), length(b.value)) > 0.8)
    select count(distinct composite_key) as clustering_keys, (select count(*) from p) as embedding_pairs,
      (select count(*) from kept where lower({duck.strip('value')}) <> value) as normalization_examples from kept""",
)
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = M.enough_values(_values(spark, sf_dir))
    pairs = M.similar_texts(kept, measure="edit")
    return S.training_summary(kept, pairs, M.changed_examples(kept))


@query(
    "models_with_test_rows",
    f"""{_V}, {_KEPT} select count(*) as "count", count(distinct composite_key) as keys from d
    where composite_key in (select composite_key from kept)""",
)
def models_with_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test values of the keys that have a trained model."""
    values = _values(spark, sf_dir)
    trained = M.enough_values(values).select(KEY).distinct()
    tested = values.join(trained, KEY)
    return tested.agg(F.count(F.lit(1)).alias("count"), F.count_distinct(KEY).alias("keys"))
