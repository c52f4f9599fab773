"""Composite keys and table checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions.text import key_label
from formscribe.operators import keys as K
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.views import load, view, with_views


@query("composite_key", f"{with_views('v_mixed')} select src, row_id, {duck.key()} as composite_key from v_mixed")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.add_composite_key(view(spark, sf_dir, "v_mixed")).select("src", "row_id", "composite_key")


@query(
    "composite_key_null_part",
    """select o_orderkey as row_id, coalesce(nullif(o_orderstatus, 'P'), 'nan') || '||' || o_orderpriority as composite_key
    from orders""",
)
def composite_key_null_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    key = K.composite_key([status, F.col("o_orderpriority")])
    return orders.select(F.col("o_orderkey").alias("row_id"), key.alias("composite_key"))


@query(
    "key_parts",
    f"""{with_views('v_parts')} select row_id, key_part1 as part1, key_part2 as part2, key_part3 as part3, 3 as n
    from v_parts""",
)
def key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = K.key_parts(F.col("composite_key"))
    return K.add_composite_key(view(spark, sf_dir, "v_parts")).select(
        "row_id", *[parts[i].alias(f"part{i + 1}") for i in range(3)], F.size(parts).alias("n")
    )


@query(
    "valid_key_parts",
    """select o_orderkey as row_id, (o_orderstatus <> 'P' and o_orderpriority <> '5-LOW') as valid3,
           false as valid2 from orders""",
)
def valid_key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a NULL for status P and a blank for low priority."""
    orders = load(spark, sf_dir, "orders")
    blank = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  ")).otherwise(F.col("o_orderpriority"))
    parts = F.array(F.nullif(F.col("o_orderstatus"), F.lit("P")), blank, F.lit("x"))
    return orders.select(
        F.col("o_orderkey").alias("row_id"),
        K.valid_key_parts(parts).alias("valid3"),
        K.valid_key_parts(parts, expected=2).alias("valid2"),
    )


@query(
    "check_table",
    """with c as (select count(*) as n, count(*) filter (where o_orderstatus = 'P') as p,
                        count(*) filter (where o_orderpriority = '5-LOW') as l from orders)
    select n > 0 as is_valid, 0 as n_issues, '' as issues,
      'Column ''key_part1'' has ' || p || ' null values|Value column ''value'' has ' || l || ' null values' as warnings
    from c""",
)
def check_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    items = orders.select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("key_part1"),
        F.lit("a").alias("key_part2"),
        F.lit("b").alias("key_part3"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("value"),
    )
    return K.check_table(items).select(
        "is_valid",
        F.size("issues").alias("n_issues"),
        F.array_join("issues", "|").alias("issues"),
        F.array_join("warnings", "|").alias("warnings"),
    )


@query(
    "canonical_columns",
    """select o_orderkey as row_id, o_orderstatus as key_part1, o_orderpriority as key_part2,
           cast(o_custkey as varchar) as value from orders""",
)
def canonical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(
        key_columns=("o_orderstatus", "o_orderpriority"), value_column="customer", order_column="o_orderkey"
    )
    orders = load(spark, sf_dir, "orders").withColumn("customer", F.col("o_custkey").cast("string"))
    return K.canonical_columns(orders, settings)


@query(
    "key_label",
    f"""{with_views('v_mixed')} select distinct src, {duck.key('value', 'key_part2')} as composite_key,
      replace(replace(replace({duck.key('value', 'key_part2')}, '/', '_'), '\\', '_'), ':', '_') as label from v_mixed""",
)
def key_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = K.composite_key([F.col("value"), F.col("key_part2")])
    df = view(spark, sf_dir, "v_mixed").select("src", key.alias("composite_key")).distinct()
    return df.withColumn("label", key_label(F.col("composite_key")))
