"""Item views over the given tables; the same SQL text runs in Spark and in the checking database."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    "v_orders": """
        select cast(o_orderkey as bigint) as row_id, o_orderstatus as key_part1,
               cast(year(o_orderdate) as varchar(8)) as key_part2, 'priority' as key_part3,
               o_orderpriority as value
        from {orders}""",
    "v_parts": """
        select cast(p_partkey as bigint) as row_id, p_type as key_part1, p_brand as key_part2,
               case when p_size <= 25 then 'small' else 'large' end as key_part3,
               case p_partkey % 5 when 0 then concat(cast(p_size as varchar(8)), ' V')
                                  when 1 then concat(cast(p_size as varchar(8)), 'mm')
                                  when 2 then concat(p_name, ' (', p_brand, ')')
                                  when 3 then concat('  ', p_name, '  x')
                                  else concat('1,', lpad(cast(p_size as varchar(8)), 3, '0'), ' Hz') end as value
        from {part}""",
    "v_customers": """
        select c_custkey as row_id, c_mktsegment as key_part1, r_name as key_part2, 'name' as key_part3,
               c_name as value
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "v_docs": """
        select doc_id as row_id, lang as key_part1, source as key_part2, 'text' as key_part3, text as value
        from {documents}""",
    "v_pages": """
        select page_id as row_id, 'web' as key_part1, 'page' as key_part2, 'url' as key_part3, url as value
        from {pages}""",
    "v_props": """
        select event_id as row_id, event_type as key_part1, cast(month(ts) as varchar(8)) as key_part2,
               'props' as key_part3, props as value
        from {events}""",
    # measured sizes: every value is a number with a unit
    "v_sizes": """
        select cast(p_partkey as bigint) as row_id, p_type as key_part1, 'size' as key_part2, 'unit' as key_part3,
               concat(cast(p_size as varchar(8)), case when p_size < 20 then ' mm' else 'cm' end) as value
        from {part}""",
    # descriptions of several words
    "v_names": """
        select cast(p_partkey as bigint) as row_id, p_type as key_part1, p_brand as key_part2, 'name' as key_part3,
               concat(p_name, ' ', lower(p_type), ' ', p_name) as value
        from {part}""",
}
VIEWS["v_mixed"] = " union all ".join(
    f"select '{name}' as src, row_id, key_part1, key_part2, key_part3, value from ({VIEWS['v_' + name]}) {name}"
    for name in ("parts", "customers", "docs", "pages")
)
VIEWS["v_reviews"] = """
        select cast(event_id as varchar(20)) as id, event_type as composite_key, props as original_value,
               case when value < 20 then 'accept' when value < 40 then 'edit' else 'reject' end as decision,
               case when value < 20 then null when value < 30 then replace(props, ' ', '')
                    when value < 40 then upper(props) else null end as corrected_value,
               ts as reviewed_at, 1.0 / (1.0 + value / 100.0) as confidence, user_id
        from {events}"""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def sql_view(name: str) -> str:
    """The view body for the checking database, where tables have their plain names."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def with_views(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({sql_view(n)})" for n in names)
