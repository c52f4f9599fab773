"""Sources and sinks: tables written to the shared folder and read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import SMALL_DATA
from formscribe.functions.sqlnames import register
from formscribe.operators.normalize import rules_from_profiles
from formscribe.operators.profile import KEY, key_profiles
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.profiles import profile_cte
from formscribe.plans.catalog.rules import hints_cte
from formscribe.plans.views import load, sql_view, view, with_views
from formscribe.session import scratch_path
from formscribe.sources import artefacts as A
from formscribe.sources import tables as T


def _csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch_path(spark, f"csv-{name}")
    A.write_csv(view(spark, sf_dir, name), path)
    return path


@query("read_csv_items", f"{with_views('v_customers')} select cast(row_id as varchar) as row_id, key_part1, key_part2, key_part3, value from v_customers")
def read_csv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = T.split_corrupt(T.read_items(spark, _csv(spark, sf_dir, "v_customers")))
    return good


@query(
    "read_csv_docs",
    f"""{with_views('v_docs')} select cast(row_id as varchar) as row_id, key_part1, key_part2, key_part3, md5(value) as digest, length(value) as chars from v_docs""",
)
def read_csv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with commas, quotes and line breaks come back as they were."""
    good, _ = T.split_corrupt(T.read_items(spark, _csv(spark, sf_dir, "v_docs")))
    return good.withColumn("digest", F.md5("value")).withColumn("chars", F.length("value").cast("long")).drop("value")


@query(
    "read_csv_ranges",
    f"""{with_views('v_docs')} select cast(row_id as varchar) as row_id, key_part1, key_part2, key_part3, md5(value) as digest, length(value) as chars from v_docs""",
)
def read_csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts out of one file that is cut into ranges of 64 KiB, so that records cross them."""
    path = scratch_path(spark, "csv-one-file")
    A.write_csv(view(spark, sf_dir, "v_docs").coalesce(1), path)
    small = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        good, _ = T.split_corrupt(T.read_items(spark, path))
        out = scratch_path(spark, "csv-read")
        good.write.parquet(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    read = spark.read.parquet(out)
    return read.withColumn("digest", F.md5("value")).withColumn("chars", F.length("value").cast("long")).drop("value")


@query(
    "ingest_csv",
    f"""{with_views('v_orders')}, {duck.keyed('v_orders')} select composite_key, count(*) as "count", count(distinct value) as unique_values,
      round(count(distinct value) * 1.0 / count(*), 6) as unique_ratio from keyed group by 1""",
)
def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats = T.ingest_checked(spark, _csv(spark, sf_dir, "v_orders"))
    return stats.select(KEY, "count", "unique_values", F.round("unique_ratio", 6).alias("unique_ratio"))


@query(
    "missing_values",
    """select o_orderkey as row_id, case when o_orderstatus = 'P' then null else o_orderpriority end as value from orders""",
)
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that mean missing come back as NULL."""
    status = F.col("o_orderstatus")
    marked = F.when(status == "P", F.lit("N/A")).otherwise(F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), T.missing_to_null(marked).alias("value"))


@query(
    "quarantine",
    """select case when o_orderstatus = 'P' then 'bad' else 'good' end as kind,
      o_orderstatus || ',' || o_orderkey || ',x,' || o_orderpriority || case when o_orderstatus = 'P' then ',extra,cells' else '' end as line from orders""",
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with too many cells are set aside, the others are kept."""
    path = scratch_path(spark, "lines")
    line = F.concat_ws(",", "o_orderstatus", F.col("o_orderkey").cast("string"), F.lit("x"), "o_orderpriority")
    broken = F.when(F.col("o_orderstatus") == "P", F.concat(line, F.lit(",extra,cells"))).otherwise(line)
    load(spark, sf_dir, "orders").select(broken.alias("line")).write.text(path)
    columns = ("key_part1", "key_part2", "key_part3", "value")
    good, bad = T.split_corrupt(T.read_items(spark, path, columns=columns, header=False))
    kept = good.select(F.lit("good").alias("kind"), F.concat_ws(",", *columns).alias("line"))
    return kept.unionByName(bad.select(F.lit("bad").alias("kind"), F.col(bad.columns[0]).alias("line")))


@query(
    "json_profiles",
    f"""{profile_cte('parts', 2, 5.0)} select composite_key, "count", unique_values, candidate_regex from prof""",
)
def json_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    profiles = key_profiles(view(spark, sf_dir, "v_parts"), SMALL_DATA)
    A.write_json(profiles, path)
    return A.read_json(spark, path, profiles.schema).select(KEY, "count", "unique_values", "candidate_regex")


@query(
    "keyed_tables",
    f"""{profile_cte('parts')}, {hints_cte()} select composite_key, hints as rules, cast(n_rules as bigint) as n_rules from hints""",
)
def keyed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "rules")
    A.write_keyed(rules_from_profiles(key_profiles(view(spark, sf_dir, "v_parts"))), path)
    rules = A.read_keyed(spark, path)
    names = F.transform("rules", lambda r: r["name"])
    return rules.select(KEY, F.array_join(names, "|").alias("rules"), F.size("rules").cast("long").alias("n_rules"))


@query("stored_vectors", "select cast(label as varchar) as composite_key, cast(vec_id as varchar) as id, round(list_sum(embedding::double[]), 6) as total from embeddings")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.plans.catalog.vectors import vectors

    path = scratch_path(spark, "vectors")
    A.write_keyed(vectors(spark, sf_dir), path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return A.read_keyed(spark, path).select(KEY, "id", F.round(total, 6).alias("total"))


@query(
    "stage_table",
    f"""{with_views('v_parts')}, {duck.keyed('v_parts')} select composite_key, value, count(*) as n from keyed group by 1, 2""",
)
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call reads what the first one stored."""
    from formscribe.operators.profile import value_table

    path = scratch_path(spark, "stage")
    A.stage(spark, path, lambda: value_table(view(spark, sf_dir, "v_parts")))
    return A.stage(spark, path, lambda: spark.range(0)).select(KEY, "value", "n")


@query(
    "learning_data_files",
    f"""with r as ({sql_view('v_reviews')}) select composite_key, decision, count(*) as "count" from r where composite_key <> 'view' group by 1, 2""",
)
def learning_data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.review import decision_distribution, review_history
    from formscribe.plans.catalog.reviews import decisions, items

    path = scratch_path(spark, "learning")
    queued, decided = items(spark, sf_dir), decisions(spark, sf_dir)
    A.export_learning_data(queued, decided, path)
    read = A.import_learning_data(spark, path, queued.schema, decided.schema)
    return decision_distribution(review_history(*read), per_key=True)


@query(
    "learn_run",
    f"""{with_views('v_parts')}, k as (select {duck.key()} as composite_key, value from v_parts)
    select count(*) as total_rows, count(distinct composite_key) as unique_keys, count(distinct composite_key) as key_profiles,
      count(distinct composite_key) as normalization_rules, (select count(*) from (select distinct composite_key, value from k)) as embedding_vectors from k""",
)
def learn_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.plans.learn import learn

    tables = learn(spark, view(spark, sf_dir, "v_parts"), scratch_path(spark, "learn"))
    return tables["report"].drop("clustering_models")


@query(
    "sql_functions",
    f"""{with_views('v_parts')} select row_id, {duck.signature('value')} as sig, {duck.signature_regex(duck.signature('value'))} as regex,
      {duck.collapse_whitespace('value')} as spaced, {duck.join_number_and_unit('value')} as joined,
      {duck.drop_thousands_separators('value')} as plain, {duck.title_case('value')} as titled from v_parts""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql(
        """select row_id, signature(value) as sig, signature_regex(signature(value)) as regex, collapse_whitespace(value) as spaced,
        join_number_and_unit(value) as joined, drop_thousands_separators(value) as plain, title_case(value) as titled from {items}""",
        items=view(spark, sf_dir, "v_parts"),
    )
