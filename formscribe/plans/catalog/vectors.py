"""Vector tables and exact neighbour search over the embeddings table; its label is the key."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators import neighbours as N
from formscribe.operators import vectors as V
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import number_items
from formscribe.plans.catalog import query
from formscribe.plans.views import load, view
from formscribe.session import cut_lineage


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, number = F.col("label").cast("string"), F.col("vec_id").cast("string")
    rows = load(spark, sf_dir, "embeddings")
    return rows.select(label.alias(KEY), number.alias("id"), F.concat(F.lit("v"), number).alias("value"), F.col("embedding").alias("vec"))


_E = """with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
    p as (select a.vec_id as q, b.vec_id as c, a.label, list_cosine_similarity(a.v, b.v) as sim,
          list_distance(a.v, b.v) as dist from e a join e b on a.label = b.label and a.vec_id <> b.vec_id)"""


@query(
    "unit_vectors",
    """with e as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
    n as (select vec_id, sqrt(sum(cast(x as double) * cast(x as double))) as len from e group by 1)
    select vec_id, i as position, round(cast(x as double) / len, 6) as x from e join n using (vec_id)""",
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("position"), F.round("x", 6).alias("x"))


@query(
    "similar_pairs",
    f"""{_E} select cast(label as varchar) as composite_key, q as id1, c as id2, round(sim, 6) as similarity
    from p where q < c and sim >= 0.3""",
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(N.similar_pairs(vectors(spark, sf_dir), 0.3))


@query(
    "similar_pairs_in_cells",
    f"""{_E} select cast(label as varchar) as composite_key, q as id1, c as id2, round(sim, 6) as similarity
    from p where q < c and sim >= 0.35""",
)
def similar_pairs_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small blocks, so that a key meets itself in many pairs of blocks."""
    return _pairs(N.similar_pairs(vectors(spark, sf_dir), 0.35, Settings(block_rows=16)))


@query(
    "similar_pairs_approx_recall",
    f"""{_E} select true as reached, true as exact from p limit 1""",
)
def similar_pairs_approx_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the bands find the wanted share of all pairs, and only pairs of the exact result with its cosine?"""
    every, wanted = N.similar_pairs(vectors(spark, sf_dir), 0.3), F.lit(0.9)
    found = N.similar_pairs_approx(vectors(spark, sf_dir), 0.3, recall=0.95, bits=4)
    named = [F.col(c).alias(f"f_{c}") for c in (KEY, "id1", "id2", "similarity")]
    both = every.join(found.select(*named), [F.col(c) == F.col(f"f_{c}") for c in (KEY, "id1", "id2")], "full")
    wrong = F.count_if(F.col(KEY).isNull() | (F.abs(F.col("similarity") - F.col("f_similarity")) > 1e-9))
    return both.agg((F.count("f_id1") >= wanted * F.count("id1")).alias("reached"), (wrong == 0).alias("exact"))


_FAILED = _E.replace("from embeddings)", "from embeddings where vec_id % 10 <> 0)", 1)


def half_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors after an encoder failed on every tenth row."""
    return vectors(spark, sf_dir).withColumn("vec", F.when(F.col("id").cast("long") % 10 != 0, F.col("vec")))


@query(
    "similar_pairs_failed_vectors",
    f"""{_FAILED} select cast(label as varchar) as composite_key, q as id1, c as id2, round(sim, 6) as similarity, 'ok' as status
    from p where q < c and sim >= 0.3
    union all select cast(label as varchar), vec_id, null, null, 'no_vector' from embeddings where vec_id % 10 = 0""",
)
def similar_pairs_failed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = half_encoded(spark, sf_dir)
    failed = V.failed_vectors(rows).withColumnRenamed("id", "id1").withColumn("id1", F.col("id1").cast("long"))
    return _pairs(N.similar_pairs(rows, 0.3)).withColumn("status", F.lit("ok")).unionByName(failed, allowMissingColumns=True)


def _pairs(found: DataFrame) -> DataFrame:
    a, b = F.col("id1").cast("long"), F.col("id2").cast("long")
    return found.select(KEY, F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), F.round("similarity", 6).alias("similarity"))


@query(
    "sorted_pairs",
    f"""{_E} select q as id1, c as id2, round(sim, 6) as similarity, row_number() over (order by sim desc, q, c) as place
    from p where q < c and sim >= 0.3""",
)
def sorted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in the order of their similarity, with their place in it."""
    found = N.similar_pairs(vectors(spark, sf_dir), 0.3)
    a, b = F.col("id1").cast("long"), F.col("id2").cast("long")
    pairs = found.select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), "similarity")
    ordered = pairs.withColumn("order", F.struct((-F.col("similarity")).alias("s"), "id1", "id2"))
    placed = number_items(ordered, [], "order", "place")
    return placed.select("id1", "id2", F.round("similarity", 6).alias("similarity"), (F.col("place") + 1).alias("place"))


def _search_sql(score: str, extra: str = "") -> str:
    return f"""{_E}, r as (select label, q, c, {score} as s, row_number() over (partition by q order by {score} desc, cast(c as varchar)) as rank
      from p) select cast(label as varchar) as composite_key, q as query_id, c as id, round(s, 6) as similarity, rank from r where rank <= 5 {extra}"""


def _found(df: DataFrame) -> DataFrame:
    return df.select(
        KEY,
        F.col("query_id").cast("long").alias("query_id"),
        F.col("id").cast("long").alias("id"),
        F.round("similarity", 6).alias("similarity"),
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "search_failed_vectors",
    _search_sql("sim").replace(_E, _FAILED) + " union all select cast(label as varchar), vec_id, null, null, null from embeddings where vec_id % 10 = 0",
)
def search_failed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a vector find nothing and are nobody's neighbour; they come back without one."""
    rows = half_encoded(spark, sf_dir)
    failed = V.failed_vectors(rows).select(KEY, F.col("id").cast("long").alias("query_id"))
    return _found(N.search(rows, rows, 5, skip_same_id=True)).unionByName(failed, allowMissingColumns=True)


@query("search_cosine", _search_sql("sim"))
def search_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _found(N.search(rows, rows, 5, "cosine", skip_same_id=True))


@query("search_l2", _search_sql("1.0 / (1.0 + dist * dist)"))
def search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _found(N.search(rows, rows, 5, "euclidean", skip_same_id=True))


@query("search_threshold", _search_sql("sim", "and s >= 0.35"))
def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small blocks, so that partial lists are merged."""
    from formscribe.config import Settings

    rows = vectors(spark, sf_dir)
    return _found(N.search(rows, rows, 5, "cosine", threshold=0.35, skip_same_id=True, settings=Settings(block_rows=13)))


@query(
    "duplicate_check",
    f"""{_E}, r as (select label, q, c, sim, row_number() over (partition by q order by sim desc, cast(c as varchar)) as rank
      from p where sim >= 0.3) select cast(label as varchar) as composite_key, q as query_id, round(max(sim), 6) as similarity,
      string_agg('v' || c, '|' order by rank) as nearest_examples from r where rank <= 3 group by 1, 2""",
)
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    queries = rows.withColumn("normalized", F.col("id"))
    found = N.search(rows, rows, 5, "cosine", threshold=0.3, skip_same_id=True)
    return N.grouped_duplicates(found, queries, rows).select(
        KEY,
        F.col("normalized").cast("long").alias("query_id"),
        F.round("similarity", 6).alias("similarity"),
        F.array_join("nearest_examples", "|").alias("nearest_examples"),
    )


_NORMS = """with e as (select label, len(embedding) as d, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings)
    select {key} as composite_key, count(*) as "count", max(d) as dimension, round(avg(n), 6) as mean_norm, round(stddev_pop(n), 6) as std_norm,
      round(min(n), 6) as min_norm, round(max(n), 6) as max_norm from e group by 1"""


@query(
    "vector_stats",
    _NORMS.format(key="cast(label as varchar)") + " union all (" + _NORMS.format(key="''") + ")",
)
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    overall = V.vector_stats(rows, per_key=False).withColumn(KEY, F.lit(""))
    both = V.vector_stats(rows).unionByName(overall).withColumn("dimension", F.col("dimension").cast("long"))
    return both.withColumns({f"{c}_norm": F.round(f"{c}_norm", 6) for c in ("mean", "std", "min", "max")})


@query(
    "index_status",
    """with k as (select distinct cast(label as varchar) as composite_key from embeddings union select 'empty'),
    c as (select cast(label as varchar) as composite_key, count(*) as n, max(len(embedding)) as d from embeddings group by 1)
    select k.composite_key, case when n >= 50 then 'ivf' else 'flat' end as index_type, coalesce(d, 0) as dimension,
      coalesce(n, 0) as "count", case when n > 0 then 'success' else 'empty' end as status from k left join c using (composite_key)""",
)
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.config import Settings

    rows = vectors(spark, sf_dir)
    keys = rows.select(KEY).unionByName(spark.range(1).select(F.lit("empty").alias(KEY)))
    return V.index_status(keys, rows, Settings(nlist=50), "ivf")


@query(
    "index_totals",
    """select count(distinct label) as total_indices, count(*) as total_vectors, 'flat' as index_type, 'cosine' as metric from embeddings""",
)
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.index_totals(vectors(spark, sf_dir))


@query("remove_keys", "select cast(label as varchar) as composite_key, vec_id from embeddings where label not in (3, 7)")
def remove_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    dropped = rows.where(F.col(KEY).isin("3", "7")).select(KEY).distinct()
    return V.remove_keys(rows, dropped).select(KEY, F.col("id").cast("long").alias("vec_id"))


@query("add_vectors", "select cast(label as varchar) as composite_key, count(*) as \"count\" from embeddings group by 1")
def add_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping halves give every vector once."""
    rows = vectors(spark, sf_dir)
    label = F.col(KEY).cast("int")
    grown = V.add_vectors(rows.where(label <= 6), rows.where(label >= 4))
    return grown.groupBy(KEY).agg(F.count(F.lit(1)).alias("count"))


@query("embed_values")
def embed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.keys import add_composite_key

    return V.embed_values(add_composite_key(view(spark, sf_dir, "v_parts")))


@query("validate_with_neighbours")
def validate_with_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against profiles, rules and the vectors of the learnt values."""
    from formscribe.operators import validate as D
    from formscribe.operators.keys import add_composite_key
    from formscribe.plans.catalog.validation import AS_OF, learnt, requests

    profiles, rules = learnt(spark, sf_dir)
    asked = requests(spark, sf_dir)
    prepared = D.prepare_requests(asked, profiles, rules).where(F.col("known"))
    stored = cut_lineage(V.embed_values(add_composite_key(view(spark, sf_dir, "v_parts"))))
    duplicates = N.duplicate_check(prepared, stored)
    return D.validate_values(asked, profiles, rules, duplicates, as_of=F.lit(AS_OF).cast("timestamp"))
