"""Terms, clustering, scores and model choice."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators import cluster as C
from formscribe.operators import mining as M
from formscribe.operators import report as S
from formscribe.operators import terms as T
from formscribe.operators.profile import KEY, key_profiles, value_table
from formscribe.operators.silhouette import adjusted_rand_index, silhouette
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.profiles import profile_cte
from formscribe.plans.views import load, view, with_views
from formscribe.session import cut_lineage


def _terms_sql(name: str, low: int, high: int, features: int) -> str:
    """CTEs d (distinct values), tf and voc (kept terms with idf); n-grams come from the words that follow."""
    grams = " union all ".join(
        f"select composite_key, value, n, concat_ws(' ', {', '.join(f't{j}' for j in range(n))}) as term from w where t{n - 1} is not null"
        for n in range(low, high + 1)
    )
    leads = ", ".join(f"lead(t, {j}) over (partition by composite_key, value order by i) as t{j}" for j in range(high))
    return f"""{with_views('v_' + name)}, k as (select {duck.key()} as composite_key, value from v_{name} where value is not null),
    d as (select composite_key, value, count(*) as n, regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}_]{{2,}}') as words from k group by 1, 2),
    u as (select composite_key, value, n, unnest(words) as t, generate_subscripts(words, 1) as i from d),
    w as (select composite_key, value, n, {leads} from u),
    g as ({grams}),
    tf as (select composite_key, value, n, term, count(*) as tf from g group by 1, 2, 3, 4),
    docs as (select composite_key, sum(n) as docs from d group by 1),
    df as (select composite_key, term, sum(n) as df, sum(tf * n) as total from tf group by 1, 2),
    voc as (select df.*, docs, ln((1 + docs) / (1 + df)) + 1 as idf from df join docs using (composite_key) where df <= 0.95 * docs
            qualify row_number() over (partition by composite_key order by total desc, term) <= {features})"""


@query(
    "vocabulary",
    f"{_terms_sql('docs', 2, 4, 2000)} select composite_key, term, cast(df as bigint) as df, round(idf, 6) as idf from voc",
)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = value_table(view(spark, sf_dir, "v_docs"))
    terms = T.vocabulary(values, T.term_counts(values, per_value=False))
    return terms.select(KEY, "term", "df", F.round("idf", 6).alias("idf"))


@query(
    "tfidf",
    f"""{_terms_sql('names', 1, 3, 40)}, raw as (select tf.composite_key, value, term, tf * idf as raw from tf join voc using (composite_key, term)),
    len as (select composite_key, value, sqrt(sum(raw * raw)) as len from raw group by 1, 2)
    select composite_key, value, term, round(raw / len, 6) as w from raw join len using (composite_key, value)""",
)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(ngram_min=1, ngram_max=3, max_features=40)
    values = value_table(view(spark, sf_dir, "v_names"))
    rows, terms = T.tfidf_rows(values, settings)
    entries = rows.select(KEY, "value", F.explode(F.arrays_zip("idx", "w")).alias("e")).select(KEY, "value", "e.*")
    return entries.join(terms.select(KEY, "idx", "term"), [KEY, "idx"]).select(KEY, "value", "term", F.round("w", 6).alias("w"))


@query(
    "cluster_routes",
    f"""{profile_cte('parts')} select composite_key, "count" as total, case when "count" < 5 then 'insufficient_data'
      when is_numeric_unit then 'numeric_unit' when is_free_text then 'embeddings' else 'tfidf' end as method from prof""",
)
def cluster_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_parts")
    return C.cluster_routes(value_table(items), key_profiles(items), use_embeddings=True)


_GIVEN = f"""{with_views('v_parts')}, {duck.keyed('v_parts')},
    lab as (select *, case when {duck.has_parentheses('value')} then -1 when {duck.digit('value')} then 1 else 0 end as cluster from keyed)"""


def _given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values labelled by a plain rule: bracketed ones are noise, then with or without digits."""
    value = F.col("value")
    label = F.when(text.has_parentheses(value), -1).when(text.has_digit(value), 1).otherwise(0)
    return value_table(view(spark, sf_dir, "v_parts")).withColumn("cluster", label)


@query(
    "describe_clusters",
    f"""{_GIVEN}, s as (select composite_key, cluster, sig, count(*) as n from lab where cluster >= 0 group by 1, 2, 3),
    m as (select composite_key, cluster, sig from s qualify row_number() over (partition by composite_key, cluster order by n desc, sig) = 1),
    v as (select composite_key, cluster, value, min(row_id) as p from lab group by 1, 2, 3),
    e as (select composite_key, cluster, string_agg(value, '^' order by p, value) as examples from
      (select *, row_number() over (partition by composite_key, cluster order by p, value) as r from v) where r <= 3 group by 1, 2)
    select l.composite_key, cast(l.cluster as integer) as cluster, count(*) as size, any_value(m.sig) as pattern_signature,
      {duck.signature_regex('any_value(m.sig)')} as cluster_regex, any_value(examples) as examples,
      round(count(*) * 100.0 / any_value(t.total), 6) as coverage_pct
    from lab l join m on l.composite_key = m.composite_key and l.cluster = m.cluster
      join e on l.composite_key = e.composite_key and l.cluster = e.cluster
      join (select composite_key, count(*) as total from lab group by 1) t on l.composite_key = t.composite_key
    group by 1, 2""",
)
def describe_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = C.describe_clusters(_given_labels(spark, sf_dir)).drop("top_terms")
    return described.select(
        KEY, "cluster", "size", "pattern_signature", "cluster_regex",
        F.array_join("example_values", "^").alias("examples"), F.round("coverage_pct", 6).alias("coverage_pct"),
    )


@query(
    "cluster_top_terms",
    f"""{_terms_sql('names', 1, 3, 40)}, raw as (select tf.composite_key, value, n, term, tf * idf as raw from tf join voc using (composite_key, term)),
    len as (select composite_key, value, sqrt(sum(raw * raw)) as len from raw group by 1, 2),
    lab as (select composite_key, value, n, length(value) > 30 as long from d),
    size as (select composite_key, long, sum(n) as size from lab group by 1, 2),
    sc as (select composite_key, long, term, sum(raw / len * raw.n) as s from raw join len using (composite_key, value) join lab using (composite_key, value) group by 1, 2, 3),
    r as (select sc.*, s / size as score, row_number() over (partition by composite_key, long order by round(s / size, 9) desc, term) as r from sc join size using (composite_key, long))
    select composite_key, cast(long as integer) as cluster, string_agg(term, '|' order by r) as top_terms from r where r <= 5 group by 1, 2""",
)
def cluster_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(ngram_min=1, ngram_max=3, max_features=40)
    values = value_table(view(spark, sf_dir, "v_names"))
    labels = values.select(KEY, F.md5("value").alias("id"), "n", (F.length("value") > 30).cast("int").alias("cluster"))
    # equal scores differ in the last bits, depending on the order of addition
    weights = C.weights_table(values, settings)
    return C.top_terms(labels, weights).select(KEY, "cluster", F.array_join("top_terms", "|").alias("top_terms"))


_SIZES = f"""{with_views('v_sizes')}, k as (select {duck.key()} as composite_key, value, row_id,
      cast(regexp_extract(value, '^([0-9]+)', 1) as double) as x, regexp_extract(value, '([A-Za-z]+)$', 1) as unit from v_sizes)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.numeric_rows(value_table(view(spark, sf_dir, "v_sizes")))
    return rows.withColumn("cluster", F.when(F.col("number") < 15, 0).when(F.col("number") < 40, 1).otherwise(2))


@query(
    "describe_numeric_clusters",
    f"""{_SIZES}, l as (select *, case when x < 15 then 0 when x < 40 then 1 else 2 end as cluster from k),
    u as (select composite_key, cluster, unit from l group by 1, 2, 3
          qualify row_number() over (partition by composite_key, cluster order by count(*) desc, unit) = 1),
    v as (select composite_key, cluster, value, min(row_id) as p from l group by 1, 2, 3),
    e as (select composite_key, cluster, string_agg(value, '^' order by p, value) as examples from
      (select *, row_number() over (partition by composite_key, cluster order by p, value) as r from v) where r <= 3 group by 1, 2)
    select l.composite_key, l.cluster, count(*) as size, min(x) as min, max(x) as max, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std,
      any_value(u.unit) as most_common_unit, any_value(examples) as examples, round(count(*) * 100.0 / any_value(t.total), 6) as coverage_pct
    from l join u on l.composite_key = u.composite_key and l.cluster = u.cluster
      join e on l.composite_key = e.composite_key and l.cluster = e.cluster
      join (select composite_key, count(*) as total from l group by 1) t on l.composite_key = t.composite_key group by 1, 2""",
)
def describe_numeric_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = C.describe_numeric_clusters(_sizes(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "coverage_pct")}
    return described.withColumns(rounded).withColumn("examples", F.array_join("example_values", "^")).drop("example_values")


@query(
    "silhouette",
    f"""{_SIZES}, l as (select row_id, composite_key, x, case when x < 15 then 0 when x < 40 then 1 else 2 end as cluster from k),
    s as (select composite_key, cluster, count(*) as size from l group by 1, 2),
    d as (select a.composite_key, a.row_id, a.cluster as own, b.cluster as other, sum(abs(a.x - b.x)) as total from l a join l b using (composite_key) group by 1, 2, 3, 4),
    m as (select d.composite_key, row_id, max(case when own = other then total / nullif(size - 1, 0) end) as a, min(case when own <> other then total / size end) as b
          from d join s on d.composite_key = s.composite_key and d.other = s.cluster group by 1, 2)
    select composite_key, round(avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from m group by 1""",
)
def silhouette_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silhouette(_sizes(spark, sf_dir)).withColumn("silhouette", F.round("silhouette", 6))


@query(
    "silhouette_vectors",
    """with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
    s as (select label, count(*) as size from e group by 1),
    d as (select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.v, b.v)) as total from e a, e b group by 1, 2, 3),
    m as (select vec_id, max(case when own = other then total / nullif(size - 1, 0) end) as a, min(case when own <> other then total / size end) as b
          from d join s on d.other = s.label group by 1)
    select 'all' as composite_key, round(avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from m""",
)
def silhouette_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key cut into several blocks."""
    rows = load(spark, sf_dir, "embeddings").select(
        F.lit("all").alias(KEY),
        F.col("vec_id").cast("string").alias("id"),
        F.lit(1).cast("long").alias("n"),
        F.col("label").alias("cluster"),
        F.sequence(F.lit(0), F.size("embedding") - 1).alias("idx"),
        F.transform("embedding", lambda x: x.cast("double")).alias("w"),
    )
    return silhouette(rows, settings=Settings(block_rows=128)).withColumn("silhouette", F.round("silhouette", 6))


@query(
    "adjusted_rand_index",
    f"""{_GIVEN}, c as (select composite_key, sig, cluster, count(*) as n from lab group by 1, 2, 3),
    j as (select composite_key, sum(n * (n - 1) / 2) as both_, sum(n) as total from c group by 1),
    t as (select composite_key, sum(n * (n - 1) / 2) as t from (select composite_key, sig, sum(n) as n from c group by 1, 2) group by 1),
    p as (select composite_key, sum(n * (n - 1) / 2) as p, count(*) as k from (select composite_key, cluster, sum(n) as n from c group by 1, 2) group by 1),
    x as (select composite_key, both_, k, t * p / (total * (total - 1) / 2) as expected, (t + p) / 2 as best, total from j join t using (composite_key) join p using (composite_key))
    select composite_key, round(case when total < 2 or best = expected then 1.0 else (both_ - expected) / (best - expected) end, 6) as adjusted_rand_index, k as clusters_predicted from x""",
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = adjusted_rand_index(_given_labels(spark, sf_dir), "sig", "cluster", weight="n")
    return scored.withColumn("adjusted_rand_index", F.round("adjusted_rand_index", 6))


_SCORES = f"""{with_views('v_parts')}, {duck.keyed('v_parts')}, st as (select composite_key, count(distinct sig) as sigs, count(distinct value) * 1.0 / count(*) as ratio,
      count(distinct length(value)) * 1.0 / count(*) as lengths from keyed group by 1)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = value_table(view(spark, sf_dir, "v_parts"))
    return values.groupBy(KEY).agg(
        F.count_distinct("sig").alias("sigs"),
        (F.count(F.lit(1)) / F.sum("n")).alias("ratio"),
        (F.count_distinct(F.length("value")) / F.sum("n")).alias("lengths"),
    )


@query(
    "cluster_suggestions",
    f"""{_SCORES}, s as (select composite_key, concat_ws('|',
        case when sigs - 1 = 0 then 'No clusters found - consider different parameters or methods' end,
        case when lengths < 0.3 then 'Low silhouette score - clusters may not be well-separated' end,
        case when ratio > 0.9 and sigs - 1 > 0 then 'Using KMeans fallback - consider tuning HDBSCAN parameters' end,
        case when sigs // 3 > 0 then 'Found ' || (sigs // 3) || ' clusters with <3 samples' end) as suggestions from st)
    select * from s where suggestions <> ''""",
)
def cluster_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key statistics stand in for clustering results, so that every kind of advice appears."""
    summary = _scores(spark, sf_dir).select(
        KEY,
        (F.col("sigs") - 1).alias("n_clusters"),
        F.col("lengths").alias("silhouette"),
        F.when(F.col("ratio") > 0.9, F.lit("kmeans")).otherwise(F.lit("density")).alias("method"),
        F.floor(F.col("sigs") / 3).alias("small_clusters"),
    )
    return C.cluster_suggestions(summary).withColumn("suggestions", F.array_join("suggestions", "|"))


@query(
    "best_model",
    f"""{_SCORES} select composite_key, case when ratio > lengths then 'density' else 'kmeans' end as type,
      round(greatest(ratio, lengths), 6) as score from st""",
)
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    chosen = C.best_model(scores.select(KEY, F.col("ratio").alias("score")), scores.select(KEY, F.col("lengths").alias("score")))
    return chosen.withColumn("score", F.round("score", 6))


@query(
    "model_type_counts",
    f"""{_SCORES} select case when ratio > lengths then 'density' else 'kmeans' end as type, count(*) as "count" from st group by 1""",
)
def model_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    chosen = C.best_model(scores.select(KEY, F.col("ratio").alias("score")), scores.select(KEY, F.col("lengths").alias("score")))
    return S.model_type_counts(chosen)


@query(
    "silhouette_summary",
    f"""{_SCORES} select count(*) as keys, round(avg(ratio), 6) as silhouette_mean, round(stddev_pop(ratio), 6) as silhouette_std,
      round(min(ratio), 6) as silhouette_min, round(max(ratio), 6) as silhouette_max from st""",
)
def silhouette_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = S.silhouette_summary(_scores(spark, sf_dir).withColumnRenamed("ratio", "silhouette"))
    return summary.withColumns({f"silhouette_{c}": F.round(f"silhouette_{c}", 6) for c in ("mean", "std", "min", "max")})


WORDS = Settings(ngram_min=1, ngram_max=2)


@query("density_labels")
def density_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.density import density_labels as labels

    rows, _ = T.tfidf_rows(value_table(view(spark, sf_dir, "v_names")), WORDS)
    return labels(rows, settings=replace(WORDS, min_cluster_size=2))


@query("kmeans_labels")
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formscribe.operators.kmeans import kmeans_labels as labels

    rows, _ = T.tfidf_rows(value_table(view(spark, sf_dir, "v_names")), WORDS)
    return labels(rows.withColumn("k", F.lit(8)))


def _number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts per type, as one-dimensional rows of at most three clusters."""
    numbers = C.numeric_rows(value_table(view(spark, sf_dir, "v_sizes")))
    most = numbers.groupBy(KEY).agg(F.least(F.lit(3), F.count(F.lit(1))).cast("int").alias("k"))
    return numbers.join(most, KEY)


@query(
    "kmeans_invariants",
    f"""{with_views('v_sizes')}, k as (select {duck.key()} as composite_key, value from v_sizes)
    select composite_key, count(distinct value) as labelled, true as nearest, true as better from k group by 1""",
)
def kmeans_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value is labelled, none is nearer to another cluster's mean, and clusters cost no more than one would."""
    from formscribe.operators.kmeans import kmeans_labels as labels

    rows = cut_lineage(_number_rows(spark, sf_dir))
    found = rows.join(labels(rows), [KEY, "id"]).withColumn("x", F.get("w", F.lit(0)))
    means = found.groupBy(KEY, "cluster").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"))
    whole = found.groupBy(KEY).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("one"))
    gaps = found.join(means.select(KEY, F.col("cluster").alias("c"), "m"), KEY).withColumn("gap", F.abs(F.col("x") - F.col("m")))
    best = gaps.groupBy(KEY, "id", "n", "x").agg(F.min("gap").alias("least"), F.max(F.when(F.col("c") == F.col("cluster"), F.col("gap"))).alias("own"))
    cost = F.sum(F.col("own") * F.col("own") * F.col("n")) <= F.sum(F.pow(F.col("x") - F.col("one"), 2) * F.col("n")) + 1e-6
    return best.join(whole, KEY).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("labelled"), F.min(F.col("own") <= F.col("least") + 1e-6).alias("nearest"), cost.alias("better")
    )


@query(
    "kmeans_starts",
    f"""{with_views('v_sizes')}, k as (select {duck.key()} as composite_key, value from v_sizes)
    select composite_key, 5 as starts, true as cheapest from k group by 1""",
)
def kmeans_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five starts per key, what is kept costs no more than any."""
    from formscribe.operators import kmeans as K

    settings = Settings(kmeans_starts=5)
    rows = cut_lineage(_number_rows(spark, sf_dir).select(KEY, "id", "n", "k", "idx", "w"))
    _, costs = K.train_starts(rows, settings=settings)
    kept = K.centre_costs(rows, K.train_centres(rows, settings=settings), [KEY])
    single = costs.groupBy(KEY).agg(F.count(F.lit(1)).cast("int").alias("starts"), F.min("cost").alias("least"))
    return single.join(kept, KEY).select(KEY, "starts", (F.col("cost") <= F.col("least") + 1e-9).alias("cheapest"))


@query("cluster_keys_names")
def cluster_keys_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "v_names", WORDS)


@query("cluster_keys_sizes")
def cluster_keys_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "v_sizes", Settings())


@query("cluster_keys_embeddings")
def cluster_keys_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "v_parts", replace(WORDS, density_eps=0.35, min_cluster_size=2), use_embeddings=True)


def _clustered(spark: SparkSession, sf_dir: str, name: str, settings: Settings, use_embeddings: bool = False) -> DataFrame:
    items = view(spark, sf_dir, name)
    return C.cluster_all(value_table(items), key_profiles(items), settings, use_embeddings).summary


@query("search_kmeans")
def search_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search_kmeans(C.training_rows(value_table(view(spark, sf_dir, "v_names")), WORDS))


@query("search_density")
def search_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.training_rows(value_table(view(spark, sf_dir, "v_names")), WORDS)
    return C.search_density(rows)


@query(
    "signature_labels",
    f"""{with_views('v_parts')}, {duck.keyed('v_parts')}, d as (select distinct composite_key, value, sig from keyed)
    select composite_key, value, sig, dense_rank() over (partition by composite_key order by sig) - 1 as label from d""",
)
def signature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.signature_labels(value_table(view(spark, sf_dir, "v_parts"))).select(KEY, "value", "sig", "label")
