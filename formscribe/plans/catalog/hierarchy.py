"""The density hierarchy and its search."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators import cluster as C
from formscribe.operators import hierarchy as H
from formscribe.operators import terms as T
from formscribe.operators.profile import KEY, value_table
from formscribe.operators.silhouette import silhouette
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.clusters import WORDS
from formscribe.plans.views import view, with_views
from formscribe.session import cut_lineage, scratch_path

_SIZES = f"""{with_views('v_sizes')}, k as (select {duck.key()} as composite_key, value from v_sizes),
    d as (select composite_key, value, any_value(cast(regexp_extract(value, '^([0-9]+)', 1) as double)) as x, count(*) as n from k group by 1, 2)"""


@query(
    "spanning_tree",
    f"""{_SIZES}, g as (select composite_key, value, x, n, x - lag(x) over w as below, lead(x) over w - x as above from d window w as (partition by composite_key order by x, value)),
    c as (select composite_key, value, x, above, case when n >= 2 then 0 else coalesce(least(below, above), below, above, 0) end as core from g),
    e as (select composite_key, case when above is not null then greatest(above, core, lead(core) over (partition by composite_key order by x, value)) end as length from c)
    select composite_key, count(*) as edges, round(sum(length), 6) as total, round(max(length), 6) as longest from e where length is not null group by 1""",
)
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes lie on a line, where the spanning tree joins neighbours; many blocks."""
    rows = C.numeric_rows(value_table(view(spark, sf_dir, "v_sizes"))).withColumn("min_samples", F.lit(2))
    trees = H.spanning_trees(rows, [KEY], settings=Settings(block_rows=16))
    return trees.where("b is not null").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.sum("d"), 6).alias("total"), F.round(F.max("d"), 6).alias("longest")
    )


@query(
    "density_hierarchy",
    f"""{with_views('v_names')}, k as (select {duck.key()} as composite_key, value from v_names where value is not null)
    select composite_key, count(distinct value) as labelled, true as large_enough, true as strongest from k group by 1""",
)
def density_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value has a label, no cluster is smaller than asked for, and each has a row of full strength."""
    rows, _ = T.tfidf_rows(value_table(view(spark, sf_dir, "v_names")), WORDS)
    settings = replace(WORDS, min_cluster_size=3)
    rows = cut_lineage(rows)
    found = rows.select(KEY, "id", "n").join(H.hierarchy_labels(rows, metric="cosine", settings=settings), [KEY, "id"])
    each = found.groupBy(KEY, "cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.max("strength").alias("most"))
    noise = F.col("cluster") < 0
    return each.groupBy(KEY).agg(
        F.sum("rows").alias("labelled"),
        F.bool_and(noise | (F.col("n") >= settings.min_cluster_size)).alias("large_enough"),
        F.bool_and(F.when(noise, F.col("most") == 0).otherwise(F.abs(F.col("most") - 1) < 1e-9)).alias("strongest"),
    )


@query(
    "search_hierarchy",
    f"""{with_views('v_names')}, k as (select {duck.key()} as composite_key, value from v_names where value is not null),
    s as (select composite_key from k group by 1 having count(*) >= 10)
    select composite_key, metric, true as agrees from s, (values ('cosine'), ('euclidean'), ('manhattan')) m(metric)""",
)
def search_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key and metric: the best cell's score is the silhouette of the labels that its parameters give, or no cell has
    more than one label and neither have they."""
    rows = cut_lineage(C.training_rows(value_table(view(spark, sf_dir, "v_names")), WORDS))
    out = []
    for metric in ("cosine", "euclidean", "manhattan"):
        grid = [g for g in H.SEARCH_GRID if g[2] == metric]
        best = cut_lineage(H.search_hierarchy(rows, grid=grid))
        chosen = rows.select(KEY, "id", "n", "idx", "w").join(best.select(KEY, "min_cluster_size", "min_samples"), KEY)
        labelled = cut_lineage(chosen.join(H.hierarchy_labels(chosen, metric=metric), [KEY, "id"]))
        again = best.join(silhouette(labelled.withColumn("cluster", F.col("cluster") + 1)), KEY).select(KEY, (F.abs(F.col("score") - F.col("silhouette")) < 1e-9).alias("same"))
        plain = {c: F.lit(v) for c, v in (("min_cluster_size", grid[0][0]), ("min_samples", grid[0][1]))}
        flat = H.hierarchy_labels(rows.join(best, KEY, "left_anti").withColumns(plain), metric=metric)
        one = flat.groupBy(KEY).agg((F.count_distinct("cluster") == 1).alias("same"))
        out.append(again.unionByName(one).select(KEY, F.lit(metric).alias("metric"), F.col("same").alias("agrees")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("evaluate_models", "select true as kept, true as nearest, true as in_range")
def evaluate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of two thirds of the values, stored, loaded and scored on the others: loading changes no label, no value is
    nearer to another cluster's mean, and scores are what they can be."""
    from formscribe.operators import models as L
    from formscribe.operators.mining import hash_share

    values = value_table(view(spark, sf_dir, "v_names")).withColumn("part", hash_share(F.col("value"), buckets=3))
    learnt_on, others = values.where("part < 2").drop("part"), cut_lineage(values.where("part = 2").drop("part"))
    fitted = L.fit_models(learnt_on, WORDS, grid=tuple(g for g in H.SEARCH_GRID if g[0] in (3, 10) and g[1] in (1, 3)), most=6)
    path = scratch_path(spark, "models")
    fitted.save(path)
    loaded = L.load_models(spark, path)
    first, again = (L.predict(m, others, WORDS).select(KEY, "id", F.col("cluster").alias(c)) for m, c in ((fitted, "a"), (loaded, "b")))
    kept = first.join(again, [KEY, "id"], "full").agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("kept"))
    placed = L.predict(loaded, others, WORDS).select(KEY, "id", "cluster", "gap", F.col("idx").alias("i"), F.col("w").alias("v"))
    means = loaded.centres.select(KEY, F.map_from_arrays("idx", "w").alias("m"), "w")
    square = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x) + F.aggregate(F.transform("w", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    dot = F.aggregate(F.zip_with("i", "v", lambda i, x: x * F.coalesce(F.try_element_at("m", i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    gaps = placed.join(means, KEY).groupBy(KEY, "id", "gap").agg(F.min(square - 2 * dot).alias("least"))
    nearest = gaps.agg(F.coalesce(F.bool_and(F.col("gap") * F.col("gap") <= F.col("least") + 1e-6), F.lit(True)).alias("nearest"))
    scored = L.evaluate(loaded, others, WORDS)
    fine = F.col("silhouette_score").between(-1, 1) & (F.col("adjusted_rand_index") <= 1) & (F.col("n_clusters_predicted") > 1)
    ranges = scored.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("in_range"))
    # one row each
    return kept.crossJoin(nearest).crossJoin(ranges)
