"""Sub-format clustering of every key's values."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators.density import density_labels
from formscribe.operators.hierarchy import hierarchy_labels
from formscribe.operators.kmeans import kmeans_labels
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import most_common, top_per_group
from formscribe.operators.silhouette import silhouette_of
from formscribe.operators.terms import term_weights, tfidf_rows, term_counts, vocabulary
from formscribe.operators.vectors import embed_column, value_id
from formscribe.session import cut_lineage


@dataclass(frozen=True)
class Clustering:
    """labels: composite_key, id, value, n, first_pos, sig, cluster (-1 noise), idx, w.
    summary: composite_key, method, n_clusters, silhouette."""

    labels: DataFrame
    summary: DataFrame


def cluster_routes(values: DataFrame, profiles: DataFrame, use_embeddings: bool = False) -> DataFrame:
    """Method per key from its size and profile flags."""
    sizes = values.groupBy(KEY).agg(F.sum("n").alias("total"))
    joined = sizes.join(profiles.select(KEY, "is_numeric_unit", "is_free_text"), KEY)
    by_vector = F.col("is_free_text") & F.lit(use_embeddings)
    method = (
        F.when(F.col("total") < 5, F.lit("insufficient_data"))
        .when(F.col("is_numeric_unit"), F.lit("numeric_unit"))
        .when(by_vector, F.lit("embeddings"))
        .otherwise(F.lit("tfidf"))
    )
    return joined.select(KEY, "total", method.alias("method"))


def numeric_rows(values: DataFrame) -> DataFrame:
    """Values that parse as number and unit, as one-dimensional rows with columns number and unit."""
    parsed = values.withColumn("_p", text.number_and_unit(F.col("value"))).where(F.col("_p.number").isNotNull())
    return parsed.select(
        *[c for c in values.columns],
        value_id(F.col("value")).alias("id"),
        F.col("_p.number").alias("number"),
        F.col("_p.unit").alias("unit"),
        F.array(F.lit(0)).alias("idx"),
        F.array(F.col("_p.number")).alias("w"),
    )


def embedding_rows(values: DataFrame, encoder=None) -> DataFrame:
    """Distinct values with their vectors as (idx, w) entries."""
    texts = values.select("value").distinct().withColumn("vec", embed_column(F.col("value"), encoder))
    entries = F.filter(
        F.transform("vec", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda e: e["x"] != 0
    )
    joined = values.join(texts.where(F.col("vec").isNotNull()), "value").withColumn("_e", entries)
    return joined.select(
        *values.columns, value_id(F.col("value")).alias("id"), F.col("_e.i").alias("idx"), F.col("_e.x").alias("w")
    )


def _numeric_k(rows: DataFrame, settings: Settings) -> DataFrame:
    sizes = rows.groupBy(KEY).agg(F.sum("n").alias("parsed"), F.count(F.lit(1)).alias("_d"))
    k = F.least(F.lit(settings.numeric_k), F.floor(F.col("parsed") / 2), F.col("_d")).cast("int")
    return sizes.select(KEY, "parsed", k.alias("k"))


def density_or_kmeans(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, id, cluster, method): density labels, or k-means for keys where density finds one label only."""
    if settings.density_method == "hierarchy":
        found = hierarchy_labels(rows, [KEY], settings.density_metric, settings).drop("strength")
    elif settings.density_method == "cut":
        found = density_labels(rows, [KEY], settings)
    else:
        raise ValueError("density_method must be cut or hierarchy")
    dense = cut_lineage(found)
    verdict = dense.groupBy(KEY).agg((F.count_distinct("cluster") <= 1).alias("flat"), F.count(F.lit(1)).alias("_d"))
    flat = verdict.where("flat").select(KEY, F.least(F.lit(settings.kmeans_k), F.col("_d")).cast("int").alias("k"))
    regrouped = kmeans_labels(rows.join(flat, KEY), [KEY], "k", settings)
    several = dense.join(verdict.where(~F.col("flat")).select(KEY), KEY, "left_semi")
    return several.withColumn("method", F.lit("density")).unionByName(regrouped.withColumn("method", F.lit("kmeans")))


def cluster_all(
    values: DataFrame, profiles: DataFrame, settings: Settings = Settings(), use_embeddings: bool = False, encoder=None
) -> Clustering:
    """Cluster the distinct values of every key; `values` comes from `profile.value_table`.

    All keys go through the same few plans at once. Stage tables are stored, as several steps read them.
    """
    values = cut_lineage(values)
    routes = cut_lineage(cluster_routes(values, profiles, use_embeddings))

    def routed(method: str) -> DataFrame:
        return values.join(routes.where(F.col("method") == method).select(KEY), KEY, "left_semi")

    numbers = numeric_rows(routed("numeric_unit"))
    sizes = _numeric_k(numbers, settings)
    numbers = numbers.join(sizes.where(F.col("parsed") >= 5), KEY)
    numeric = numbers.join(kmeans_labels(numbers, [KEY], "k", settings), [KEY, "id"]).withColumn("method", F.lit("numeric_unit"))

    rows, _ = tfidf_rows(routed("tfidf"), settings)
    with_terms = rows.groupBy(KEY).agg(F.max(F.size("idx")).alias("_m")).where(F.col("_m") > 0).select(KEY)
    rows = rows.join(with_terms, KEY, "left_semi")
    if use_embeddings:
        rows = rows.unionByName(embedding_rows(routed("embeddings"), encoder).select(*rows.columns))
    rows = cut_lineage(rows)
    by_text = rows.join(density_or_kmeans(rows, settings), [KEY, "id"])
    columns = [*values.columns, "id", "idx", "w", "cluster", "method"]
    labels = cut_lineage(numeric.select(*columns).unionByName(by_text.select(*columns)))

    found = labels.groupBy(KEY).agg(F.first("method").alias("_found"), F.count_distinct("cluster").alias("_c"))
    scores = silhouette_of(labels.where(F.col("method") != "numeric_unit"), [KEY], settings)
    failed = F.when(F.col("method") == "numeric_unit", F.lit("insufficient_numeric_data")).otherwise(F.lit("error"))
    method = F.when(F.col("method") == "insufficient_data", F.col("method")).otherwise(F.coalesce("_found", failed))
    summary = routes.join(found, KEY, "left").join(scores, KEY, "left")
    return Clustering(
        labels,
        summary.select(
            KEY,
            method.alias("method"),
            F.coalesce("_c", F.lit(0)).alias("n_clusters"),
            F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"),
        ),
    )


def _examples(labels: DataFrame, group: Sequence[str]) -> DataFrame:
    position = [F.col("first_pos").asc_nulls_last()] if "first_pos" in labels.columns else []
    first = top_per_group(
        labels.select(*group, "value", *(["first_pos"] if position else [])), group, [*position, F.col("value")], 3
    )
    listed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return first.groupBy(*group).agg(F.transform(listed, lambda e: e["value"]).alias("example_values"))


def top_terms(labels: DataFrame, weights: DataFrame, k: int = 5) -> DataFrame:
    """The terms with the highest mean weight per cluster; weights: key, id, term, w."""
    group = [KEY, "cluster"]
    sizes = labels.groupBy(*group).agg(F.sum("n").alias("_size"))
    members = weights.select(KEY, "id", "term", "w").join(labels.select(KEY, "id", "cluster", "n"), [KEY, "id"])
    sums = members.groupBy(*group, "term").agg(F.sum(F.col("w") * F.col("n")).alias("_sum"))
    scored = sums.join(sizes, group).select(*group, "term", (F.col("_sum") / F.col("_size")).alias("score"))
    ranked = top_per_group(scored.where(F.col("score") > 0), group, [F.col("score").desc(), F.col("term")], k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy(*group).agg(F.transform(listed, lambda e: e["term"]).alias("top_terms"))


def describe_clusters(labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Size, leading signature and pattern, examples, top terms and coverage of every cluster but noise."""
    group = [KEY, "cluster"]
    totals = labels.groupBy(KEY).agg(F.sum("n").alias("_total"))
    real = labels.where(F.col("cluster") >= 0)
    described = (
        real.groupBy(*group)
        .agg(F.sum("n").alias("size"))
        .join(most_common(real, group, "sig", F.col("n"), "pattern_signature"), group)
        .join(_examples(real, group), group)
        .join(totals, KEY)
    )
    if weights is not None:
        described = described.join(top_terms(real, weights), group, "left")
    else:
        described = described.withColumn("top_terms", F.lit(None).cast("array<string>"))
    return described.select(
        *group,
        "size",
        "pattern_signature",
        text.signature_regex(F.col("pattern_signature")).alias("cluster_regex"),
        "example_values",
        F.coalesce("top_terms", F.array().cast("array<string>")).alias("top_terms"),
        (F.col("size") * 100.0 / F.col("_total")).alias("coverage_pct"),
    )


def describe_numeric_clusters(labels: DataFrame) -> DataFrame:
    """Number range, leading unit, examples and coverage; labels carry number and unit."""
    group = [KEY, "cluster"]
    n, x = F.sum("n"), F.col("number")
    mean = F.sum(x * F.col("n")) / n
    variance = F.greatest(F.sum(x * x * F.col("n")) / n - mean * mean, F.lit(0.0))
    totals = labels.groupBy(KEY).agg(F.sum("n").alias("_total"))
    stats = labels.groupBy(*group).agg(
        n.alias("size"), F.min("number").alias("min"), F.max("number").alias("max"), mean.alias("mean"), F.sqrt(variance).alias("std")
    )
    return (
        stats.join(most_common(labels, group, "unit", F.col("n"), "most_common_unit"), group, "left")
        .join(_examples(labels, group), group)
        .join(totals, KEY)
        .withColumn("coverage_pct", F.col("size") * 100.0 / F.col("_total"))
        .drop("_total")
    )


def cluster_suggestions(summary: DataFrame) -> DataFrame:
    """Advice per key from n_clusters, silhouette, method and small_clusters (clusters of fewer than three)."""
    # The advice texts and the limits at which they are given.
    advice = F.array_compact(
        F.array(
            F.when(F.col("n_clusters") == 0, F.lit("No clusters found - consider different parameters or methods")),
            F.when(F.col("silhouette") < 0.3, F.lit("Low silhouette score - clusters may not be well-separated")),
            F.when(
                (F.col("method") == "kmeans") & (F.col("n_clusters") > 0),
                F.lit("Using KMeans fallback - consider tuning HDBSCAN parameters"),
            ),
            F.when(
                F.col("small_clusters") > 0,
                F.concat(F.lit("Found "), F.col("small_clusters").cast("string"), F.lit(" clusters with <3 samples")),
            ),
        )
    )
    return summary.select(KEY, advice.alias("suggestions")).where(F.size("suggestions") > 0)


def best_model(density_scores: DataFrame, kmeans_scores: DataFrame) -> DataFrame:
    """Better of the two scores per key; a tie goes to k-means, a missing score counts as -1."""
    joined = density_scores.select(KEY, F.col("score").alias("d")).join(
        kmeans_scores.select(KEY, F.col("score").alias("k")), KEY, "full"
    )
    d, k = F.coalesce("d", F.lit(-1.0)), F.coalesce("k", F.lit(-1.0))
    return joined.select(
        KEY, F.when(d > k, F.lit("density")).otherwise(F.lit("kmeans")).alias("type"), F.greatest(d, k).alias("score")
    )


def search_kmeans(rows: DataFrame, settings: Settings = Settings(), most: int = 20) -> DataFrame:
    """Best k per key by silhouette over 2 .. min(20, n // 2) - 1; all (key, k) cells run at once."""
    sizes = rows.groupBy(KEY).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    last = F.least(F.lit(most), F.floor(F.col("_n") / 2)).cast("int") - 1
    grid = sizes.where(last >= 2).select(KEY, "_d", F.explode(F.sequence(F.lit(2), last)).alias("k"))
    cells = cut_lineage(rows.select(KEY, "id", "n", "idx", "w").join(grid.where(F.col("k") <= F.col("_d")), KEY))
    group = [KEY, "k"]
    labelled = cells.join(kmeans_labels(cells, group, "k", settings), [*group, "id"])
    scores = silhouette_of(labelled, group, settings)
    best = F.max_by(F.struct("k", "silhouette"), F.struct("silhouette", (-F.col("k")).alias("_o")))
    return scores.groupBy(KEY).agg(best.alias("_b")).select(KEY, F.col("_b.k").alias("k"), F.col("_b.silhouette").alias("score"))


#: Grid of the density search: reach, neighbours for a core row, smallest cluster.
DENSITY_GRID = tuple(
    (eps, samples, size) for eps in (0.2, 0.35, 0.5, 0.65) for samples in (1, 2, 3, 5) for size in (3, 5, 10, 15)
)


def search_density(
    rows: DataFrame, settings: Settings = Settings(), grid: Sequence[tuple[float, int, int]] = DENSITY_GRID
) -> DataFrame:
    """Best (eps, min_samples, min_cluster_size) per key by silhouette; all cells of the grid run at once."""
    options = F.array(
        *[
            F.struct(F.lit(i).alias("cell"), F.lit(e).alias("eps"), F.lit(s).alias("min_samples"), F.lit(c).alias("min_cluster_size"))
            for i, (e, s, c) in enumerate(grid)
        ]
    )
    cells = rows.select(KEY, "id", "n", "idx", "w", F.explode(options).alias("_g")).select(KEY, "id", "n", "idx", "w", "_g.*")
    cells = cut_lineage(cells)
    group = [KEY, "cell"]
    labelled = cells.join(density_labels(cells, group, settings), [*group, "id"])
    several = labelled.groupBy(*group).agg(F.count_distinct("cluster").alias("_c")).where(F.col("_c") > 1)
    scores = silhouette_of(labelled.join(several.select(*group), group, "left_semi"), group, settings)
    best = F.max_by(F.struct("cell", "silhouette"), F.struct("silhouette", (-F.col("cell")).alias("_o")))
    chosen = scores.groupBy(KEY).agg(best.alias("_b"))
    option = F.get(options, F.col("_b.cell"))
    return chosen.select(
        KEY, option["eps"].alias("eps"), option["min_samples"].alias("min_samples"),
        option["min_cluster_size"].alias("min_cluster_size"), F.col("_b.silhouette").alias("score"),
    )


def training_rows(values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Term rows of the keys with at least ten values, with the smaller feature limit of training."""
    enough = values.groupBy(KEY).agg(F.sum("n").alias("_n")).where(F.col("_n") >= 10).select(KEY)
    rows, _ = tfidf_rows(values.join(enough, KEY, "left_semi"), replace(settings, max_features=1000))
    return rows


def weights_table(values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    counts = term_counts(values, settings)
    return term_weights(counts, vocabulary(values, counts, settings))


def small_cluster_count(described: DataFrame) -> DataFrame:
    return described.groupBy(KEY).agg(F.count_if(F.col("size") < 3).alias("small_clusters"))


