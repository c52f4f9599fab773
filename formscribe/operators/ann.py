"""Approximate search: coarse cells and product-quantised codes, both as plain tables.

A cell index is the vector table with a `cell` column plus a small table of centres; searching is an equi join
on (key, cell). Keys with fewer vectors than cells keep one cell, so they are searched whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.kmeans import assign_centres, train_centres
from formscribe.operators.neighbours import search
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import top_per_group
from formscribe.operators.vectors import paired_cosine, unit, with_vectors


def _entries(vector: Column) -> list[Column]:
    """A dense vector as the arrays idx, w of the k-means rows."""
    return [
        F.sequence(F.lit(0), F.size(vector) - 1).alias("idx"),
        F.transform(vector, lambda x: x.cast("double")).alias("w"),
    ]


def _unit_rows(vectors: DataFrame) -> DataFrame:
    units = with_vectors(vectors).select(KEY, "id", F.lit(1).cast("long").alias("n"), unit(F.col("vec")).alias("_u"))
    return units.select(KEY, "id", "n", *_entries(F.col("_u")))


def train_cells(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Centres (key, cell, vec): nlist per key that has that many vectors, else one.

    All vectors take part in the training.
    """
    sizes = vectors.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    k = F.when(F.col("_n") >= settings.nlist, F.lit(settings.nlist)).otherwise(F.lit(1))
    rows = _unit_rows(vectors).join(sizes.select(KEY, k.alias("k")), KEY)
    centres = train_centres(rows, [KEY], "k", whole=True, settings=settings)
    return centres.select(KEY, F.col("cluster").alias("cell"), F.col("w").alias("vec"))


def assign_cells(vectors: DataFrame, centres: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Vectors with their cell; also how new vectors join an existing index."""
    spread = centres.select(KEY, F.col("cell").alias("cluster"), *_entries(F.col("vec")))
    cells = assign_centres(_unit_rows(vectors), spread, [KEY], settings)
    return vectors.join(cells.withColumnRenamed("cluster", "cell"), [KEY, "id"])


def probes(queries: DataFrame, centres: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each query once per cell it visits: the nprobe nearest centres."""
    targets = centres.select(KEY, F.col("cell").cast("string").alias("id"), F.transform("vec", lambda x: x.cast("float")).alias("vec"))
    asked = queries.select(KEY, "id", F.transform(unit(F.col("vec")), lambda x: x.cast("float")).alias("vec"))
    near = search(asked, targets, settings.nprobe, "l2", settings=settings)
    visits = near.select(KEY, F.col("query_id").alias("id"), F.col("similarity").alias("closeness"), F.col("id").cast("int").alias("cell"))
    return queries.join(visits.drop("closeness"), [KEY, "id"])


def search_cells(
    queries: DataFrame,
    index: DataFrame,
    centres: DataFrame,
    k: int = Settings.top_k,
    threshold: float | None = None,
    skip_same_id: bool = False,
    settings: Settings = Settings(),
) -> DataFrame:
    """The k most similar vectors (cosine) among the visited cells."""
    visiting = probes(queries, centres, settings)
    found = search(visiting, index, k, "cosine", threshold, skip_same_id, settings, group=(KEY, "cell"))
    merged = found.select(KEY, "query_id", "id", "similarity")
    return top_per_group(merged, [KEY, "query_id"], [F.col("similarity").desc(), F.col("id")], k)


def _parts(vectors: DataFrame, m: int) -> DataFrame:
    """One row per vector and sub-vector; the dimension must be a multiple of m."""
    width = (F.size("_u") / m).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)),
        lambda j: F.struct(j.cast("int").alias("part"), F.slice("_u", j.cast("int") * width + 1, width).alias("v")),
    )
    units = with_vectors(vectors).select(KEY, "id", unit(F.col("vec")).alias("_u"))
    rows = units.select(KEY, "id", F.explode(pieces).alias("_p")).select(KEY, "id", "_p.part", "_p.v")
    return rows.select(KEY, "part", "id", F.lit(1).cast("long").alias("n"), *_entries(F.col("v")))


def train_codebook(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, part, code, v): up to 2^bits centres for each of the m sub-vectors."""
    rows = _parts(vectors, settings.pq_m).withColumn("k", F.lit(2**settings.pq_bits))
    centres = train_centres(rows, [KEY, "part"], "k", whole=True, settings=settings)
    return centres.select(KEY, "part", F.col("cluster").alias("code"), F.col("w").alias("v"))


def encode_vectors(vectors: DataFrame, codebook: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, id, codes array<int>): one code per sub-vector."""
    spread = codebook.select(KEY, "part", F.col("code").alias("cluster"), *_entries(F.col("v")))
    coded = assign_centres(_parts(vectors, settings.pq_m), spread, [KEY, "part"], settings)
    # m entries per vector
    ordered = F.array_sort(F.collect_list(F.struct("part", "cluster")))
    return coded.groupBy(KEY, "id").agg(F.transform(ordered, lambda c: c["cluster"]).alias("codes"))


def decode_vectors(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """Vectors put together from their codes. The distance to such a vector is the sum of the table look-ups
    of the sub-vectors."""
    rows = codes.select(KEY, "id", F.posexplode("codes").alias("part", "code"))
    pieces = rows.join(codebook, [KEY, "part", "code"]).groupBy(KEY, "id").agg(
        F.array_sort(F.collect_list(F.struct("part", "v"))).alias("_p")
    )
    joined = F.flatten(F.transform("_p", lambda p: p["v"]))
    return pieces.select(KEY, "id", F.transform(joined, lambda x: x.cast("float")).alias("vec"))


def search_codes(
    queries: DataFrame,
    index: DataFrame,
    centres: DataFrame,
    codes: DataFrame,
    codebook: DataFrame,
    k: int = Settings.top_k,
    rerank: int = 50,
    skip_same_id: bool = False,
    settings: Settings = Settings(),
) -> DataFrame:
    """Candidates from codes within the visited cells, the best `rerank` of them scored exactly."""
    coarse = decode_vectors(codes, codebook).join(index.select(KEY, "id", "cell"), [KEY, "id"])
    near = search_cells(queries, coarse, centres, rerank, None, skip_same_id, settings)
    exact = (
        near.select(KEY, "query_id", "id")
        .join(index.select(KEY, "id", "vec"), [KEY, "id"])
        .join(queries.select(KEY, F.col("id").alias("query_id"), F.col("vec").alias("q")), [KEY, "query_id"])
    )
    scored = exact.select(KEY, "query_id", "id", paired_cosine(F.col("q"), F.col("vec")).alias("similarity"))
    return top_per_group(scored, [KEY, "query_id"], [F.col("similarity").desc(), F.col("id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that an approximate search found."""
    wanted = exact.select(KEY, "query_id", "id", F.lit(1).alias("w"))
    hit = wanted.join(found.select(KEY, "query_id", "id", F.lit(1).alias("f")), [KEY, "query_id", "id"], "left")
    return hit.agg((F.count("f") / F.count("w")).alias("recall"), F.count("w").alias("wanted"))
