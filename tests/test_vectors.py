"""Neighbour search, pairs, clustering and mining against brute force."""
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators import ann, cluster, density, mining, neighbours, vectors
from formscribe.operators.kmeans import kmeans_labels
from formscribe.operators.profile import KEY
from formscribe.operators.silhouette import silhouette, silhouette_of

TINY = Settings(block_rows=7)


def cloud(n=60, d=6, seed=1, keys=2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, d)) * 2
    return [(f"k{i % keys}", f"{i:03d}", (middles[i % 4] + rng.normal(size=d)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def points(spark):
    rows = cloud()
    return rows, spark.createDataFrame(rows, f"{KEY} string, id string, vec array<float>")


def cos(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def f32(v):
    return np.asarray(v, dtype=np.float32).astype(float)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_similar_pairs(points, threshold):
    rows, df = points
    want = {
        (a[1], b[1])
        for i, a in enumerate(rows)
        for b in rows[i + 1 :]
        if a[0] == b[0] and cos(f32(a[2]), f32(b[2])) >= threshold
    }
    found = neighbours.similar_pairs(df, threshold, TINY).collect()
    assert len(found) == len(want)
    assert {(r.id1, r.id2) for r in found} == want


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_search(points, metric):
    rows, df = points

    def score(a, b):
        return cos(a, b) if metric == "cosine" else 1 / (1 + ((a - b) ** 2).sum())

    found = neighbours.search(df, df, 3, metric, skip_same_id=True, settings=TINY).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.similarity)
    assert len(got) == len(rows)
    for key, name, vec in rows:
        others = sorted(((-score(f32(vec), f32(v)), i) for k, i, v in rows if k == key and i != name))[:3]
        assert [got[name][r][0] for r in (1, 2, 3)] == [i for _, i in others]
        assert got[name][1][1] == pytest.approx(-others[0][0], abs=1e-6)


def test_search_rejects_other_metrics(points):
    with pytest.raises(ValueError):
        neighbours.search(points[1], points[1], metric="manhattan")


def test_search_of_an_unknown_key_is_empty(points):
    rows, df = points
    assert neighbours.search(df.withColumn(KEY, F.lit("none")), df).count() == 0


def test_fewer_vectors_than_k(points):
    _, df = points
    few = df.where(F.col("id") < "003")
    assert neighbours.search(few, few, 10).groupBy(KEY, "query_id").count().agg(F.max("count")).first()[0] == 2


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "vec array<float>")
    got = [r.u for r in df.select(vectors.unit(F.col("vec")).alias("u")).collect()]
    assert got == [[0.0, 0.0], [0.6, 0.8]]


def test_cells_cover_every_vector_and_full_probing_is_exact(points):
    rows, df = points
    settings = Settings(nlist=4, nprobe=4, block_rows=7)
    centres = ann.train_cells(df, settings)
    index = ann.assign_cells(df, centres, settings)
    assert index.count() == len(rows)
    found = ann.search_cells(df, index, centres, 3, skip_same_id=True, settings=settings)
    exact = neighbours.search(df, df, 3, skip_same_id=True)
    assert ann.recall(found, exact).first().recall == 1.0


def test_codes_find_most_neighbours(points):
    _, df = points
    settings = Settings(nlist=2, nprobe=2, pq_m=3, pq_bits=4)
    centres = ann.train_cells(df, settings)
    index = ann.assign_cells(df, centres, settings)
    book = ann.train_codebook(df, settings)
    codes = ann.encode_vectors(df, book, settings)
    assert codes.where(F.size("codes") != 3).count() == 0
    found = ann.search_codes(df, index, centres, codes, book, 3, rerank=10, skip_same_id=True, settings=settings)
    exact = neighbours.search(df, df, 3, skip_same_id=True)
    assert ann.recall(found, exact).first().recall > 0.8


def test_encoder(spark):
    df = spark.createDataFrame([("k", "Hello World"), ("k", "hello world"), ("j", "Hello World"), ("k", ""), ("k", "zzz")], f"{KEY} string, value string")
    got = {(r[KEY], r.value): np.array(r.vec) for r in vectors.embed_values(df).collect()}
    assert len(got) == 5
    assert np.allclose(got[("k", "Hello World")], got[("k", "hello world")])
    assert np.allclose(got[("k", "Hello World")], got[("j", "Hello World")])
    assert not got[("k", "")].any()
    assert np.linalg.norm(got[("k", "zzz")]) == pytest.approx(1.0, abs=1e-5)
    direct = vectors.char_ngram_encoder()()(["zzz", "Hello World"])
    assert np.allclose(direct[1], got[("k", "Hello World")], atol=1e-6)


def test_failing_encoder(spark):
    """It fails the job, or leaves NULL vectors that no operator takes part in."""

    def load():
        def encode(texts):
            raise RuntimeError("no model")

        return encode

    df = spark.createDataFrame([("k", "a")], f"{KEY} string, value string")
    with pytest.raises(Exception, match="no model"):
        vectors.embed_values(df, load).collect()
    lost = vectors.embed_values(df, load, on_error="status").cache()
    assert lost.first().vec is None
    assert [r.status for r in vectors.failed_vectors(lost).collect()] == ["no_vector"]
    asked = spark.createDataFrame([("k", "a")], f"{KEY} string, normalized string")
    assert neighbours.duplicate_check(asked, lost, load, on_error="status").count() == 0
    with pytest.raises(Exception, match="no model"):
        neighbours.duplicate_check(asked, lost, load).collect()


def test_null_vectors_change_no_similarity(spark):
    rows = [("k", "a", [1.0, 0.0, 0.0, 0.0]), ("k", "b", None), ("k", "c", [0.0, 1.0, 0.0, 0.0]), ("k", "d", [1.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, f"{KEY} string, id string, vec array<float>")
    found = {(r.query_id, r.id): round(r.similarity, 6) for r in neighbours.search(df, df, 3).collect()}
    assert found[("a", "a")] == 1.0 and found[("a", "c")] == 0.0 and found[("a", "d")] == 0.707107
    assert all("b" not in pair for pair in found)
    assert {(r.id1, r.id2) for r in neighbours.similar_pairs(df, 0.5).collect()} == {("a", "d"), ("c", "d")}


def test_matrix_refuses_null_and_ragged_vectors():
    import pyarrow as pa

    from formscribe.operators.blocks import matrix

    for bad in ([[1.0], None], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            matrix(pa.chunked_array([pa.array(bad)]))


def test_kmeans_uses_every_row_of_a_large_key(spark):
    """Two thirds of the values lie far from the first thousand by hash; their clusters are found all the same."""
    df = spark.range(50000).select(
        F.lit("k").alias(KEY), F.format_string("%06d", "id").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(3).alias("k"),
        F.array(F.lit(0)).alias("idx"), F.array((F.col("id") % 3) * 1000.0 + F.col("id") * 0.001).alias("w"),
    )
    labels = kmeans_labels(df, settings=Settings(block_rows=512)).cache()
    assert labels.count() == 50000
    sizes = {(r.third, r.cluster): r["count"] for r in labels.groupBy((F.col("id").cast("long") % 3).alias("third"), "cluster").count().collect()}
    assert len(sizes) == 3 and sum(sizes.values()) == 50000


def test_approximate_pairs_reach_the_recall(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 32))
    rows = [("k", f"{i}-{j}", [float(x) for x in base[i] + rng.normal(size=32) * 0.25]) for i in range(60) for j in range(3)]
    df = spark.createDataFrame(rows, f"{KEY} string, id string, vec array<float>")
    every = {(r.id1, r.id2) for r in neighbours.similar_pairs(df, 0.8).collect()}
    found = [(r.id1, r.id2) for r in neighbours.similar_pairs_approx(df, 0.8, settings=TINY).collect()]
    assert len(found) == len(set(found)) and set(found) <= every and len(found) >= 0.95 * len(every) > 100


def sparse(n=80, terms=30, seed=3, keys=2):
    """Unit rows over few terms; idx ascending."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.integers(0, 5)
        idx = sorted({int(base * 6 + j) for j in rng.integers(0, 6, size=3)} | {int(x) for x in rng.integers(0, terms, size=1)})
        w = rng.random(len(idx)) + 0.2
        w = w / np.linalg.norm(w)
        rows.append((f"k{i % keys}", f"{i:03d}", int(rng.integers(1, 4)), idx, w.tolist()))
    return rows


def dense(row, terms=30):
    out = np.zeros(terms)
    out[row[3]] = row[4]
    return out


def brute_density(rows, eps, min_samples, min_size):
    label = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        x = np.array([dense(r) for r in mine])
        near = x @ x.T >= 1 - eps - 1e-12
        np.fill_diagonal(near, True)
        n = np.array([r[2] for r in mine])
        core = near @ n >= min_samples
        seen = {}
        for s in range(len(mine)):
            if not core[s] or s in seen:
                continue
            stack, members = [s], {s}
            while stack:
                u = stack.pop()
                for v in np.flatnonzero(near[u] & core):
                    if v not in members:
                        members.add(int(v))
                        stack.append(int(v))
            for m in members:
                seen[m] = frozenset(mine[j][1] for j in members)
            if n[list(members)].sum() < min_size:
                for m in members:
                    seen[m] = None
        for j, r in enumerate(mine):
            label[r[1]] = seen.get(j)
    return label


@pytest.mark.parametrize("eps,min_samples,min_size", [(0.3, 2, 5), (0.5, 1, 1), (0.3, 6, 4), (0.15, 4, 3)])
def test_density_labels(spark, eps, min_samples, min_size):
    rows = sparse()
    df = spark.createDataFrame(rows, f"{KEY} string, id string, n long, idx array<int>, w array<double>")
    settings = Settings(density_eps=eps, min_samples=min_samples, min_cluster_size=min_size, block_rows=5)
    got = density.density_labels(df, settings=settings).collect()
    want = brute_density(rows, eps, min_samples, min_size)
    assert len(got) == len(rows)
    members = {}
    for r in got:
        members.setdefault((r[KEY], r.cluster), set()).add(r.id)
    for r in got:
        if want[r.id] is None:
            assert r.cluster == -1
        else:
            assert r.cluster >= 0 and members[(r[KEY], r.cluster)] == want[r.id]


def test_connected_chain(spark):
    edges = spark.createDataFrame([("g", f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "g string, a string, b string")
    got = density.connected(edges, ["g"]).select("root").distinct().collect()
    assert [r.root for r in got] == ["000"]


def test_silhouette_in_blocks(spark):
    rows = sparse(50)
    labelled = [(*r, i % 4 - 1) for i, r in enumerate(rows)]
    df = spark.createDataFrame(labelled, f"{KEY} string, id string, n long, idx array<int>, w array<double>, cluster int")
    got = {r[KEY]: r.silhouette for r in silhouette(df, settings=Settings(block_rows=6)).collect()}
    for key in ("k0", "k1"):
        x, c = [], []
        for r in labelled:
            if r[0] == key and r[5] >= 0:
                x += [dense(r)] * r[2]
                c += [r[5]] * r[2]
        x, c = np.array(x), np.array(c)
        if len(set(c)) < 2:
            assert got[key] == 0.0
            continue
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        s = []
        for i in range(len(x)):
            same = (c == c[i]).sum()
            a = d[i][c == c[i]].sum() / (same - 1) if same > 1 else None
            b = min(d[i][c == o].mean() for o in set(c) - {c[i]})
            s.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
        assert got[key] == pytest.approx(np.mean(s), abs=1e-9)


def test_silhouette_from_moments(spark):
    rows = sparse(40)
    labelled = [(*r, i % 3) for i, r in enumerate(rows)]
    df = spark.createDataFrame(labelled, f"{KEY} string, id string, n long, idx array<int>, w array<double>, cluster int")
    got = {r[KEY]: r for r in silhouette_of(df, settings=Settings(block_rows=6, silhouette_measure="squared")).collect()}
    for key in ("k0", "k1"):
        x = np.array([dense(r) for r in labelled if r[0] == key for _ in range(r[2])])
        c = np.array([r[5] for r in labelled if r[0] == key for _ in range(r[2])])
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        s = []
        for i in range(len(x)):
            a = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
            b = min(d[i][c == o].mean() for o in set(c) - {c[i]})
            s.append((b - a) / max(a, b))
        assert got[key].silhouette == pytest.approx(np.mean(s), abs=1e-9)
    plain = {r[KEY]: r.silhouette for r in silhouette(df).collect()}
    assert {r[KEY]: r.silhouette for r in silhouette_of(df).collect()} == pytest.approx(plain)
    with pytest.raises(ValueError):
        silhouette_of(df, settings=Settings(silhouette_measure="other"))


def test_kmeans_labels_every_row_and_separates(spark):
    rows = [("k", f"{i:03d}", 1, [0], [float(i % 3) * 100 + i * 0.1]) for i in range(30)]
    df = spark.createDataFrame(rows, f"{KEY} string, id string, n long, idx array<int>, w array<double>").withColumn("k", F.lit(3))
    got = {r.id: r.cluster for r in kmeans_labels(df, settings=Settings(block_rows=4)).collect()}
    assert len(got) == 30
    for i in range(30):
        assert got[f"{i:03d}"] == i % 3
    other = {r.id: r.cluster for r in kmeans_labels(df.repartition(5)).collect()}
    assert other == got


def test_lloyd_cost_never_rises():
    from formscribe.operators.kmeans import fit_centres

    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(200, 3)), rng.integers(1, 5, size=200).astype(float)
    costs = []
    for rounds in (1, 2, 4, 8, 16):
        c = fit_centres(x, w, 5, rounds)
        costs.append((w * ((x[:, None] - c[None]) ** 2).sum(-1).min(1)).sum())
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))


def words_table(spark, n=40, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = ["customer 00", "red widget", "blue ring xl", "ab"][int(rng.integers(4))]
        tail = "".join(str(x) for x in rng.choice(list("abc01 "), size=int(rng.integers(0, 5))))
        rows.append((f"k{i % 2}", base + tail))
    rows = sorted(set(rows))
    return rows, spark.createDataFrame(rows, f"{KEY} string, value string")


def test_similar_texts_match_brute_force(spark):
    rows, df = words_table(spark)
    want = {
        (k, a, b)
        for k, a in rows
        for j, b in rows
        if k == j and a < b and SequenceMatcher(None, a.lower(), b.lower()).ratio() > 0.8
    }
    found = mining.similar_texts(df, settings=Settings(block_rows=6)).collect()
    assert len(found) == len(want)
    assert {(r[KEY], r.left, r.right) for r in found} == want


def test_drawn_pairs_are_linear_and_below_the_limit(spark):
    rows, df = words_table(spark)
    drawn = mining.drawn_partners(df, 2)
    assert drawn.count() <= 2 * len(rows)
    for r in mining.dissimilar_texts(df).collect():
        assert SequenceMatcher(None, r.left.lower(), r.right.lower()).ratio() < 0.3


def test_numeric_clusters(spark):
    rows = [("k", f"{v} V", 1, i, "D_L") for i, v in enumerate([1, 2, 3, 100, 101, 102, 500, 501, 502, 503])]
    rows += [("k", "not a number", 1, 99, "L")]
    values = spark.createDataFrame(rows, f"{KEY} string, value string, n long, first_pos long, sig string")
    profiles = spark.createDataFrame([("k", True, False)], f"{KEY} string, is_numeric_unit boolean, is_free_text boolean")
    result = cluster.cluster_all(values, profiles, Settings(numeric_k=3))
    assert [tuple(r) for r in result.summary.collect()] == [("k", "numeric_unit", 3, 0.0)]
    labels = {r.value: r.cluster for r in result.labels.collect()}
    assert len(labels) == 10 and labels["1 V"] == labels["3 V"] != labels["100 V"]


def test_keys_without_terms_or_values(spark):
    rows = [("few", f"aa bb {i}", 1, i, "s") for i in range(3)] + [("plain", f"x{i}", 1, i, "s") for i in range(8)]
    values = spark.createDataFrame(rows, f"{KEY} string, value string, n long, first_pos long, sig string")
    profiles = spark.createDataFrame([("few", False, False), ("plain", False, False)], f"{KEY} string, is_numeric_unit boolean, is_free_text boolean")
    got = {r[KEY]: (r.method, r.n_clusters) for r in cluster.cluster_all(values, profiles).summary.collect()}
    assert got == {"few": ("insufficient_data", 0), "plain": ("error", 0)}
