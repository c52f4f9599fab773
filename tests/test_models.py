"""Fitted cluster models on values of a few plain forms."""
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators import models as L
from formscribe.operators.profile import KEY

SCHEMA = f"{KEY} string, value string, n long, first_pos long, sig string"
WORDS = Settings(ngram_min=1, ngram_max=1)
GRID = ((3, 2, "euclidean"), (3, 2, "cosine"))


def values(spark, key, kinds, numbers):
    # a single letter is no word, so values of a kind have the same terms
    rows = [(key, f"{kind} item {chr(97 + i)}", 1, i, kind) for kind in kinds for i in numbers]
    return spark.createDataFrame(rows, SCHEMA)


def test_models_label_new_values(spark, tmp_path):
    kinds = ("red apple", "green pear", "blue plum")
    learnt = values(spark, "fruit", kinds, range(12)).unionByName(values(spark, "few", kinds[:1], range(4)))
    fitted = L.fit_models(learnt, WORDS, GRID, most=5)
    assert [r[KEY] for r in fitted.models.collect()] == ["fruit"]
    fitted.save(str(tmp_path / "m"))
    loaded = L.load_models(spark, str(tmp_path / "m"))
    new = values(spark, "fruit", kinds, range(20, 26)).unionByName(values(spark, "unknown", kinds, range(3)))
    got = L.predict(loaded, new, WORDS).collect()
    assert {r[KEY] for r in got} == {"fruit"} and len(got) == 18
    by_kind = {}
    for r in got:
        by_kind.setdefault(r.sig, set()).add(r.cluster)
    assert all(len(c) == 1 for c in by_kind.values()) and len(set.union(*by_kind.values())) == 3
    scores = L.evaluate(loaded, new, WORDS).first()
    assert scores.adjusted_rand_index == 1.0 and scores.n_clusters_predicted == 3 and scores.tested == 18 and 0 < scores.silhouette_score <= 1
    assert L.predict(loaded, new.limit(0), WORDS).count() == 0


def test_far_values_are_noise_for_density(spark):
    learnt = values(spark, "fruit", ("red apple", "green pear"), range(10))
    fitted = L.fit_models(learnt, WORDS, GRID, most=5)
    dense = L.ClusterModels(fitted.terms, fitted.models.withColumn("type", F.lit("density")), fitted.centres)
    odd = spark.createDataFrame([("fruit", "pear apple pear apple", 1, 0, "s"), ("fruit", "nothing known", 1, 1, "s")], SCHEMA)
    got = {r.value: r.cluster for r in L.predict(dense, odd, WORDS).collect()}
    assert got["nothing known"] == -1
    plain = L.ClusterModels(fitted.terms, fitted.models.withColumn("type", F.lit("kmeans")), fitted.centres)
    assert min(r.cluster for r in L.predict(plain, odd, WORDS).collect()) >= 0
