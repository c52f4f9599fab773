"""Divergence audit, importance resampling and prefix forest against plain Python, and on awkward rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from formscribe.llm import divergence, importance, prefix_forest, radix, terms

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "so many WORDS in a row, " * 20_000
UNBROKEN = "é" * 3000
SCHEMA = "doc_id long, text string, lang string, source string"
#: Null and empty texts, groups and ids, very long texts and words, equal rows; columns with the names used inside.
ROWS = [
    (1, "Alpha beta, alpha's 3 ways", "en", "a"),
    (1, "Alpha beta, alpha's 3 ways", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", "b"),
    (4, "alpha ALPHA ÀÉ Àé beta_gamma", None, None),
    (5, LONG, "en", "b"),
    (6, f"alpha {UNBROKEN}a {UNBROKEN}b", "en", "c"),
    (7, f"beta {UNBROKEN}a", "en", ""),
    (None, "beta so many", "en", None),
    (8, "12 34 -- \x00 \t", "de", "only"),
    (9, "漢字 漢字 alpha", "zh", "x"),
    (10, "漢字 beta", "zh", "y"),
    (None, None, None, None),
]
CLASHES = ["term", "docs", "n", "p", "place", "buckets", "r_block", "f_text", "node", "pos", "key", "part", "score", "rank"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def with_clashes(df):
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i))
    return df


def random_documents(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdeé')}{'xyz'[i % 3] * (i % 40)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    out = []
    for i in range(n):
        source = rng.choice("pqrs")
        words = rng.choices(vocabulary, weights=[1 / (1 + (j * (1 + ord(source)) % 300)) for j in range(300)], k=rng.randrange(0, 80))
        out.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words), rng.choice(["en", "de"]), source))
    return out


def audit(rows, least_docs, shown=10):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for _, text, lang, source in rows:
        found = LETTERS.findall(lowered(text))
        count[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(count[g])
        q, p = shares(whole), {g[1]: shares(count[g]) for g in groups if g[0] == lang}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            odd = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", odd)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[: shown if part == "term" else None])]
    return sorted(out)


def test_pointer_sort():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200)))) for _ in range(3000)]
    words += ["a" * n for n in (64, 72, 64, 500, 500, 499)] + ["é" * 40, "é" * 40]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    start, length, row = terms.spans(data, np.array([0, len(data)]), terms.LETTERS)
    order, run = divergence.sorted_runs(data, start, length)
    got = [data[s : s + n].tobytes().decode() for s, n in zip(start[order], length[order])]
    assert Counter(got) == Counter(words) and (np.diff(run) >= 0).all()
    assert all((a == b) == (x == y) for a, b, x, y in zip(got, got[1:], run, run[1:]))
    assert len(set(got)) == run[-1] + 1
    assert len(divergence.sorted_runs(data[:0], start[:0], length[:0])[0]) == 0


def test_divergence_against_plain_python(spark):
    rows = random_documents(3, 200)
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), least_docs=4)
    assert sorted(map(tuple, got.collect())) == audit(rows, 4)


@pytest.mark.parametrize("least_docs", [1, 2])
def test_divergence_awkward(spark, least_docs, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 4)
    df = with_clashes(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(map(tuple, divergence.source_divergence(df, least_docs=least_docs).collect())) == audit(ROWS, least_docs)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_divergence_shares_are_exact(spark):
    big = 2**62 // 3
    row = spark.createDataFrame([(big, 3 * big, 17)], "n long, total long, terms long")
    got = row.select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 34)


def test_crc_of_spans():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 3, 64, 65, 300)))) for _ in range(500)]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    length = np.array([len(w) for w in words])
    got = importance.crc32s(data, np.cumsum(length) - length, length)
    assert got.tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("digit_bits, block_bits", [(9, 2), (12, 16)])
def test_radix_places(spark, digit_bits, block_bits):
    rng = random.Random(5)
    rows = [(rng.choice([None, -(2**63), 2**63 - 1, 0, *range(-5, 5)]), rng.choice([None, 2**40, 7, -3]), i) for i in range(150)]
    df = spark.createDataFrame(rows, "a long, b long, i int").repartition(6)
    got = {r.place: (r.a, r.b) for r in radix.radix_places(df, [("a", True), ("b", False)], digit_bits, block_bits).collect()}
    want = sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, x[1] or 0))
    assert [got[i] for i in range(len(rows))] == want
    assert radix.radix_places(df.limit(0), [("a", True)]).count() == 0
    assert sorted(r.place for r in radix.radix_places(df.limit(5).selectExpr("1L as a"), [("a", True)]).collect()) == list(range(5))


def resampled(rows, target, grams=(1, 1), buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        w = WORDS.findall(lowered(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]

    docs = [(i, *features(t)) for i, t, *_ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets))))
    out = []
    for i, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("grams, buckets", [((1, 1), 10_000), ((1, 3), 70_000), ((2, 2), 50)])
def test_resampling_against_plain_python(spark, grams, buckets):
    rows = random_documents(8, 150)
    target = [t for _, t, _, s in rows if s == "p"] + [None, ""]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, wanted, grams=grams, buckets=buckets, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, target, grams, buckets, percent=30)


def test_resampling_awkward(spark):
    df = with_clashes(spark.createDataFrame(ROWS, SCHEMA))
    none = spark.createDataFrame([], "text string")
    got = importance.resample(df, none, least_words=1, percent=50)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(ROWS, [], least=1, percent=50)
    assert importance.resample(df.limit(0), none).count() == 0
    again = importance.resample(df.repartition(5), none, least_words=1, percent=50)
    assert sorted(map(tuple, again.collect()), key=str) == resampled(ROWS, [], least=1, percent=50)


def nearest(rows, k=5, every=50):
    """(query id, list of (score, id)) of all query rows by full comparison."""
    dims = Counter(len(v) for _, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v))
    dim = max(dims, key=lambda d: (dims[d], d)) if dims else 0
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, v) in enumerate(good):
        if q is None or q % every:
            continue
        scored = [(float((v * w).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))), i) for b, (i, w) in enumerate(good) if a != b]
        out.append((q, sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]))
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r.query_id].append((r.score, r.vec_id))
    return out


def vectors(spark, rows, partitions=3):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(partitions)


def test_forest_recall_and_exact_scores(spark, monkeypatch):
    """Unstructured vectors, tight groups and copies, in many blocks and parts: recall, scores, order, ties."""
    monkeypatch.setattr(prefix_forest, "BLOCK", 100)
    monkeypatch.setattr(prefix_forest, "PART", 2000)
    rng = np.random.default_rng(4)
    loose, middles = rng.normal(size=(500, 24)), rng.normal(size=(20, 24))
    tight = middles[rng.integers(0, 20, 600)] + rng.normal(scale=0.15, size=(600, 24))
    copies = np.tile(loose[:2], (150, 1))
    rows = list(enumerate(rng.permutation(np.concatenate([loose, tight, copies])).tolist()))
    got = found(prefix_forest.nearest_neighbours(vectors(spark, rows), every=10))
    hit = wanted = 0
    for q, exact in nearest(rows, every=10):
        assert len(got[q]) == 5 and [x[0] for x in got[q]] == sorted((x[0] for x in got[q]), reverse=True)
        scores = dict((i, s) for s, i in nearest([(0, rows[q][1]), *[(i + 1, rows[i][1]) for _, i in got[q]]], every=10**9)[0][1])
        assert all(abs(scores[i + 1] - s) < 1e-12 for s, i in got[q])
        hit, wanted = hit + len({i for _, i in got[q]} & {i for _, i in exact}), wanted + 5
        if exact[4][0] > 1 - 1e-12:  # copies: the smallest ids, in order
            assert [i for _, i in got[q]] == [i for _, i in exact]
    assert hit / wanted >= 0.95


def test_forest_levels():
    """Closer neighbours need shorter ascents, and a pair at the stated cosine shares the prefix about as often."""
    steps = prefix_forest.level_cosines(32)
    assert steps == sorted(steps) and 0 < steps[0] < 0.7 < steps[-1] <= 1
    rng = np.random.default_rng(6)
    cosine = steps[1] + 0.02
    one = rng.normal(size=(400, 32))
    one /= np.linalg.norm(one, axis=1)[:, None]
    other = rng.normal(size=(400, 32))
    other -= (other * one).sum(1)[:, None] * one
    other /= np.linalg.norm(other, axis=1)[:, None]
    two = cosine * one + math.sqrt(1 - cosine**2) * other
    met = np.zeros(400, dtype=bool)
    for tree in range(prefix_forest.TREES):
        met |= prefix_forest.hash_strings(one, tree) >> 48 == prefix_forest.hash_strings(two, tree) >> 48
    assert met.mean() >= prefix_forest.RECALL - 0.04


def test_forest_awkward(spark):
    """Null, zero, non-finite, odd lengths, null and negative and repeated ids, equal rows, fewer candidates than asked."""
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [2.0, 1.0]), (1, [2.0, 4.0]), (None, [1.0, 2.0]), (-50, [-1.0, 0.5]),
        (100, None), (150, [0.0, 0.0]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, [None, 1.0]), (350, [1.0, 2.0, 3.0]), (400, []),
        (3, [0.0, 0.0]), (4, None), (5, [1e-3, 3.0]),
    ]
    got = found(prefix_forest.nearest_neighbours(vectors(spark, rows), k=3))
    want = defaultdict(list)
    for q, near in nearest(rows, 3):
        want[q] += near
    assert got.keys() == want.keys()
    for q in want:
        assert sorted(str(i) for _, i in got[q]) == sorted(str(i) for _, i in want[q])
        assert sorted(s for s, _ in got[q]) == pytest.approx(sorted(s for s, _ in want[q]))
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert [tuple(r)[:3] for r in prefix_forest.nearest_neighbours(vectors(spark, few)).collect()] == [(0, 1, 1)]
    assert prefix_forest.nearest_neighbours(vectors(spark, few[:1])).count() == 0
    assert prefix_forest.nearest_neighbours(vectors(spark, few).limit(0)).count() == 0
