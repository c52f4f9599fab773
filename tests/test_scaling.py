"""What is moved or held must not outgrow the input."""
import numpy as np
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators import blocks, codes, kmeans, neighbours, terms, vectors
from formscribe.operators.profile import KEY, key_profiles, key_stats
from formscribe.operators.silhouette import silhouette
from formscribe.session import cut_lineage
from formscribe.plans.catalog.approximate import cell_recall, search_codes
from formscribe.sources import csv_ranges


def test_pair_blocks_move_rows_a_bounded_number_of_times(spark):
    rows = spark.range(400).select(F.lit("k").alias(KEY), F.col("id").cast("string").alias("id"))
    moved = blocks.block_pairs(rows, [KEY], "id", 1, tiled=True)
    assert moved.count() == 400 * blocks.PAIR_BLOCKS
    assert moved.select("lo", "hi").distinct().count() == blocks.PAIR_BLOCKS * (blocks.PAIR_BLOCKS + 1) // 2
    large = spark.range(1).select(F.lit("k").alias(KEY))
    assert blocks.pair_counts(large.crossJoin(spark.range(100)), [KEY], 1, rows=10).first()["nb"] == 10


def test_best_columns_over_several_tiles():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 40, (600, 5000)) / 40.0
    scores[5, 7], scores[9, :100] = np.nan, np.nan
    ids = np.array([f"{i:05d}" for i in range(5000)], dtype=object)
    asks = ids[np.arange(600) * 8]
    for k, threshold in ((3, None), (70, None), (3, 0.99)):
        r, c, s = neighbours.best_columns(lambda q, t: scores[q, t].copy(), asks, ids, k, threshold, True)
        for i in (0, 5, 9, 511, 512, 599):
            line = [(-x, j) for j, x in enumerate(scores[i]) if ids[j] != asks[i] and np.isfinite(x) and (threshold is None or x >= threshold)]
            assert list(zip((-s[r == i]).tolist(), c[r == i].tolist())) == sorted(line)[:k]


def test_best_columns_from_products_of_32_bits():
    rng = np.random.default_rng(5)
    stored = rng.normal(size=(5000, 6))
    stored[1::2] = stored[::2] + rng.normal(scale=1e-8, size=(2500, 6))
    stored /= np.sqrt((stored * stored).sum(1))[:, None]
    ids, few = np.array([f"{i:05d}" for i in range(5000)], dtype=object), stored.astype(np.float32)
    exact = lambda r, c: np.einsum("ij,ij->i", stored[r], stored[c])
    got = neighbours.best_columns(lambda q, t: few[q] @ few[t].T, ids[:600], ids, 5, 0.2, True, exact, 14 * 2.0**-23)
    r, c = np.divmod(np.arange(600 * 5000), 5000)
    every = exact(r, c).reshape(600, 5000)
    for i in (0, 1, 511, 512, 599):
        line = sorted((-x, j) for j, x in enumerate(every[i]) if j != i and x >= 0.2)[:5]
        assert list(zip((-got[2][got[0] == i]).tolist(), got[1][got[0] == i].tolist())) == line


def test_pairs_are_scored_in_batches_as_by_columns(spark):
    rng = np.random.default_rng(6)
    data = [(rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for _ in range(50)] + [([0.0] * 9, [1.0] * 9), (None, [1.0] * 9)]
    scored = spark.createDataFrame(data, "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.paired_cosine(F.col("a"), F.col("b")).alias("y"))
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()
    assert all(r.x == r.y for r in scored.collect())


def test_lloyd_rounds_move_a_block_as_one_row(spark):
    data = [("k", f"{i:03d}", 1, [0, 1], [float(i % 7), 1.0]) for i in range(100)] + [("j", "a", 2, [1], [3.0])]
    rows = spark.createDataFrame(data, f"{KEY} string, id string, n long, idx array<int>, w array<double>")
    blocked = blocks.add_blocks(rows, [KEY], "id", 20)
    packed = kmeans._packed(blocked, [KEY]).collect()
    assert len(packed) == blocked.select(KEY, "b").distinct().count() and sum(len(r.n) for r in packed) == 101
    centres = spark.createDataFrame([("k", 5, 0, [0, 1], [0.0, 1.0]), ("k", 5, 1, [0, 1], [6.0, 1.0]), ("k", 5, 2, [0], [99.0]), ("j", 1, 0, [1], [3.0])], f"{KEY} string, nb int, cluster int, idx array<int>, w array<double>")
    moved = {(r[KEY], r.cluster): r for r in kmeans._moved(spark.createDataFrame(packed), centres, [KEY], False).collect()}
    near = [float(i % 7) for i in range(100)]
    assert moved["k", 0].w == [round(np.mean([x for x in near if x <= 3]), 12), 1.0] and moved["k", 0].moved
    assert moved["k", 2].w == [99.0] and not moved["k", 2].moved and moved["j", 0].w == [3.0] and not moved["j", 0].moved


def test_silhouette_of_pairs_of_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [("k", f"{i:03d}", 1, [0, 1], rng.normal(i % 3, 1, 2).tolist(), i % 3) for i in range(60)]
    df = spark.createDataFrame(data, f"{KEY} string, id string, n long, idx array<int>, w array<double>, cluster int")
    want = silhouette(df, settings=Settings(block_rows=1000)).first()["silhouette"]
    assert abs(silhouette(df, settings=Settings(block_rows=2)).first()["silhouette"] - want) < 1e-12


def test_packed_search_moves_no_look_up_tables(spark):
    rows = spark.createDataFrame([("k", f"{i}", [float(i), 1.0]) for i in range(4)], f"{KEY} string, id string, vec array<float>")
    centres = spark.createDataFrame([("k", 0, [0.5, 0.5])], f"{KEY} string, cell int, vec array<double>")
    book = spark.createDataFrame([("k", 0, 0, [0.0, 0.0]), ("k", 0, 1, [0.1, 0.1])], f"{KEY} string, part int, code int, v array<double>")
    coded = spark.createDataFrame([("k", 0, f"{i}", bytes([i % 2])) for i in range(4)], f"{KEY} string, cell int, id string, code binary")
    found = codes.search_packed(rows, coded, centres, book, rows, 2, skip_same_id=True, settings=Settings(nlist=1, nprobe=1, pq_m=1, pq_bits=1))
    assert "AS data" in str(found._jdf.queryExecution().toString()) and "lut#" not in found._jdf.queryExecution().toString()
    assert found.count() == 8


def test_lloyd_rounds_read_the_rows_a_fixed_number_of_times(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(1)
    plain = cut_lineage(spark.createDataFrame([("k", f"{i:03d}", 1, float(x)) for i, x in enumerate(rng.uniform(0, 1, 300))], f"{KEY} string, id string, n long, x double"))
    rows = plain.select(KEY, "id", "n", F.lit(6).alias("k"), F.array(F.lit(0)).alias("idx"), F.array(counted.asNondeterministic()("x")).alias("w"))
    kmeans.train_centres(rows, settings=Settings(block_rows=50, kmeans_rounds=12))
    assert seen.value <= 300 * 4


def test_csv_records_leave_a_range_as_soon_as_they_end():
    cutter = csv_ranges._Cutter(0, -1, -1, -1, 0, 1, True)
    out = []
    for line in ["a,b", *(x for i in range(1000) for x in ('k,"one', f'two {i}"', f"k,plain {i}"))]:
        out += cutter.add(line)
        assert len(cutter.opened) <= 1 and not cutter.earlier and not cutter.broken
    assert len(out) == 2000 and out[0] == ('k,"one\ntwo 0"', True, None, None) and not list(cutter.end())


def test_csv_tasks_get_the_entries_of_their_own_ranges(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n" + "".join(f'k,"two\nlines {i}"\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = csv_ranges.read_records(spark, str(tmp_path / "m.csv"), 2, "UTF-8", True)
        plan = read._jdf.queryExecution().toString()
        assert read.count() == 3000 and "left_open" in plan and "BroadcastHashJoin" in plan
        lines = csv_ranges.range_lines(spark, str(tmp_path / "m.csv"), "UTF-8")
        few = csv_ranges.gathered(lines)
        assert lines.rdd.getNumPartitions() > 50 and few.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_terms_are_counted_without_moving_them(spark):
    data = [("k", "aa bb aa bb aa", 2), ("k", "", 1), ("j", "x", 1), ("j", "cc dd", 3)]
    counts = terms.term_counts(spark.createDataFrame(data, f"{KEY} string, value string, n long"), Settings(ngram_min=1, ngram_max=2))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.term, r.n, r.tf) for r in counts.collect())
    assert got == [("aa", 2, 3), ("aa bb", 2, 2), ("bb", 2, 2), ("bb aa", 2, 2), ("cc", 3, 1), ("cc dd", 3, 1), ("dd", 3, 1)]


def test_term_totals_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = ["aa", "bb", "Éa", "d1", "x", "e_e"]
    data = [(f"k{i % 3}", " ".join(rng.choice(words, rng.integers(0, 12))), int(rng.integers(1, 4))) for i in range(80)] + [("k1", "", 1), ("k9", "one two", 2)]
    values = spark.createDataFrame(data, f"{KEY} string, value string, n long").groupBy(KEY, "value").agg(F.sum("n").alias("n")).coalesce(2)
    monkeypatch.setattr(terms, "SLICE_WORDS", 50)
    for analyzer, low, high in (("word", 1, 3), ("word", 2, 4), ("char", 2, 3)):
        settings = Settings(ngram_min=low, ngram_max=high)
        each = terms.term_counts(values, settings, analyzer)
        sums = terms.term_counts(values, settings, analyzer, per_value=False)
        plan = sums._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
        wanted = each.groupBy(KEY, "term").agg(F.sum("n").alias("n"), F.sum(F.col("tf") * F.col("n")).alias("total"))
        got = sums.groupBy(KEY, "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) != []


def test_terms_below_the_floor_are_not_ranked(spark):
    data = [("k", f"t{i:02d}", 10 - i // 3, 0) for i in range(30)] + [("j", "a", 1, 0)]
    rows = spark.createDataFrame(data, f"{KEY} string, term string, total long, df long")
    assert sorted(r.term for r in terms._above_floor(rows, 4).collect()) == ["a", *(f"t{i:02d}" for i in range(6))]
    assert terms._above_floor(rows, 40).count() == 31


def test_searches_ask_with_every_row(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(i % 3, 1.0, 8).tolist()) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = search_codes(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == sorted((str(q), k) for q in range(130) for k in range(1, 6))
    share = cell_recall(spark, str(tmp_path)).first()
    assert share.wanted == 130 * 5 and 0.0 < share.recall <= 1.0


def test_signatures_of_a_table_are_worked_out_in_batches(spark):
    rows = spark.createDataFrame([("a", "b", "c", "x 12"), ("a", "b", "c", "y-3")], "key_part1 string, key_part2 string, key_part3 string, value string")
    for made in (key_stats(rows), key_profiles(rows)):
        assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
        assert sorted(s["sig"] for s in made.first()["top_signatures"] or []) in ([], ["LOD", "L_D2"])


def test_ends_of_a_text_are_cut_without_a_search_through_it(spark):
    blanks = "".join(map(chr, range(0x3001)))
    odd = ["".join(c for c in blanks if c.isspace()) + "a\u2003 b" + "\u3000\x1c\x85", "", " \t", "\u200bx\u200b", "a  b \t c", "a\tb", None]
    df = spark.createDataFrame([(v,) for v in odd], "v string").select("v", text.strip(F.col("v")).alias("s"), text.collapse_whitespace(F.col("v")).alias("c"))
    assert "regexp" not in df.select("s")._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        assert r.s == (None if r.v is None else r.v.strip()) and r.c == " ".join((r.v or "").split())
