"""Packed codes and the stored index."""
import numpy as np
import pytest

from formscribe.config import Settings
from formscribe.operators import ann, codes
from formscribe.operators.neighbours import search
from formscribe.operators.profile import KEY
from formscribe.session import cut_lineage
from formscribe.sources.index_store import IndexStore, split_cells

SCHEMA = f"{KEY} string, id string, vec array<float>"


def vectors(spark, n, key="k", dim=8, seed=1, middle=0.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(key, f"{i:04d}", [float(x) for x in rng.normal(middle, 1, dim)]) for i in range(n)], SCHEMA)


def ids(df):
    return {(r[KEY], r.id) for r in df.collect()}


def test_packed_codes(spark):
    settings = Settings(nlist=4, nprobe=4, pq_m=4, pq_bits=4, block_rows=40)
    rows = vectors(spark, 120).unionByName(vectors(spark, 60, "other", seed=2))
    centres = cut_lineage(ann.train_cells(rows, settings))
    index = cut_lineage(ann.assign_cells(rows, centres, settings))
    codebook = cut_lineage(codes.train_codes(index, centres, settings))
    coded = codes.pack_codes(index, centres, codebook, settings)
    middle = {(r[KEY], r.cell): np.array(r.vec) for r in centres.collect()}
    book = {(r[KEY], r.part, r.code): np.array(r.v) for r in codebook.collect()}
    raw = {(r[KEY], r.id): np.array(r.vec) / np.linalg.norm(r.vec) for r in rows.collect()}
    rebuilt = {}
    for r in coded.collect():
        assert len(r.code) == 4
        rest = raw[r[KEY], r.id] - middle[r[KEY], r.cell]
        for part, code in enumerate(r.code):
            gaps = {c: ((v - rest[2 * part : 2 * part + 2]) ** 2).sum() for (k, p, c), v in book.items() if (k, p) == (r[KEY], part)}
            assert gaps[code] <= min(gaps.values()) + 1e-9
        rebuilt[r[KEY], r.id] = middle[r[KEY], r.cell] + np.concatenate([book[r[KEY], p, c] for p, c in enumerate(r.code)])
    # all candidates are scored exactly: the exact search; a few: the best by the sums of the tables
    exact = {tuple(r[:3]) for r in search(rows, rows, 5, skip_same_id=True).select(KEY, "query_id", "id").collect()}
    every = codes.search_packed(rows, coded, centres, codebook, rows, 5, rerank=200, skip_same_id=True, settings=settings)
    assert {tuple(r) for r in every.select(KEY, "query_id", "id").collect()} == exact
    few = codes.search_packed(rows, coded, centres, codebook, rows, 5, rerank=5, skip_same_id=True, settings=settings)
    got = {}
    for r in few.collect():
        got.setdefault((r[KEY], r.query_id), set()).add(r.id)
    for (key, q), found in list(got.items())[:40]:
        near = sorted(((-float(raw[key, q] @ v), i) for (k, i), v in rebuilt.items() if k == key and i != q))
        limit = near[4][0] + 1e-5
        assert len(found) == 5 and all(-float(raw[key, q] @ rebuilt[key, i]) <= limit for i in found)
    plan = few._jdf.queryExecution().toString()
    assert "lut" in plan and codes.look_up_tables(rows.limit(0), codebook, settings).count() == 0
    with pytest.raises(ValueError, match="one byte"):
        codes.train_codes(index, centres, Settings(pq_bits=9))


def test_index_store(spark, tmp_path):
    settings = Settings(nlist=4)
    store = IndexStore(spark, str(tmp_path / "index"), settings)
    with pytest.raises(FileNotFoundError):
        store.load()
    rows = vectors(spark, 50)
    assert store.create(rows) == 1 and store.versions() == [1]
    changed = vectors(spark, 60, seed=9).where("id >= '0045'")
    assert store.append(changed.unionByName(vectors(spark, 5, "new"))) == 2
    live, centres = store.load()
    want = {(r[KEY], r.id): r.vec for r in rows.collect()} | {(r[KEY], r.id): r.vec for r in changed.unionByName(vectors(spark, 5, "new")).collect()}
    assert {(r[KEY], r.id): r.vec for r in live.collect()} == want
    assert {r[KEY] for r in centres.collect()} == {"k", "new"}
    store.remove(rows.where("id < '0010'").unionByName(vectors(spark, 3, "unknown")))
    assert ids(store.load()[0]) == {x for x in want if x[0] == "new" or x[1] >= "0010"}
    store.append(rows.where("id < '0003'"))
    assert len(ids(store.load()[0])) == len(want) - 7
    before = ids(store.load()[0])
    assert store.compact() == 5 and ids(store.load()[0]) == before
    # older versions stay what they were, and a version that was not written to its end does not count
    assert ids(store.load(1)[0]) == ids(rows) and len(ids(store.load(3)[0])) == len(want) - 10
    (tmp_path / "index" / "log" / "6").mkdir()
    assert store.versions()[-1] == 5
    with pytest.raises(FileNotFoundError):
        store.load(17)


def test_overgrown_cells_are_split(spark):
    settings = Settings(nlist=8, block_rows=16)
    rows = vectors(spark, 16, seed=3).unionByName(vectors(spark, 200, seed=4, middle=6.0).selectExpr(KEY, "concat('x', id) as id", "vec"))
    centres = cut_lineage(ann.train_cells(rows.where("id not like 'x%'"), settings))
    index = cut_lineage(ann.assign_cells(rows, centres, settings))
    sizes = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}
    large = [c for c, n in sizes.items() if n > 4 * sum(sizes.values()) / len(sizes) and n > 16]
    assert large
    grown, more = split_cells(index, centres, settings)
    assert ids(grown) == ids(rows) and more.count() == centres.count() + len(large)
    assert grown.count() == 216 and {r.cell for r in grown.collect()} <= {r.cell for r in more.collect()}
    assert max(r["count"] for r in grown.groupBy("cell").count().collect()) < max(sizes.values())
    found = ann.search_cells(rows, grown, more, 3, settings=Settings(nprobe=64))
    exact = search(rows, rows, 3)
    assert {tuple(r[:3]) for r in found.select(KEY, "query_id", "id").collect()} == {tuple(r[:3]) for r in exact.select(KEY, "query_id", "id").collect()}
    small = vectors(spark, 20)
    same, _ = split_cells(ann.assign_cells(small, ann.train_cells(small, settings), settings).limit(0), centres, settings)
    assert same.count() == 0
