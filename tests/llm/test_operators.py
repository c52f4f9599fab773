"""Corpus operators against plain Python, on the smallest tables and on awkward rows."""
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from formscribe.llm import chat, decontaminate, licenses, mixing, near, parsing, quality, queries, spans, token_files, urls
from formscribe.session import scratch_path
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
LONG = "so many words in a row " * 4000
SHARED = " ".join(f"w{i}" for i in range(70))
#: Null ids and texts, blanks only, very long, equal ids, equal rows, ties; columns whose names the operators use inside.
ROWS = [
    (1, "alpha beta gamma", "a", "en"),
    (2, None, "a", None),
    (3, "", None, "en"),
    (4, " \t\n\x0b\x0c\r ", "b", "en"),
    (5, LONG, "b", "en"),
    (6, f"x {SHARED} y", "c", "de"),
    (7, f"z {SHARED}", "c", "de"),
    (7, f"{SHARED} q", None, "de"),
    (8, "twice the same row of a few words", "a", "en"),
    (8, "twice the same row of a few words", "a", "en"),
    (None, f"no id {SHARED}", "d", "en"),
    (None, None, None, None),
    (2**62 + 1, "é 漢字 \U0001f600 <|endoftext|>", "é", "fr"),
]
CLASHES = ["m_text", "m_source", "m_words", "k_text", "_leaked", "leaked", "digest", "other", "shard", "at", "id", "size", "word", "words", "key", "node", "part", "text_hash", "block", "window", "links", "place"]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i))
    return df.cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]


def test_mix_meets_targets(spark, docs, rows):
    got = mixing.mix_documents(docs).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _, _ in rows]
    want, source = brute.targets(rows), {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        size, target = want[source[r.doc_id]]
        assert (r.size, r.source_size) == (len(brute.words(dict((i, t) for i, t, _ in rows)[r.doc_id])), size)
        assert r.target == pytest.approx(target) and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, (_, t) in want.items())
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_draws_are_whole_epochs(spark, docs):
    """Every block of a source comes once per epoch, the last epoch aside, and shards are even."""
    sizes = mixing.sized_documents(docs, "doc_id", "text", "source")
    targets = mixing.source_targets(sizes)
    draws = mixing.deal_blocks(targets, block_words=64, shard_words=4096).collect()
    assert max(Counter((r.source, r.epoch, r.block) for r in draws).values()) == 1
    shards = Counter(r.shard for r in draws)
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) > 4
    words = Counter()
    for r in draws:
        words[r.source] += r.words
    for t in targets.collect():
        assert words[t.source] == math.floor(t.target + 0.5)
        per_epoch = Counter(r.epoch for r in draws if r.source == t.source)
        full = -(-t.source_size // 64)
        assert all(per_epoch[e] == full for e in range(max(per_epoch)))


def test_mix_tree_decides_shards_and_order(spark, docs):
    """Shards hold about equal words, sources lie in them as the tree has drawn, and rows come shard by shard in order."""
    few, many = (mixing.mix_documents(docs, shard_words=w, block_words=64).collect() for w in (1 << 15, 1 << 12))
    for got in (few, many):
        assert all((r.shard is None) == (r.taken == 0) == (r.place is None) for r in got)
    spread = [len({r.shard for r in got if r.taken}) for got in (few, many)]
    assert 1 < spread[0] < spread[1]
    assert {r.doc_id: r.taken for r in few} == {r.doc_id: r.taken for r in many}
    again = mixing.mix_documents(docs, shard_words=1 << 12, block_words=64, seed=1).collect()
    assert {r.doc_id: r.shard for r in again} != {r.doc_id: r.shard for r in many}
    pieces = mixing.mix_pieces(mixing.sized_documents(docs, "doc_id", "text", "source"), mixing.source_targets(mixing.sized_documents(docs, "doc_id", "text", "source")), 64, 1 << 12, whole=True)
    order = {(r.doc_id, r.epoch): (r.shard, r.place, r["at"]) for r in pieces.collect()}
    by_id = {}
    for (i, _), at in order.items():
        by_id.setdefault(i, set()).add(at)
    rows = mixing.mixed_rows(docs, block_words=64, shard_words=1 << 12, whole=True).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == len(order)
    for task in {r.task for r in rows}:
        shards = [{at[0] for at in by_id[r.doc_id]} for r in rows if r.task == task]
        last = -1
        for options in shards:
            last = min(s for s in options if s >= last)


def test_mix_split_is_hypergeometric():
    rng = np.random.default_rng(1)
    quotas = np.array([30, 50, 20])
    drawn = np.array([mixing._split(quotas, 40, rng) for _ in range(3000)])
    assert (drawn.sum(axis=1) == 40).all() and (drawn <= quotas).all()
    assert np.allclose(drawn.mean(axis=0), quotas * 0.4, atol=0.3)


def test_mix_walk_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        size, seed = np.full(n, n), np.full(n, 5, dtype=np.uint64)
        out = mixing._walk(np.arange(n), size, seed)
        assert sorted(out) == list(range(n))
        assert (mixing._walk(out, size, seed, back=True) == np.arange(n)).all()


def test_mix_awkward(spark, awkward):
    got = mixing.mix_documents(awkward).collect()
    assert len(got) == len(ROWS)
    want = brute.targets([r[:3] for r in ROWS])
    assert sum(r.taken for r in got) == pytest.approx(sum(t for _, t in want.values()), abs=len(want))
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_documents(awkward.limit(0)).count() == 0
    mixed = mixing.mixed_rows(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() >= 1 and mixing.mixed_rows(awkward.limit(0)).count() == 0


def test_mixed_rows_hold_the_taken_words(spark, docs):
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(docs).collect()}
    held = Counter()
    for r in mixing.mixed_rows(docs).collect():
        held[r.doc_id] += len(brute.words(r.text))
    assert {i: n for i, n in taken.items() if n} == dict(held)


def test_mix_keeps_texts(spark, docs, rows):
    """Whole documents: multiples of their sizes, near the target. Else one document a source keeps its first words."""
    texts, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    want, longest, taken = brute.targets(rows), Counter(), Counter()
    for r in queries.op1(spark, SF_DIR).collect():
        assert r.taken == 0 or r.taken % r["size"] == 0
        taken[source[r.doc_id]] += r.taken
        longest[source[r.doc_id]] = max(longest[source[r.doc_id]], r["size"])
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, (_, t) in want.items())
    mixed = mixing.mixed_rows(docs).collect()
    assert all(texts[r.doc_id].startswith(r.text) for r in mixed)
    cut = [r for r in mixed if r.text != texts[r.doc_id]]
    assert max(Counter(r.source for r in cut).values(), default=0) <= 1
    assert all(r.n_chars == len(r.text) for r in cut)
    assert all(r.text == texts[r.doc_id] for r in mixing.mixed_rows(docs, whole=True).collect())


def test_mixed_rows_come_once_per_copy(spark):
    twice = spark.createDataFrame([(1, "a b c d", "s"), (1, "a b c d", "s"), (2, "e f", "s")], "doc_id long, text string, source string")
    assert sorted(r.text for r in mixing.mixed_rows(twice).collect()) == ["a b c d", "a b c d", "e f"]


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    scores = {r.doc_id: r for r in quality.score_quality(docs, labels.where(~held)).collect()}
    assert len(scores) == docs.count()
    test = [(scores[r.doc_id], r.quality) for r in labels.where(held).collect()]
    assert sum(s.keep == bool(q) for s, q in test) / len(test) >= 0.97
    good = [s for s, q in test if q]
    assert sum(s.keep for s in good) / len(good) >= 0.98
    assert all(0 <= s.text_score <= 1 and 0 <= s.meta_score <= 1 and 0 <= s.score <= 1 for s in scores.values())


def test_quality_views_teach_each_other(spark):
    """With metadata that tells the class, pseudo-labels flow from it to the text view."""
    rng = np.random.default_rng(4)

    def table(n):
        y = rng.integers(0, 2, n)
        out = {f: rng.normal(size=n) for f in (*quality.TEXT, *quality.META)}
        out["symbols"] = out["symbols"] + 2 * y
        return __import__("pandas").DataFrame(out | {"source": y * 7, "lang": 0, "y": y})

    model = quality.co_train(table(60), table(3000).drop(columns="y"))
    assert model.exchanged > 100


def test_quality_learns_from_every_sure_row(spark):
    """More than 500 rows a class and round, also of one class alone, and the same from pandas and from Spark."""
    import pandas as pd

    rng = np.random.default_rng(4)

    def table(y):
        out = {f: rng.normal(size=len(y)) for f in (*quality.TEXT, *quality.META)}
        return pd.DataFrame(out | {"symbols": out["symbols"] + 2 * y, "source": y * 7, "lang": 0, "y": y})

    labelled = table(rng.integers(0, 2, 400))
    for y in (rng.integers(0, 2, 30_000), np.ones(30_000, dtype=int)):
        pool = table(y).drop(columns="y")
        local = quality.co_train(labelled, pool)
        assert local.exchanged >= 30_000
        spread = quality.co_train(labelled, spark.createDataFrame(pool).repartition(5))
        assert spread.exchanged == local.exchanged
        assert np.allclose(spread.text, local.text, atol=1e-4) and np.allclose(spread.mean, local.mean)


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 9), (1, 0, 9), (None, 1, 9), (5, None, 9)], "doc_id long, quality int, text int")
    got = quality.score_quality(awkward, labels).collect()
    assert len(got) == len(ROWS) and all(r.keep for r in got)
    assert quality.score_quality(awkward, labels.limit(0)).where("keep").count() == len(ROWS)
    assert quality.score_quality(awkward.limit(0), labels).count() == 0
    assert quality.keep_good(awkward, labels).columns == awkward.columns


@pytest.mark.parametrize("layout", chat.LAYOUTS, ids=lambda x: x.name)
def test_chat_layouts(spark, layout):
    shuffled = layout.example.replace('""', '"hi </s>"').replace('{"', '{ "')
    got = chat.canonical_turns(spark.createDataFrame([(1, shuffled)], "k int, record string"), ["k"], "record").first()
    assert got.layout == layout.name and len(got.turns) >= 1
    assert all(t.text == "hi </s>" for t in got.turns)


def test_chat_unknown_layouts_keep_their_row(spark):
    bad = [(1, None), (2, ""), (3, "{"), (4, '{"other":1}'), (5, "[]"), (6, '{"messages":null}')]
    got = chat.canonical_turns(spark.createDataFrame(bad, "k int, record string"), ["k"], "record").collect()
    assert len(got) == len(bad) and all(r.layout is None and r.turns == [] for r in got)


def test_chat_round_trip(spark):
    texts = [
        None, "", "</s>[INST] ok [/INST]", "<\\/s> [\\INST]", "<\\\\/s>", "<|end|><|turn|>user<|text|>x", "a\nb\\", "<<s>>", "[[INST]]",
        "<|im_start|>system\n<|im_end|>", LONG, "é\U0001f600",
    ]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|text|>"]), rng.choice(texts), 0) for c in [*range(30), None] for t in range(4)]
    rows += [rows[5], rows[5], (40, None, "assistant", "x", 0), (40, 1, "assistant", "y", 0)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, size int")
    out = chat.format_turns(df, "conv_id", ["turn"])
    got = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        mine = sorted(((t is not None, t or 0), role is not None, role or "", text is not None, text or "") for c, t, role, text, _ in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.t] == [(x[2], x[4]) for x in mine]
        assert r.loss == "".join(x[4] for x in mine if x[2] == "assistant")
    formatted = out.select("formatted").first()[0]
    assert "</s>" not in formatted and "[INST]" not in formatted
    assert chat.format_turns(df.limit(0), "conv_id", ["turn"]).count() == 0


def test_leaks_of_edited_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 20, 40, 90]))]) for i in range(60)]
    docs, expected = [], set()
    for share in (0, 0.05, 0.1, 0.2):
        for i, w in items:
            w = list(w)
            for _ in range(int(share * len(w))):
                p = rng.randrange(len(w))
                if rng.random() < 0.7:
                    w[p] = rng.choice(vocabulary)
                else:
                    w.insert(p, rng.choice(vocabulary))
            host = [rng.choice(vocabulary) for _ in range(120)]
            at = rng.choice([0, 60, 120])
            docs.append((len(docs), " ".join(host[:at] + w + host[at:])))
            if share <= 0.1:
                expected.add((len(docs) - 1, i))
    item_rows = [(i, " ".join(w)) for i, w in items] + [(99, "too short"), (98, None), (None, "")]
    b = spark.createDataFrame(item_rows, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    real = {(d, i): brute.edits_in(w, decontaminate.tokens(t)) for d, t in docs for i, w in items}
    real = {k: e for k, e in real.items() if e <= math.floor(0.2 * len(dict(items)[k[1]]) + 1e-9)}
    assert set(got) <= set(real) and all(got[k] == real[k] for k in got)
    assert len(set(got)) >= 0.95 * len(real)
    exact = {k for k, e in real.items() if e == 0}
    assert exact <= set(got) and len(expected & set(real)) > 100


def test_leaks_of_short_items(spark):
    """Per length: every passage of a short item within the allowed edits is found, and nothing else."""
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(500)]
    items, docs = [], []
    for n in range(1, 13):
        for _ in range(25):
            w = [f"i{len(items)}x{j}" for j in range(n)] if n < 10 else [rng.choice(vocabulary) for _ in range(n)]
            items.append((len(items), w))
    for i, w in items:
        for edit in ("none", "change", "insert", "delete"):
            w2, p = list(w), rng.randrange(len(w))
            if edit == "change":
                w2[p] = "zz"
            elif edit == "insert":
                w2.insert(p, "zz")
            elif edit == "delete":
                del w2[p]
            host = [rng.choice(vocabulary) for _ in range(6)]
            at = rng.choice([0, 3, 6])
            docs.append((len(docs), " ".join(host[:at] + w2 + host[at:])))
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    texts, by_length = [t.split(" ") for _, t in docs], {}
    for i, w in items:
        for d in range(4 * i, 4 * i + 4):
            e = brute.edits_in(w, texts[d])
            if e <= math.floor(0.2 * len(w) + 1e-9):
                by_length.setdefault(len(w), []).append(got.get((d, i)) == e)
    assert all(brute.edits_in(items[i][1], texts[d]) == e for (d, i), e in got.items())
    assert sorted(by_length) == list(range(1, 13))
    assert all(all(hits) if n < 10 else sum(hits) / len(hits) >= 0.9 for n, hits in by_length.items())


def test_leaks_without_blanks(spark):
    b = spark.createDataFrame([(1, "東京は日本の首都である"), (2, "ภาษาไทยไม่มีช่องว่าง"), (3, "答え"), (4, "москва")], "item_id long, text string")
    rows = [(1, "質問。東京は日本の首都でした。次"), (2, "xx ภาษาไทยไม่มีช่องว่างyy"), (3, "その答えは"), (4, "город Москва."), (5, "大阪")]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in found} == {(1, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0)}


def test_leaks_awkward(spark, awkward):
    b = spark.createDataFrame([(1, SHARED, 5), (1, SHARED, 5), (2, LONG, 5), (3, None, 5)], "item_id long, text string, size int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(awkward, b).collect()}
    assert got == {(6, 1), (7, 1), (None, 1), (5, 2)}
    leaks = decontaminate.find_leaks(awkward, b)
    # rows without an id are one document, so both of them go
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(awkward, leaks).collect()) == [1, 2, 3, 4, 8, 8, 2**62 + 1]
    assert decontaminate.find_leaks(awkward.limit(0), b).count() == 0
    assert decontaminate.find_leaks(awkward, b.limit(0)).count() == 0


def test_fingerprints_and_next_documents(spark, docs, rows):
    got = {r.doc_id: r for r in parsing.edited_documents(docs).collect()}
    assert len(got) == len(rows)
    for (i, text, _), (j, after, _) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == parsing.fingerprints([text])[0] and r.edited_fingerprint == parsing.fingerprints([edited])[0]
        assert r.near_next == pytest.approx(parsing.likeness(r.fingerprint, got[j].fingerprint))
    long = [r for r in got.values() if r.n_chars > 1000 and r.near_next < 0.9]
    assert np.median([r.near_edited for r in long]) > 0.25 > 0.1 > np.median([r.near_next for r in long])


def test_phrases_do_not_depend_on_offset():
    rng = np.random.default_rng(3)
    body = "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))

    def names(text):
        letters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        out, starts = parsing._LETTER[letters & np.uint32(0xFFFF)], np.array([0])
        for level in (1, 2, 3):
            out, starts = parsing._level(out, starts, parsing._SALT[8 + level])
        return out

    plain, moved = names(body), names("some other beginning " + body + " and end")
    assert len(set(plain) & set(moved)) >= 0.9 * len(plain)


def test_fingerprints_awkward(spark, awkward):
    got = parsing.edited_documents(awkward).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id is None for r in got) == 2
    twice = [r.fingerprint for r in got if r.doc_id == 8]
    assert twice[0] == twice[1]
    alone = parsing.edited_documents(awkward.where("doc_id = 1")).collect()
    assert [r.near_next for r in alone] == [1.0]
    assert parsing.edited_documents(awkward.limit(0)).count() == 0
    plain = parsing.fingerprint_documents(awkward).collect()
    assert sorted(r.fingerprint for r in plain) == sorted(r.fingerprint for r in got)


@pytest.mark.parametrize("seed", [0, 1])
def test_spans_against_brute_force(spark, seed):
    """Passages that nest, overlap, end with their document, repeat inside one and differ by single words."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([30, 50, 51, 80, 200]))] for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(pool))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            if rng.random() < 0.3:
                p = p[rng.randrange(len(p)) :]
            text += p + [f"u{rng.randrange(10**6)}"] * rng.randrange(0, 3)
        rows.append((rng.choice([i, i, i // 2, None]), " ".join(text) if rng.random() < 0.9 else "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(str, (tuple(r) for r in spans.remove_repeated_spans(df).collect())))
    assert got == sorted(map(str, brute.removed_spans(rows)))


def test_spans_awkward(spark, awkward):
    got = [tuple(r) for r in spans.remove_repeated_spans(awkward).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute.removed_spans([r[:2] for r in ROWS])))
    assert spans.remove_repeated_spans(awkward.limit(0)).count() == 0


def test_spans_of_the_tables(spark, docs, rows):
    got = sorted(tuple(r) for r in spans.remove_repeated_spans(docs).collect())
    assert got == sorted(brute.removed_spans([r[:2] for r in rows]))


def token_rows(texts):
    encode, at, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for t in texts:
        ids = encode.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, docs, rows):
    out_dir = scratch_path(spark, "tokens")
    manifest = token_files.write_token_files(docs, queries.tokenizer_path(), out_dir)
    got = sorted(tuple(r) for r in token_files.read_token_files(manifest, out_dir).collect())
    assert got == [(i, *t) for (i, _, _), t in zip(rows, token_rows([t for _, t, _ in rows]))]
    assert manifest.agg(F.sum("docs")).first()[0] == len(rows)


def test_token_files_awkward(spark, awkward):
    odd = ["a  b", " lead", "tail ", "x\n\ny", "\ttab", "a b", "it's 5!", "\x00", "a \n b", "<|endoftext|> c"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    df = awkward.select("doc_id", "text").unionByName(more)
    order = sorted([r[:2] for r in ROWS] + [(100 + i, t) for i, t in enumerate(odd)], key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out_dir = scratch_path(spark, "tokens")
    got = token_files.read_token_files(token_files.write_token_files(df, queries.tokenizer_path(), out_dir), out_dir).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(token_rows([t for _, t in order]))
    assert sorted((r.doc_id for r in got), key=lambda i: (i is None, i or 0)) == [i for i, _ in order]
    out_dir = scratch_path(spark, "tokens")
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), queries.tokenizer_path(), out_dir), out_dir).count() == 0


def test_url_rules(spark):
    given = [
        (1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://notexample.org/es/"), (4, "x"), (5, None), (6, ""),
        (7, "http://com"), (8, "http://a.com/de/1"), (8, "http://a.com/de/1"), (None, "http://b.com/fr/"), (9, "http://É.org/#://z/"), (10, "://?"),
        (11, "http://org/"), (12, "http://.org/es"), (13, "http://" + "a." * 200 + "org/" + "p" * 5000),
    ]
    pages = spark.createDataFrame([(*g, "extra") for g in given], "page_id int, url string, rule string")
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in queries.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    got = [tuple(r) for r in urls.judge_urls(pages, rules).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *judge(u))) for i, u in given)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_jaccard_against_brute_force(spark):
    """Groups of near copies large enough for several blocks, exact copies, short texts and singles."""
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(2000)]
    rows, n = [], 0
    for size, length in ((300, 60), (40, 200), (5, 30), (3, 7)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(60):
        rows.append((n, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))))
        n += 1
    rows += [(n + i, rows[3][1]) for i in range(20)] + [(n + 20, "one two"), (n + 21, "two  one"), (n + 22, "one\ntwo"), (n + 23, "")]
    rng.shuffle(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_classes(rows)


def test_jaccard_awkward(spark, awkward):
    got = near.jaccard_join(awkward).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_links) for r in got}
    assert {(8, 1), (2, 0), (3, 0), (4, 0)} <= by
    assert {r.class_id for r in got if r.doc_id in (6, 7)} == {6}
    kept = near.keep_one_per_class(awkward, near.jaccard_join(awkward))
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 2**62 + 1]
    assert near.jaccard_join(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("size", [10, 13, 14, 20, 27, 35, 54, 70])
def test_walks_reach_the_recall(size):
    """Items with all their edits, at a random place of a text: some key meets, at every length."""
    rng = random.Random(size)
    window, reps = decontaminate.window_of(size), decontaminate.repetitions(decontaminate.TARGET_RECALL, decontaminate.MAX_EDITS)
    found = 0
    for _ in range(150):
        item = [f"w{rng.randrange(5000)}" for _ in range(size)]
        copy = list(item)
        for _ in range(decontaminate.edits_of(size, decontaminate.MAX_EDITS)):
            p = rng.randrange(len(copy))
            copy[p : p + rng.randrange(2)] = [f"x{rng.random()}"[2:]] * rng.randrange(2)
        text = [f"d{i}" for i in range(rng.randrange(40))] + copy + [f"e{i}" for i in range(60)]
        one, two = (decontaminate._padded(decontaminate.word_numbers([" ".join(w)])[0]) for w in (item, text))
        starts = np.arange(len(item) - window + 1), np.arange(0, len(text) - window + 1, max(1, window // 4))
        for rep in range(reps):
            keys = [decontaminate.embed_keys(decontaminate.coins_of(x, rep), s, window, rep)[0] for x, s in zip((one, two), starts)]
            if len(np.intersect1d(*keys)):
                found += 1
                break
    assert found >= 0.95 * 150


def test_word_numbers_are_those_of_the_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ0_éÉß漢字กขのア İ.,-'\u0301\U0001f600\ud800\n") for _ in range(rng.randrange(40))) for _ in range(400)] + [None, ""]
    numbers, counts = decontaminate.word_numbers(texts)
    words = [decontaminate.tokens(t) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    named = dict(zip((w for t in words for w in t), numbers.tolist()))
    assert [named[w] for t in words for w in t] == numbers.tolist() and len(set(named.values())) == len(named)


def test_bands_reach_the_recall():
    for rows in (4, 5, 6):
        missed = (1 - near.THRESHOLD**rows) ** near.bands_for(near.THRESHOLD, 0.999, rows)
        assert missed <= 0.001


def test_licenses_against_brute_force(spark):
    texts = [
        "MIT License", "the mit-license, MIT\nLICENSE mit license", "mit  the license", "licensed under the Apache License, Version 2.0.",
        "GNU General Public License version 3", "general public", None, "", "public license general public license", "MIT Licenseé", "été license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "is hereby granted", LONG + " apache license",
        "license " * 3000, "Licensed under CC BY-NC 4.0", "0 mit license 0",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "mit license", 1), (0, "MIT License", 1)], "doc_id long, text string, words int")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "mit license" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.base_phrases(text, licenses.PHRASES)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    labels = {r.doc_id: r.labels for r in got}
    assert "apache-2.0" in labels[3] and "gpl-3.0" in labels[4] and labels[11] == "mit-text" and "cc-by-nc-4.0" in labels[15] and labels[12] == ""
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licenses_of_the_tables(spark, docs, rows):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: brute.base_phrases(t, licenses.PHRASES) for i, t, _ in rows}


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage on what its predecessor kept: which rows it has to keep, and that its decision took effect."""
    current, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, current, SF_DIR).write.parquet(path)
        current = spark.read.parquet(path)
        kept.append(current)
    good, single, clean, mixed, tokens = kept
    assert all(k.columns == docs.columns for k in kept[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    stayed = {r.doc_id for r in good.collect()}
    fine = [i for i, q in labels.items() if q]
    assert sum(i in stayed for i in fine) >= 0.97 * len(fine) and sum(i in stayed for i, q in labels.items() if not q) <= 0.1 * len(labels)
    classes = brute.jaccard_classes([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in single.collect()} == {c for c, _ in classes.values()}
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before = {r.doc_id: decontaminate.tokens(r.text) for r in single.collect()}
    leaked = {i for i, w in before.items() if any(f" {' '.join(x)} " in f" {' '.join(w)} " for x in items)}
    after = {r.doc_id for r in clean.collect()}
    assert leaked and not leaked & after
    assert all(any(brute.edits_in(x, before[i]) <= 0.2 * len(x) for x in items) for i in set(before) - after)
    want = brute.targets([(r.doc_id, r.text, r.source) for r in clean.collect()])
    taken, longest, texts = Counter(), Counter(), {r.doc_id: r.text for r in clean.collect()}
    for r in mixed.collect():
        taken[r.source] += len(brute.words(r.text))
        longest[r.source] = max(longest[r.source], len(brute.words(r.text)))
        assert r.text == texts[r.doc_id]
    assert all(abs(taken[s] - t) <= max(longest[s], max(len(brute.words(r.text)) for r in clean.where(F.col("source").eqNullSafe(s)).collect())) / 2 + 1 for s, (_, t) in want.items())
    order = sorted(((r.doc_id, r.text) for r in mixed.collect()))
    assert sorted(tuple(r)[1:] for r in tokens.collect()) == sorted(token_rows([t for _, t in order]))


def test_new_words_go_straight_to_the_model(monkeypatch):
    enc, rng = token_files.Encoder(queries.tokenizer_path()), random.Random(3)
    signs = ["a", "é", "Ω", "ʼ", "'s", "'", "ɏ", "ß", "9", "²", "_", "!", "***", "×", "÷", "\n", " ", "  ", "\t", "。", "日", "<|endoftext|>", "z", "́"]
    texts = ["".join(rng.choices(signs[: rng.choice((6, 16, 17, len(signs)))], k=rng.randint(0, 25))) for _ in range(2000)]
    monkeypatch.setattr(token_files, "REMEMBERED", 300)
    for i in range(0, 2000, 50):
        assert enc.encode(texts[i : i + 50]) == [enc.whole(t) for t in texts[i : i + 50]]
    rest = []
    monkeypatch.setattr(enc, "_learn", rest.extend)
    assert enc.encode(["Bonjour été, zwei\nWörter***"])[0] == enc.whole("Bonjour été, zwei\nWörter***") and not rest
