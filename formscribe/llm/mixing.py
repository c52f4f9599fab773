"""Mixing sources to target weights: a hypergeometric splitting tree deals each source's block quota to output shards."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from formscribe.llm.stages import stored
from formscribe.llm.words import WORD, free_name, n_words
from formscribe.session import cut_lineage

#: Words of a block, the unit that is dealt; words of an output shard, about.
BLOCK_WORDS = 1024
SHARD_WORDS = 1 << 20
#: Buckets of a source's documents in which their positions are summed.
BUCKETS = 1024


def sized_documents(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and a digest that tells rows of one id apart; stored, so texts are read once."""
    return cut_lineage(
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("digest"),
        )
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: float = 3.0) -> DataFrame:
    """Per source: source, source_size, weight and target, the words it should give.

    Sources by code point, null last, take the weights in turn. The targets share the sum of all sizes by weight, and
    none exceeds `ceiling` times its source's size: what is over goes to the others by weight until none is above. In
    order of size per weight, a source is capped exactly if its share of what the sources before it leave exceeds its cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).alias("weight"),
    )
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    table = table.select(
        "*",
        (F.col("source_size") * ceiling).alias("cap"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * ceiling).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights_left"),
    )
    level = F.col("left") / F.col("weights_left")
    capped = level * F.col("weight") >= F.col("cap")
    # the first source that is not capped fixes the level for it and all after it
    fixed = F.min(F.when(~capped, F.struct(F.col("source_size") / F.col("weight"), level.alias("level")))).over(every)["level"]
    return table.select("source", "source_size", "weight", F.when(capped, F.col("cap")).otherwise(fixed * F.col("weight")).alias("target"))


def _coin(half: np.ndarray, seed: np.ndarray, r: int) -> np.ndarray:
    f = (half + seed + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return f >> np.uint64(32)


def _walk(at: np.ndarray, n: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """Places of a random order of n blocks to blocks, or back: a Feistel network inside the next even power of two,
    walked on until it lands below n."""
    half = np.maximum(np.ceil(np.log2(np.maximum(n, 2)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.astype(np.uint64), np.arange(len(at))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            if back:
                left, right = right ^ (_coin(left, s, 3 - r) & m), left
            else:
                left, right = right, left ^ (_coin(right, s, r) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _split(quotas: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How much of each quota goes left when `size` of all units do: one multivariate hypergeometric draw."""
    out, rest = np.zeros(len(quotas), dtype=np.int64), int(quotas.sum())
    for i, q in enumerate(quotas):
        rest -= int(q)
        out[i] = size if rest == 0 else _hypergeometric(int(q), rest, size, rng)
        size -= out[i]
    return out


def _hypergeometric(good: int, bad: int, size: int, rng: np.random.Generator) -> int:
    if size == 0 or good == 0:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, size))
    mean = size * good / (good + bad)  # beyond the exact generator's range: the normal limit, kept inside the margins
    var = mean * bad / (good + bad) * (good + bad - size) / (good + bad - 1)
    return int(np.clip(round(rng.normal(mean, var**0.5)), max(0, size - bad), min(good, size)))


def _tree(quotas: np.ndarray, lo: int, hi: int, capacity: np.ndarray, depth: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """Nodes (from shard, to shard, quotas) that are `depth` splits below, or leaves."""
    if hi - lo == 1 or depth == 0:
        return [(lo, hi, quotas)]
    mid = (lo + hi) // 2
    left = _split(quotas, int(capacity[lo:mid].sum()), np.random.default_rng([seed, lo, hi]))
    return _tree(left, lo, mid, capacity, depth - 1, seed) + _tree(quotas - left, mid, hi, capacity, depth - 1, seed)


def _capacity(blocks: int, shards: int) -> np.ndarray:
    return (np.arange(1, shards + 1) * blocks) // shards - (np.arange(shards) * blocks) // shards


def deal_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 0) -> DataFrame:
    """All draws of blocks: source, epoch, block, shard, place (a random place in the shard), words, and rest, the words
    of the source's last epoch if this is a draw of it, null in whole epochs.

    A source of n blocks whose target is t words gives whole epochs, each in a random order of the blocks, and in the last
    its first blocks as far as t reaches, again in a random order: documents stand in random order, so these are a random
    choice of documents and only one of them meets the end. The last of these blocks is cut so that the words are exact to one. The tree splits all quotas between two halves
    of the shards by multivariate hypergeometric draws, again and again; half of the levels in one group, the others in
    one group per node, so a group has as many numbers as sources times the root of the shards. A leaf takes its count
    of blocks as a run of places in the source's order: runs are disjoint, and the random order makes them random.
    """
    B = F.lit(block_words)
    counted = targets.select(
        "source",
        "source_size",
        F.round("target").cast("long").alias("quota"),
        F.ceil(F.col("source_size") / B).cast("long").alias("blocks"),
        F.xxhash64(F.coalesce("source", F.lit("\0null")), F.lit(seed)).alias("seed"),
    ).where("source_size > 0 and quota > 0")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, size, quota = (pdf[c].to_numpy(np.int64) for c in ("blocks", "source_size", "quota"))
            epochs, rest = quota // size, quota % size
            first = -(-rest // block_words)
            reach = np.minimum(first * block_words, size)
            yield pdf.assign(draws=epochs * n + first, cut=reach - rest, rest=rest)

    schema = "source string, source_size long, quota long, blocks long, seed long, draws long, cut long, rest long"
    quotas = counted.mapInPandas(count, schema)

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="root").sort_values(["source", "seed"], na_position="last").reset_index(drop=True)
        total = int((pdf["draws"] * block_words).sum())
        shards = max(1, -(-total // shard_words))
        capacity = _capacity(int(pdf["draws"].sum()), shards)
        depth = (int(shards).bit_length() + 1) // 2
        nodes = _tree(pdf["draws"].to_numpy(np.int64), 0, shards, capacity, depth, seed)
        before = np.zeros(len(pdf), dtype=np.int64)
        out = []
        for lo, hi, q in nodes:
            out.append(pdf.assign(lo=lo, hi=hi, shards=shards, all_draws=int(pdf["draws"].sum()), q=q, before=before))
            before = before + q
        return pd.concat(out)

    columns = schema + ", lo long, hi long, shards long, all_draws long, q long, before long"
    nodes = quotas.withColumn("root", F.lit(0)).groupBy("root").applyInPandas(top, columns)

    def bottom(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "seed"], na_position="last").reset_index(drop=True)
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        capacity = _capacity(int(pdf["all_draws"].iloc[0]), int(pdf["shards"].iloc[0]))
        before, out = pdf["before"].to_numpy(np.int64), []
        for leaf, _, q in _tree(pdf["q"].to_numpy(np.int64), lo, hi, capacity, 64, seed):
            out.append(pdf.assign(shard=leaf, q=q, before=before)[q > 0])
            before = before + q
        return pd.concat(out)[["source", "source_size", "blocks", "seed", "draws", "cut", "rest", "shard", "q", "before"]]

    leaf = "source string, source_size long, blocks long, seed long, draws long, cut long, rest long, shard long, q long, before long"
    leaves = nodes.groupBy("lo").applyInPandas(bottom, leaf)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                for lo in range(0, r.q, 1 << 17):
                    slot = np.arange(r.before + lo, r.before + min(r.q, lo + (1 << 17)))
                    n, epoch = np.full(len(slot), r.blocks), slot // r.blocks
                    last = (epoch == (r.draws - 1) // r.blocks) & (r.rest > 0)
                    some = (r.draws - 1) % r.blocks + 1
                    block = _walk(slot % r.blocks, np.where(last, some, n), _seeds(np.full(len(slot), r.seed), epoch))
                    words = np.where(block == r.blocks - 1, r.source_size - (r.blocks - 1) * block_words, block_words)
                    words = words - np.where(last & (block == some - 1), r.cut, 0)
                    place = _seeds(np.full(len(slot), r.seed + 1), slot).view(np.int64)
                    out = {"source": r.source, "epoch": epoch, "block": block, "shard": r.shard, "place": place, "words": words}
                    yield pd.DataFrame(out).assign(rest=pd.Series(np.where(last, r.rest, 0)).astype("Int64").mask(~last))

    # leaves are few and small, draws are many: a stated number of tasks, which adaptive execution does not merge
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaves.repartition(tasks, "shard", "source")
    return dealt.mapInPandas(draw, "source string, epoch long, block long, shard long, place long, words long, rest long")


def _seeds(seed: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = seed.astype(np.int64).view(np.uint64) + (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))


def place_documents(sizes: DataFrame, block_words: int = BLOCK_WORDS, buckets: int = BUCKETS, seed: int = 0) -> DataFrame:
    """Where every document with words begins in its source, and the block that holds it: the one in which it begins.

    A source's documents stand in hash order. Positions are prefix sums in two steps, over the sums of `buckets` hash
    buckets and inside each bucket, so no task holds a whole source.
    """
    rows = sizes.where("size > 0").withColumn("hash", F.xxhash64("doc_id", "digest", F.lit(seed)))
    rows = rows.withColumn("bucket", F.pmod(F.col("hash"), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(offset, F.lit(0)).alias("offset"))
    inside = F.sum("size").over(
        W.partitionBy("source", "bucket").orderBy("hash", "doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    )
    placed = (
        rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("begin", F.col("offset") + F.col("inside"))
    )
    block = F.floor(F.col("begin") / block_words)
    return placed.select("source", "doc_id", "digest", "size", "begin", block.alias("block"), (F.col("begin") - block * block_words).alias("at"))


def mix_pieces(
    sizes: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 0,
    whole: bool = False,
) -> DataFrame:
    """The mix as drawn documents: shard, place, at, source, doc_id, digest, epoch and words, the first of the document.

    A row per document and epoch. Only the document that meets the end of its source's last epoch may have fewer words
    than its size, so that targets are met to one word; with `whole` it is taken as it is if at least half of it lies
    before that end and left out otherwise, so no document is cut and targets are met to half of one document. Inside a
    shard, blocks stand by `place`, documents by `at`.
    """
    draws = deal_blocks(targets, block_words, shard_words, seed).select(
        F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "shard", "place", "rest"
    )
    # stored, so that the join goes by how many draws there are, not by a guess from the leaves
    draws = stored(draws, "block-draws")
    joined = place_documents(sizes, block_words, seed=seed).join(
        draws, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    )
    left = F.col("rest") - F.col("begin")
    some = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else F.least(F.col("size"), left)
    words = F.when(F.col("rest").isNull(), F.col("size")).otherwise(some)
    return joined.select(
        "shard", "place", "at", "source", "doc_id", "digest", "epoch", words.alias("words")
    ).where("words > 0")


def mix_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 0, whole: bool = False,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes of it; shard, place and at,
    where it first stands in the output (shards are dealt by the tree, blocks stand by place in their shard, documents by
    at in their block), null if it is not taken.

    Null texts have no words; null sources are one source; null ids and repeated rows are documents of their own, and
    rows that are equal in id, source and text share their draws evenly to one draw. A source without words has target 0.
    With `whole`, taken is a multiple of size. Texts are counted whole, however long; other columns are not looked at.
    Reruns agree. An empty table gives no rows.
    """
    sizes = sized_documents(documents, id_col, text_col, source_col)
    targets = cut_lineage(source_targets(sizes))
    key = ["source", "doc_id", "digest"]
    pieces = mix_pieces(sizes, targets, block_words, shard_words, seed, whole)
    taken = pieces.groupBy(*key).agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "place", "at")).alias("first"))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in key], "taken", "first")
    copies = W.partitionBy(*key)
    joined = (
        sizes.withColumn("n", F.count(F.lit(1)).over(copies))
        .withColumn("k", F.row_number().over(copies.orderBy("size")))
        .join(taken, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in key], "left")
        .join(targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")), "left")
    )
    draws = F.floor(F.col("taken") / F.col("size"))
    share: Column = F.floor(F.col("k") * draws / F.col("n")) - F.floor((F.col("k") - 1) * draws / F.col("n"))
    share = share * F.col("size") + F.when(F.col("k") == 1, F.col("taken") % F.col("size")).otherwise(0)
    share = F.coalesce(share, F.lit(0)).cast("long")
    first = [F.when(share > 0, F.col("first")[c]).alias(c) for c in ("shard", "place", "at")]
    return joined.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", share.alias("taken"), *first)


def mixed_rows(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 0, whole: bool = False,
    chars_col: str = "n_chars",
) -> DataFrame:
    """The mix as rows with the columns of `documents`: one per document and epoch that takes words of it, dealt to tasks by
    shard and sorted by shard, place in the shard and place in the block, so that writing them writes the shards.

    A document that is taken whole keeps its text, and with `whole` every one is. Otherwise one document of a source may
    be cut so that the target is met to one word: it keeps its first words, and `chars_col`, if there is one, their
    length. Other columns stay as they are, whatever their names; rows that are equal in id, source and text come once per
    copy and epoch, with the other columns of one of them. Rows without words are not in a mix. Texts of any length are
    moved whole.
    """
    sizes = sized_documents(documents, id_col, text_col, source_col)
    names = ("source", "doc_id", "digest", "words", "shard", "place", "at")
    new = {n: free_name(documents, f"m_{n}") for n in (*names, "text")}
    drawn = mix_pieces(sizes, cut_lineage(source_targets(sizes)), block_words, shard_words, seed, whole).select(
        *[F.col(n).alias(new[n]) for n in names]
    )
    rows = documents.withColumn(new["text"], F.xxhash64(text_col))
    match = (
        F.col(id_col).cast("long").eqNullSafe(F.col(new["doc_id"]))
        & F.col(source_col).cast("string").eqNullSafe(F.col(new["source"]))
        & (F.col(new["text"]) == F.col(new["digest"]))
    )
    rows = rows.dropDuplicates([id_col, source_col, new["text"]]).join(drawn, match)
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, new["shard"]).sortWithinPartitions(new["shard"], new["place"], new["at"])
    if whole:
        return rows.select(*documents.columns)
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    cut = F.array_join(F.slice(tokens, F.lit(1), F.col(new["words"]).cast("int")), "")
    cut = F.when(F.col(new["words"]) < n_words(F.col(text_col)), cut)
    changed = {text_col: F.coalesce(cut, text_col)}
    if chars_col in documents.columns:
        kind = documents.schema[chars_col].dataType
        changed[chars_col] = F.when(cut.isNull(), F.col(chars_col)).otherwise(F.length(cut).cast(kind))
    return rows.withColumns(changed).select(*documents.columns)
