"""Substring dedup over a sparse de Bruijn graph: sampled k-mers are nodes, what lies between two is an edge, paths that do
not branch off from their first source compact into one span, and source coordinates check what lies beside them."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from formscribe.llm.hashing import span_hashes, chunks, mix, window_hashes, word_hashes
from formscribe.llm.stages import stored

#: Words of a repeated span at least, and of a k-mer. Every span holds a sampled k-mer.
SPAN, K = 50, 18
#: Stands for a null document id, which comes after all others.
LAST = 2**63 - 1
_PLACE_BITS = 26


def _nodes(grams: np.ndarray, counts: np.ndarray, runs: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of `span` words: the text that it lies in, and its node, a place of its least k-mer.

    Both windows and k-mers are numbered through all texts; `runs` counts the k-mers of each text.
    """
    width = span - k + 1
    windows = np.maximum(runs - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    if not len(owner):
        return owner, owner
    place = np.uint64((1 << _PLACE_BITS) - 1)
    number = np.arange(len(grams), dtype=np.uint64)
    first = np.repeat(np.cumsum(runs) - runs, windows) + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    node = (_least(grams & ~place | number, width)[first] & place).astype(np.int64)
    last = (place - (_least(grams & ~place | (place - number), width)[first] & place)).astype(np.int64)
    # equal least k-mers in one window: stay with the one of the window before, or take the last, which stays longest
    for w in np.flatnonzero(node != last):
        before = node[w - 1] if w and owner[w - 1] == owner[w] else -1
        kept = before >= first[w] and (grams[before] ^ grams[node[w]]) & ~place == 0
        node[w] = before if kept else last[w]
    return owner, node


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _graph(texts: list, span: int, k: int) -> dict:
    """Words, k-mers, windows and nodes of a chunk of texts."""
    words, counts = word_hashes(texts)
    grams, runs = window_hashes(words, counts, k)
    owner, node = _nodes(grams, counts, runs, span, k)
    return {
        "words": words, "counts": counts, "grams": grams, "owner": owner, "node": node,
        "first_word": np.cumsum(counts) - counts, "first_gram": np.cumsum(runs) - runs,
    }


def node_table(rows: DataFrame, span: int, k: int) -> DataFrame:
    """Every node of every text: its k-mer, where it is (id, text_hash, i, word), and the edge that leaves it.

    An edge is the hash of all words from one node to the end of the next, or to the end of the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts, 1 << 19):
                g = _graph(texts[lo:hi], span, k)
                if not len(g["owner"]):
                    continue
                new = np.ones(len(g["node"]), dtype=bool)
                new[1:] = g["node"][1:] != g["node"][:-1]
                node, owner = g["node"][new], g["owner"][new]
                word = node - g["first_gram"][owner]
                start = word + g["first_word"][owner]
                same = np.append(owner[1:] == owner[:-1], False)
                end = np.where(same, np.append(start[1:], 0) + k, g["first_word"][owner] + g["counts"][owner])
                edge = mix(span_hashes(g["words"], start, end, 1))
                ranks = np.arange(len(node)) - np.searchsorted(owner, owner)
                part = pdf.iloc[lo:hi]
                yield pd.DataFrame(
                    {
                        "kmer": g["grams"][node].view(np.int64), "id": part["id"].to_numpy()[owner], "text_hash": part["text_hash"].to_numpy()[owner],
                        "i": ranks.astype(np.int32), "word": word.astype(np.int32), "edge": edge.view(np.int64),
                    }
                )

    return rows.mapInPandas(run, "kmer long, id long, text_hash long, i int, word int, edge long")


def repeated_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose k-mer stands in documents of two ids: per text (id, text_hash) the list of i, word, the first place of
    the k-mer (source, source_hash, source_word) and whether the same edge leaves it there."""
    stats = nodes.groupBy("kmer").agg(F.min(F.struct("id", "text_hash", "word", "edge")).alias("s"), F.max("id").alias("most"))
    stats = stats.where("s.id < most").select(F.col("kmer").alias("s_kmer"), "s")
    joined = nodes.join(stats, F.col("kmer") == F.col("s_kmer"))
    at = F.struct(
        "i",
        "word",
        F.col("s.id").alias("source"),
        F.col("s.text_hash").alias("source_hash"),
        F.col("s.word").alias("source_word"),
        (F.col("s.edge") == F.col("edge")).alias("goes_on"),
    )
    return joined.groupBy(F.col("id").alias("n_id"), F.col("text_hash").alias("n_hash")).agg(F.collect_list(at).alias("nodes"))


def _decide(nodes: list, me: int, g: dict, t: int, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (by first word) of one text that are repeated for sure, those that have to be compared, and those that no
    smaller id can hold but others may.

    Nodes whose first places follow each other in one text of a smaller id, by equal edges and at equal distances, are a
    path that both texts hold word by word: every window inside is repeated. Other windows whose node stands in two
    documents are compared; that text of the smallest id which holds a window never decides it and so offers it.
    """
    lo, hi = np.searchsorted(g["owner"], (t, t + 1))
    window, at = np.arange(hi - lo), g["node"][lo:hi] - g["first_gram"][t]
    every = np.unique(at)
    table = sorted({(n["i"], n["word"], n["source"], n["source_hash"], n["source_word"], n["goes_on"]) for n in nodes})
    i, word, source, source_hash, source_word, goes_on = np.array(table, dtype=np.int64).T
    n = np.minimum(np.searchsorted(word, at), len(word) - 1)
    known, again = word[n] == at, source[n] < me
    joined = (np.diff(i) == 1) & (goes_on[:-1] == 1) & (np.diff(source) == 0) & (np.diff(source_hash) == 0) & (np.diff(source_word) == np.diff(word))
    path = np.concatenate(([0], np.cumsum(~joined)))
    first = word[np.searchsorted(path, np.arange(path[-1] + 1))]
    last = np.searchsorted(path, np.arange(path[-1] + 1), side="right") - 1
    after = np.where(i + 1 < len(every), every[np.minimum(i + 1, len(every) - 1)] + k, g["counts"][t])
    end = np.where(goes_on == 1, after, word + k)[last]
    smaller = source[last] < me
    first, end = first[smaller], np.maximum.accumulate(end[smaller])
    if not len(first):
        return window[:0], window[known & again], window[known & ~again]
    path_of = np.searchsorted(first, window, side="right") - 1
    sure = known & (path_of >= 0) & (window + span <= end[np.maximum(path_of, 0)])
    return window[sure], window[known & again & ~sure], window[known & ~again & ~sure]


def _result(words: list[bytes], starts: np.ndarray, span: int) -> tuple[int, int, str]:
    cover = np.zeros(len(words) + 1, dtype=np.int32)
    if len(starts):
        np.add.at(cover, starts, 1)
        np.add.at(cover, np.minimum(starts + span, len(words)), -1)
    gone = np.cumsum(cover)[:-1] > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g] if len(starts) else words
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def _bytes(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def remove_repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256, after every word under a repeated window is removed.

    A window is `span` consecutive words; it is repeated if its words also start in a document with a smaller id. Words
    are runs without blanks, tabs and line breaks, kept as they are; kept words are joined by one blank. All windows are
    judged on the input.

    Each window's least k-mer is a node of the graph; equal windows have equal nodes, so one shuffle of the nodes (two of
    `span` - k + 2 words) finds all that can repeat. Nodes that follow their first source without branching off compact
    into paths, which decide all windows inside; only windows beside paths, and those of the sources, are compared one by
    one, by 128-bit hashes of their words. The texts are shuffled once, to meet their nodes.

    Null and empty texts have no words; shorter texts keep all. Null ids come last: their windows are removed if a
    document with an id has them, and they remove nothing from each other. Rows of one id never remove from each other.
    Each input row gives one row. Texts are read whole, up to 2^26 words each; other columns are not looked at. An empty
    table gives no rows.
    """
    rows = documents.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.col(id_col).isNull().alias("no_id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    nodes = stored(repeated_nodes(node_table(rows.select("id", "text_hash", "text"), span, k)), "nodes")
    met = rows.join(nodes, (F.col("id") == F.col("n_id")) & (F.col("text_hash") == F.col("n_hash")), "left").select(*rows.columns, "nodes")
    schema = (
        "id long, no_id boolean, text_hash long, n_words long, n_removed long, kept_sha256 string, "
        "text string, sure array<int>, window array<int>, h1 array<long>, h2 array<long>, s1 array<long>, s2 array<long>"
    )
    names = schema.replace(",", "").split()[::2][3:]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts, 1 << 19):
                part = pdf.iloc[lo:hi]
                with_nodes = [t for t, n in enumerate(part["nodes"]) if n is not None]
                place = {t: x for x, t in enumerate(with_nodes)}
                g = _graph([texts[lo + t] for t in with_nodes], span, k)
                out = [row(texts[lo + t], n, int(part["id"].iloc[t]), g, place.get(t)) for t, n in enumerate(part["nodes"])]
                done = pd.DataFrame(out, columns=names).astype({"n_words": "int64", "n_removed": "Int64"})
                yield pd.concat([part[["id", "no_id", "text_hash"]].reset_index(drop=True), done], axis=1)

    def row(text: str, nodes_of: list | None, me: int, g: dict, x: int | None) -> tuple:
        """Result of a text that is decided, or what has to be compared; in both cases the hashes others may need."""
        words, none = _bytes(text), np.array([], dtype=np.int64)
        if nodes_of is None:
            return (*_result(words, none, span), None, None, None, None, None, None, None)
        sure, compared, offered = _decide(nodes_of, me, g, x, span, k)
        own = g["words"][g["first_word"][x] : g["first_word"][x] + g["counts"][x]]
        other = mix(own)
        h1, s1 = (mix(span_hashes(own, w, w + span, 0)).view(np.int64) for w in (compared, offered))
        h2, s2 = (mix(span_hashes(other, w, w + span, 1)).view(np.int64) for w in (compared, offered))
        if not len(compared):
            return (*_result(words, sure, span), None, None, None, None, None, s1, s2)
        return (len(words), None, None, text, sure.astype(np.int32), compared.astype(np.int32), h1, h2, s1, s2)

    stage = stored(met.mapInPandas(decide, schema), "spans")

    opened = stage.where("window is not null")
    each = opened.select("id", "text_hash", F.explode(F.arrays_zip("window", "h1", "h2")).alias("w"))
    each = each.select("id", "text_hash", "w.window", "w.h1", "w.h2")
    offered = stage.select("id", F.explode(F.arrays_zip("s1", "s2")).alias("w")).select("id", "w.s1", "w.s2")
    held = each.select("id", "h1", "h2").unionByName(offered.toDF("id", "h1", "h2"))
    least = held.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    least = least.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "least")
    again = (
        each.join(least, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")) & (F.col("least") < F.col("id")))
        .groupBy(F.col("id").alias("a_id"), F.col("text_hash").alias("a_hash"))
        .agg(F.collect_list("window").alias("again"))
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, sure, more in zip(pdf["text"], pdf["sure"], pdf["again"]):
                starts = np.unique(np.concatenate((np.asarray(sure, dtype=np.int64), np.asarray(more if more is not None else [], dtype=np.int64))))
                out.append(_result(_bytes(text), starts, span))
            yield pd.concat(
                [pdf[["id", "no_id"]], pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"], index=pdf.index)], axis=1
            )

    final = "id long, no_id boolean, n_words long, n_removed long, kept_sha256 string"
    late = (
        opened.select("id", "no_id", "text_hash", "text", "sure")
        .join(again, (F.col("id") == F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")), "left")
        .select("id", "no_id", "text", "sure", "again")
        .mapInPandas(finish, final)
    )
    early = stage.where("window is null").select("id", "no_id", "n_words", "n_removed", "kept_sha256")
    return early.unionByName(late).select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_col), "n_words", "n_removed", "kept_sha256"
    )
