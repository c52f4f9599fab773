"""Source divergence audit: how far the word shares of a language's sources lie apart, and which words make a source odd.

Words are counted by sorting pointers to their first bytes in the Arrow buffer; equal runs give documents and occurrences.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from formscribe.llm.stages import stored
from formscribe.llm.terms import LETTERS, spans, text_slices

#: Documents of a language that a kept term stands in at least; terms shown per group.
LEAST_DOCS, SHOWN = 10, 10
#: Shares are whole parts of this, after `PRIOR` occurrences are added to every term.
UNIT, PRIOR = 1_000_000_000, 2
#: Bytes that one round of the sort looks at, and rounds after which the few terms left are compared as Python bytes.
WIDTH, ROUNDS = 8, 8
#: Bytes of text whose pointers are sorted together: more put equal terms together before they are shuffled.
SORTED_BYTES = 1 << 23
#: Cells of the (term, source) table that one task holds when two sources are compared.
CELLS = 1 << 21

_MASKS = np.array([0, *[(0xFFFFFFFFFFFFFFFF << (64 - 8 * i)) & 0xFFFFFFFFFFFFFFFF for i in range(1, 9)]], dtype=np.uint64)


def sorted_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, and for each place the number of its run of equal terms.

    A multikey quicksort on slices of eight bytes: pointers are ordered by their first slice, and only runs that are equal
    so far and hold longer terms are ordered by the next one. Slices end with their term, so shorter terms come first.
    """
    padded = np.concatenate((data, np.zeros(WIDTH, dtype=np.uint8)))
    words = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded.data, strides=(1,))

    def sliced(pointers: np.ndarray, depth: int) -> np.ndarray:
        rest = np.clip(length[pointers] - depth * WIDTH, 0, WIDTH)
        at = np.minimum(start[pointers] + depth * WIDTH, len(data))
        return words[at].astype(np.uint64) & _MASKS[rest]

    key = sliced(np.arange(len(start)), 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    depth = 1
    while True:
        run = np.cumsum(new) - 1
        longest = np.maximum.reduceat(length[order], np.flatnonzero(new)) if len(order) else length
        size = np.bincount(run)
        open_run = (longest > depth * WIDTH) & (size > 1)
        places = np.flatnonzero(open_run[run]) if len(order) else order
        if not len(places):
            return order, run
        pointers, group = order[places], run[places]
        if depth < ROUNDS:
            key = sliced(pointers, depth)
            by = np.lexsort((key, group))
            same = key[by][1:] == key[by][:-1]
        else:
            rests = [data[s + depth * WIDTH : s + n].tobytes() for s, n in zip(start[pointers], length[pointers])]
            by = np.array(sorted(range(len(rests)), key=lambda i: (group[i], rests[i])))
            same = np.array([rests[i] == rests[j] for i, j in zip(by[1:], by)], dtype=bool)
        order[places] = pointers[by]
        new[places[1:]] = ~same | (group[by][1:] != group[by][:-1])
        if depth == ROUNDS:
            return order, np.cumsum(new) - 1
        depth += 1


def _counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term, group, documents, occurrences) of a slice of texts; `group` is the group of each text."""
    start, length, row = spans(data, offsets, LETTERS)
    order, run = sorted_runs(data, start, length)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    heads = order[first]
    ends = np.cumsum(length[heads])
    parts = np.concatenate([data[s : s + n] for s, n in zip(start[heads], length[heads])]) if len(heads) else data[:0]
    offs = np.concatenate(([0], ends)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(heads), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(parts.tobytes())])
    texts = len(offsets) - 1
    pair, times = np.unique(run * texts + row[order], return_counts=True)
    groups = int(group.max()) + 1
    cell, inverse = np.unique(pair // texts * groups + group[pair % texts], return_inverse=True)
    return terms, cell // groups, cell % groups, np.bincount(inverse, minlength=len(cell)), np.bincount(inverse, times, len(cell)).astype(np.int64)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n), stored, from rows (lang, source, text) without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pd.DataFrame({"lang": batch["lang"].to_pandas(), "source": batch["source"].to_pandas()})
            for row, data, offsets in text_slices(batch["text"], SORTED_BYTES):
                part = named.iloc[row : row + len(offsets) - 1]
                group = part.groupby(["lang", "source"], sort=False).ngroup().to_numpy()
                names = part.iloc[np.unique(group, return_index=True)[1]]
                terms, term, g, docs, n = _counted(data, offsets, group)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array(names["lang"].to_numpy()[g], pa.string()),
                        "source": pa.array(names["source"].to_numpy()[g], pa.string()),
                        "term": terms.take(pa.array(term)).cast(pa.string()),
                        "docs": pa.array(docs, pa.int64()),
                        "n": pa.array(n, pa.int64()),
                    }
                )

    counted = documents.mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return stored(counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "term-counts")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers of up to 38 digits."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, below)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _common(table: pa.Table) -> pa.Table:
    """Of one slice of terms: for each two sources (one < other) the sum over terms of both, of their gap less what it would
    be if either had none of the term, plus what it would be if neither had."""
    codes, names = pd.factorize(table["source"].to_pandas())
    term, _ = pd.factorize(table["term"].to_pandas())
    p = np.zeros((term.max() + 1, len(names)), dtype=np.int64)
    p[term, codes] = table["p"].to_numpy()
    none = np.zeros(len(names), dtype=np.int64)
    none[codes] = table["none"].to_numpy()

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b) * (a - b) // (a + b)

    out = []
    for i in range(len(names)):
        rows = p[:, i] > 0
        mine, theirs = p[rows, i][:, None], p[rows]
        each = apart(mine, theirs) - apart(mine, none[None, :]) - apart(none[i], theirs) + apart(none[i], none)[None, :]
        sums = np.where(theirs > 0, each, 0).sum(axis=0)
        met = np.flatnonzero((theirs > 0).any(axis=0))
        out += [(names[i], names[j], int(sums[j])) for j in met if names[i] < names[j]]
    return pa.table(
        {
            "lang": pa.array([table["lang"][0].as_py()] * len(out), pa.string()),
            "one": pa.array([x[0] for x in out], pa.string()),
            "other": pa.array([x[1] for x in out], pa.string()),
            "both": pa.array([x[2] for x in out], pa.int64()),
        }
    )


def source_divergence(
    documents: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    shown: int = SHOWN,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` holds each other source of the language by the distance of
    their word shares, part `term` the terms that a source uses more than its language does, at most `shown`.

    Terms are runs of letters (all characters beyond ASCII are letters), A-Z lower-cased, that stand in `least_docs`
    documents of the language or more. Ranks follow value (falling) and item (by UTF-8 bytes), so ties have one order.
    Null text, language and source are empty strings; a row is a document, also if it is repeated. Sources without
    any term have pairs and no terms; a language without kept terms gives pairs of value 0. An empty table gives no rows.
    Texts of any length are read whole, a slice of its own each if long. Other columns are not looked at.

    One pass counts terms. Two sources are compared over the terms of both alone; what one of them lacks follows
    from how often it has each count (`histogram`), so the work grows with the counts that occur, not with terms times pairs.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = documents.select(*texts)
    counts = term_counts(rows)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    kept = stored(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    cells = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "term-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total")
        .withColumn("none", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1)))
    )
    groups = stored(groups, "source-groups")
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    odd = shares.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    odd = odd.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)

    # a slice holds all rows of its terms: as many slices as keep terms times sources small
    slices = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / CELLS)).cast("int")
    sliced = shares.join(sources, "lang").select("lang", F.pmod(F.xxhash64("term"), slices).alias("slice"), "term", "source", "p", "none")
    both = sliced.groupBy("lang", "slice").applyInArrow(_common, "lang string, one string, other string, both long")
    both = both.groupBy("lang", "one", "other").agg(F.sum("both").alias("both"))

    histogram = shares.groupBy("lang", "source", "n", "p", "none").agg(F.count(F.lit(1)).alias("times"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("their_none"))
    lone = (
        histogram.join(others, "lang").where("source != item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.col("times") * (gap(F.col("p"), F.col("their_none")) - gap(F.col("none"), F.col("their_none")))).alias("lone"))
    )
    lone = stored(lone, "lone-terms")
    pairs = (
        groups.select("lang", "source", "terms", "none").join(others, "lang").where("source != item")
        .withColumn("one", F.least("source", "item")).withColumn("other", F.greatest("source", "item"))
        .join(both, ["lang", "one", "other"], "left")
        .join(lone, ["lang", "source", "item"], "left")
        .join(lone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("lone").alias("their_lone")), ["lang", "source", "item"], "left")
    )
    value = F.col("terms") * gap(F.col("none"), F.col("their_none"))
    for part in ("both", "lone", "their_lone"):
        value = value + F.coalesce(part, F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(odd)
