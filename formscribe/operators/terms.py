"""Word n-gram tf-idf per key, built relationally."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions.text import WORD, let
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import PRUNED_BEFORE_SHUFFLE, top_per_group
from formscribe.operators.vectors import value_id


#: Words whose n-grams a task counts at a time; a longer value is counted alone.
SLICE_WORDS = 1 << 19


def word_ngrams(value: Column, low: int, high: int) -> Column:
    """All n-grams of the lower-cased words of two or more word characters."""

    def grams(words: Column) -> Column:
        def of_size(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
            cut = F.transform(starts, lambda i: F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(n)]))
            return F.when(F.size(words) >= n, cut).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[of_size(n) for n in range(low, high + 1)]))

    return let(F.regexp_extract_all(F.lower(value), F.lit(f"[{WORD}]{{2,}}"), F.lit(0)), grams)


def char_ngrams(value: Column, low: int, high: int) -> Column:
    """Character n-grams, for short values without word pairs."""

    def grams(lowered: Column) -> Column:
        def of_size(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.length(lowered) - (n - 1))
            cut = F.transform(starts, lambda i: F.substr(lowered, i, F.lit(n)))
            return F.when(F.length(lowered) >= n, cut).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[of_size(n) for n in range(low, high + 1)]))

    return let(F.lower(value), grams)


def term_counts(values: DataFrame, settings: Settings = Settings(), analyzer: str = "word", per_value: bool = True) -> DataFrame:
    """(key, id, n, term, tf) of distinct values; n is how often the value occurs.

    All terms of a value are in its row, so they are counted there and no occurrence is moved. Without `per_value` the rows
    are (key, term, n, total), summed over the values that a task holds at a time: for tables whose values have many terms
    when nothing is asked of a single value.
    """
    if not per_value:
        return _term_totals(values, settings, analyzer)
    ngrams = word_ngrams if analyzer == "word" else char_ngrams
    grams = ngrams(F.col("value"), settings.ngram_min, settings.ngram_max)
    # the id is computed below the explode; beside it, the text would be carried and hashed once per term
    cut = values.select(KEY, value_id(F.col("value")).alias("id"), "n", _counted(grams).alias("grams"))
    return cut.select(KEY, "id", "n", F.explode("grams").alias("g")).select(KEY, "id", "n", "g.term", "g.tf")


def _term_totals(values: DataFrame, settings: Settings, analyzer: str) -> DataFrame:
    """(key, term, n, total): in how many values (as often as they occur) and how often in all, per slice of a task.

    A word gets a number, an n-gram one from the number of its beginning and of its last word; texts of terms are put
    together once per slice and key.
    """
    low, high = settings.ngram_min, settings.ngram_max
    unit, glue = (f"[{WORD}]{{2,}}", " ") if analyzer == "word" else ("(?s).", "")
    words = F.regexp_extract_all(F.lower("value"), F.lit(unit), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_WORDS, "right")))
                yield from _slice_totals(batch.slice(begin, end - begin), low, high, glue)
                begin = end

    return values.select(KEY, "n", words.alias("words")).mapInArrow(run, f"{KEY} string, term string, n long, total long")


def _slice_totals(batch: pa.RecordBatch, low: int, high: int, glue: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy()
    words = batch.column("words").flatten()
    keys = pc.dictionary_encode(batch.column(KEY), null_encoding="encode")
    key, times = keys.indices.to_numpy().astype(np.int64), batch.column("n").to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    # words from here to the end of the value
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))
    numbers = pc.dictionary_encode(words)
    word, different = numbers.indices.to_numpy().astype(np.int64), len(numbers.dictionary)
    gram, grams = word.copy(), different
    for size in range(1, high + 1):
        at = np.flatnonzero(left >= size)
        if not len(at):
            return
        if size > 1:
            gram[at], found = pd.factorize(gram[at] * different + word[at + size - 1])
            grams = len(found)
        if size < low:
            continue
        place = key[row[at]] * grams + gram[at]
        order = np.argsort(place, kind="stable")
        place, at = place[order], at[order]
        mine = row[at]
        first = np.concatenate([[True], place[1:] != place[:-1]])
        once = first | np.concatenate([[True], mine[1:] != mine[:-1]])
        begins, weight = np.flatnonzero(first), times[mine]
        head = at[begins]
        pieces = [words.take(pa.array(head + j)) for j in range(size)]
        yield pa.record_batch(
            {
                KEY: keys.dictionary.take(pa.array(key[row[head]])),
                "term": pc.binary_join_element_wise(*pieces, glue) if size > 1 else pieces[0],
                "n": np.add.reduceat(np.where(once, weight, 0), begins),
                "total": np.add.reduceat(weight, begins),
            }
        )


def _counted(terms: Column) -> Column:
    """array<struct<term, tf>> of the different terms: the runs of the sorted array."""

    def runs(ordered: Column) -> Column:
        def last(i: Column) -> Column:
            return (i == F.size(ordered)) | (F.get(ordered, i - 1) != F.get(ordered, i))

        def entries(ends: Column) -> Column:
            return F.transform(
                ends,
                lambda end, j: F.struct(
                    F.get(ordered, end - 1).alias("term"),
                    (end - F.coalesce(F.get(ends, j - 1), F.lit(0))).cast("long").alias("tf"),
                ),
            )

        # sequence(1, 0) would count down
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered))).otherwise(F.array().cast("array<int>"))
        return let(F.filter(places, last), entries)

    return let(F.array_sort(terms), runs)


def vocabulary(values: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Kept terms per key: idx (rarest first), term, df, idf. At most `max_features` by total frequency.

    Repeated values count as often as they occur, although each was cut into terms once. `counts` are those of the values
    or sums over some of them.
    """
    documents = values.groupBy(KEY).agg(F.sum("n").alias("docs"))
    occurrences = F.col("total") if "total" in counts.columns else F.col("tf") * F.col("n")
    frequency = counts.groupBy(KEY, "term").agg(F.sum("n").alias("df"), F.sum(occurrences).alias("total"))
    allowed = frequency.join(documents, KEY).where(
        (F.col("df") <= settings.max_df * F.col("docs")) & (F.col("df") >= settings.min_df)
    )
    if settings.max_features > PRUNED_BEFORE_SHUFFLE:
        allowed = _above_floor(allowed, settings.max_features)
    kept = top_per_group(allowed, [KEY], [F.col("total").desc(), F.col("term")], settings.max_features)
    # at most max_features rows per key reach this window
    rarest = W.partitionBy(KEY).orderBy("df", "term")
    idf = F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0
    return kept.select(KEY, "term", "df", idf.alias("idf"), (F.row_number().over(rarest) - 1).alias("idx"))


def _above_floor(terms: DataFrame, k: int) -> DataFrame:
    """Terms with one of the k largest totals of their key, all ties included. Most terms are rare and are never sorted."""
    sizes = terms.groupBy(KEY, "total").agg(F.count(F.lit(1)).alias("_n"))
    larger = W.partitionBy(KEY).orderBy(F.col("total").desc()).rowsBetween(W.unboundedPreceding, -1)
    reached = sizes.withColumn("_larger", F.coalesce(F.sum("_n").over(larger), F.lit(0))).where(F.col("_larger") < k)
    floors = reached.groupBy(KEY).agg(F.min("total").alias("_floor"))
    return terms.join(floors, KEY).where(F.col("total") >= F.col("_floor")).drop("_floor")


def term_weights(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, id, n, term, idx, w): tf-idf weights, L2-normalised per value."""
    weighted = counts.join(terms.select(KEY, "term", "idx", "idf"), [KEY, "term"])
    weighted = weighted.withColumn("raw", F.col("tf") * F.col("idf"))
    lengths = weighted.groupBy(KEY, "id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("len"))
    return weighted.join(lengths, [KEY, "id"]).select(KEY, "id", "n", "term", "idx", (F.col("raw") / F.col("len")).alias("w"))


def tfidf_rows(values: DataFrame, settings: Settings = Settings(), analyzer: str = "word") -> tuple[DataFrame, DataFrame]:
    """(rows, terms). rows: key, id, value, n, idx array<int>, w array<double>, sorted by idx; a value
    without kept terms has empty arrays. A row holds at most `max_features` entries."""
    counts = term_counts(values, settings, analyzer)
    terms = vocabulary(values, counts, settings)
    entry = F.array_sort(F.collect_list(F.struct("idx", "w")))
    packed = term_weights(counts, terms).groupBy(KEY, "id").agg(entry.alias("e"))
    named = values.withColumn("id", value_id(F.col("value")))
    joined = named.join(packed, [KEY, "id"], "left")
    rows = joined.select(
        *named.columns,
        F.coalesce(F.col("e.idx"), F.array().cast("array<int>")).alias("idx"),
        F.coalesce(F.col("e.w"), F.array().cast("array<double>")).alias("w"),
    )
    return rows, terms
