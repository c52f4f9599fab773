"""Licence scan: rare licence words found by a positional index, confirmed by relative position and key phrases."""
from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from formscribe.llm.words import lower_ascii

#: Licence words are runs of digits, small letters and anything beyond ASCII, after A-Z are lower-cased.
TOKEN = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


@dataclass(frozen=True)
class Template:
    """A licence text of which a file has to hold the key phrase word by word and `least` of its words' weight."""

    label: str
    text: str
    key: str
    least: float = 0.5

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key_words
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: The phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

TEMPLATES = (
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def license_words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def word_weights(documents: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each vocabulary word over all documents; the result is as large as the vocabulary."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    seen = documents.select(F.array_intersect(license_words(F.col(text_col)), known).alias("seen"))
    counts = seen.select(F.explode(F.concat(F.array(F.lit("")), "seen")).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}
    total = found.get("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan_licenses(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[Template, ...] = TEMPLATES,
) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every phrase and every template's key phrase is looked up by its highest-IDF word; the word's places, moved back by
    its position in the template, are the candidate starts. At each start the key phrase must stand word by word; a
    template also needs `least` of its words' IDF weight there. n_base counts all places of the base phrases, first_word
    and last_word are their smallest and largest start (words from 0). score is the best weight share of what was found,
    1 for a base phrase, 0 for none.

    Two passes over the texts: one counts the template words' documents, one scans. The scan is one expression per row:
    nothing is shuffled, and a text costs its own length. Null and empty texts have no words, no places and empty labels.
    Repeated rows, null ids and extra columns are fine. An empty table gives no rows.
    """
    tries = [Template(label, text, text, 1.0) for text, label in phrases] + list(templates)
    weights = word_weights(documents, text_col, sorted({w for t in tries for w in t.words}))
    rare, offsets = [], []
    for t in tries:
        j = max(range(len(t.key_words)), key=lambda j: (weights[t.key_words[j]], t.key_words[j], -j))
        rare.append(t.key_words[j])
        offsets.append(t.key_at + j)
    lookups = _strings(sorted(set(rare)))

    rows = documents.select(F.col(id_col).alias(id_col), license_words(F.col(text_col)).alias("words"))
    hits = F.when(
        F.arrays_overlap("words", lookups),
        F.filter(
            F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(lookups, x["w"])
        ),
    )
    rows = rows.select(id_col, F.size("words").cast("long").alias("n_words"), F.when(hits.isNotNull(), F.col("words")).alias("words"), hits.alias("hits"))

    def starts(k: int) -> Column:
        """Template starts of the candidates of template k whose key phrase stands in full."""
        t = tries[k]
        begin = F.transform(F.filter("hits", lambda h: h["w"] == rare[k]), lambda h: h["i"] - offsets[k])
        key, size = _strings(t.key_words), len(t.key_words)
        return F.filter(
            begin, lambda s: (s + t.key_at >= 0) & (F.slice("words", F.greatest(s + t.key_at, F.lit(0)) + 1, size) == key)
        )

    def share(k: int) -> Callable[[Column], Column]:
        t = tries[k]
        total = sum(weights[w] for w in t.words)

        def at(s: Column) -> Column:
            parts = [
                F.when(F.when(s + j >= 0, F.try_element_at("words", s + j + 1)) == w, F.lit(weights[w] / total)).otherwise(0.0)
                for j, w in enumerate(t.words)
            ]
            return F.least(reduce(operator.add, parts), F.lit(1.0))

        return at

    n = len(phrases)
    none = F.col("hits").isNull()
    rows = rows.select(
        id_col,
        "n_words",
        "words",
        *[F.when(~none, starts(k)).alias(f"s{k}") for k in range(len(tries))],
    )
    rows = rows.select(
        id_col,
        "n_words",
        *[f"s{k}" for k in range(n)],
        *[
            F.when(F.size(f"s{k}") > 0, F.array_max(F.transform(f"s{k}", share(k)))).alias(f"c{k}")
            for k in range(n, len(tries))
        ],
    )
    places = F.concat(*[F.coalesce(F.col(f"s{k}"), F.array().cast("array<int>")) for k in range(n)])
    base = [F.when(F.size(f"s{k}") > 0, F.lit(phrases[k][1])) for k in range(n)]
    more = [F.when(F.col(f"c{k}") >= tries[k].least, F.lit(tries[k].label)) for k in range(n, len(tries))]
    shares = [F.when(F.col(f"c{k}") >= tries[k].least, F.col(f"c{k}")).otherwise(0.0) for k in range(n, len(tries))]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    found = rows.select(
        id_col,
        "n_words",
        places.alias("places"),
        joined(base).alias("base_labels"),
        joined(base + more).alias("labels"),
        F.greatest(F.lit(0.0), *shares).alias("best"),
    )
    return found.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        "base_labels",
        "labels",
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("best")).alias("score"),
    )
