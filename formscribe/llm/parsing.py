"""Document fingerprints by locally consistent parsing: coin tossing cuts phrases, phrases of phrases get names."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from formscribe.llm.hashing import chunks, mix, randoms
from formscribe.llm.ranges import id_bounds, id_range
from formscribe.llm.words import marked, unmarked

#: Characters that are parsed together; a longer text is parsed alone.
PARSED_CHARS = 1 << 18
#: Levels of the hierarchy whose phrase names are sketched, and how many of the smallest names each sketch keeps.
SKETCHED = (2, 3)
KEPT = 32
_SALT = randoms(7, 64)


def _coin_table() -> np.ndarray:
    """Label of a small number that follows another: twice the lowest bit in which they differ, plus that bit."""
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    bit = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(np.int64), 0)
    return (2 * bit + ((a >> bit) & 1)).astype(np.uint8)


_COIN = _coin_table().ravel()
_PLACE = randoms(8, 64) | np.uint64(1)
_LETTER = randoms(9, 1 << 16)


def _level(names: np.ndarray, starts: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """One level up: names of the phrases that the coins cut, and where each text's phrases start.

    Runs of one name become one symbol first, so neighbours differ. The coins shrink the names' low 32 bits to labels
    below six in four rounds; a phrase starts at each local minimum, so a cut depends on a few symbols beside it only.
    """
    first = np.zeros(len(names), dtype=bool)
    first[starts] = True
    same = np.zeros(len(names), dtype=bool)
    np.equal(names[1:], names[:-1], out=same[1:])
    same &= ~first
    if same.any():
        keep = np.flatnonzero(~same)
        run = np.diff(np.append(keep, len(names))).astype(np.uint64)
        names, first = names[keep], first[keep]
        long = np.flatnonzero(run > 1)
        names[long] = mix(names[long] + run[long] * _SALT[1])

    symbol = names.astype(np.uint32)
    differ = symbol.copy()
    differ[1:] ^= symbol[:-1]
    differ[first] = symbol[first]
    low = differ & (~differ + np.uint32(1))
    bit = (low.astype(np.float32).view(np.uint32) >> np.uint32(23)) - np.uint32(127)
    bit[differ == 0] = 0
    label = ((bit << np.uint32(1)) | ((symbol >> bit) & np.uint32(1))).astype(np.uint8)
    for _ in range(3):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ 1
        label = _COIN[(label.astype(np.uint16) << 7) | left]
    cut = first.copy()
    cut[1:-1] |= (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:]) & ~first[2:]
    at = np.flatnonzero(cut)
    place = (np.arange(len(names), dtype=np.int32) - np.repeat(at.astype(np.int32), np.diff(np.append(at, len(names))))) & 63
    return mix(np.add.reduceat(names * _PLACE[place], at) ^ salt), np.flatnonzero(first[at])


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text: a digest of the whole, then the smallest phrase names of each sketched level.

    Levels are parsed over all texts at once; no phrase crosses from one text to another.
    """
    out = [[hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:16]] for t in texts]
    full = [i for i, t in enumerate(texts) if t]
    if full:
        data = "".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass")
        letters = np.frombuffer(data, dtype="<u4")
        names = _LETTER[letters & np.uint32(0xFFFF)]
        rare = np.flatnonzero(letters > 0xFFFF)
        names[rare] = mix(letters[rare].astype(np.uint64) + _SALT[0])
        starts = np.cumsum([0, *[len(texts[i]) for i in full[:-1]]])
    for level in range(1, max(SKETCHED) + 1):
        if full:
            names, starts = _level(names, starts, _SALT[8 + level])
        if level in SKETCHED:
            sketches = dict.fromkeys(range(len(texts)), "")
            for i, lo, hi in zip(full, starts if full else (), [*starts[1:], len(names)] if full else ()):
                kept = np.unique((names[lo:hi] >> np.uint64(32)).astype(np.uint32))[:KEPT]
                sketches[i] = kept.astype(">u4").tobytes().hex()
            for i, s in sketches.items():
                out[i].append(s)
    return [".".join(parts) for parts in out]


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints: 1 for equal ones, else the mean over the levels of the names' Jaccard estimate."""
    if a == b:
        return 1.0
    scores = []
    for x, y in zip(a.split(".")[1:], b.split(".")[1:]):
        p, q = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        least = set(sorted(p | q)[:KEPT])
        scores.append(len(least & p & q) / len(least) if least else 0.0)
    return sum(scores) / len(scores)


def _edited(texts: list[str]) -> list[str]:
    """Each text but the last with its last half replaced by as many first characters of the next."""
    return [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, fingerprint. Null texts are empty. No shuffle; equal texts have equal fingerprints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts, PARSED_CHARS):
                part = texts[lo:hi]
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi], "n_chars": [len(t) for t in part], "fingerprint": fingerprints(part)})

    rows = documents.select(marked(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInPandas(run, "id long, n_chars long, fingerprint string")
    return out.withColumn("id", unmarked(F.col("id"))).withColumnRenamed("id", id_col)


def edited_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones, or all, of the
    next document by ascending id; the first follows the last. Null texts are empty. Null ids come last; rows with equal
    ids are ordered by text. A lone document is its own next. Texts are read whole, however long,
    and other columns are not looked at. An empty table gives no rows.

    Documents are dealt by id range and sorted inside, so texts are shuffled once; the first document of each range also
    goes, by a join on the few range heads, to the range before it.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = id_bounds(rows.select("id"), "id")
    keys = documents.select(F.col(id_col).cast("long").alias("id")).withColumn("part", id_range(F.col("id"), bounds))
    parts = keys.groupBy("part").agg(F.min("id").alias("head"))
    order = W.orderBy("part")
    heads = parts.select(
        F.coalesce(F.lag("part").over(order), F.max("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("to"),
        "head",
    )
    ranged = rows.withColumn("part", id_range(F.col("id"), bounds))
    first = (
        rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head")))
        .groupBy("to")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("id"), "text", F.col("to").alias("part"), F.lit(True).alias("next"))
    )
    dealt = (
        ranged.select("id", "text", "part", F.lit(False).alias("next"))
        .unionByName(first)
        .repartition("part")
        .sortWithinPartitions("part", "next", F.col("id").asc_nulls_last(), "text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the last row of a batch waits for the next one
        for pdf in batches:
            table = held + list(zip(pdf["id"].tolist(), pdf["text"].tolist(), pdf["next"].tolist()))
            held = table[-1:]
            for lo, hi in chunks([t for _, t, _ in table[:-1]], PARSED_CHARS):
                yield pairs(table[lo : hi + 1])

    def pairs(table: list[tuple]) -> pd.DataFrame:
        texts = [t for _, t, _ in table]
        edited = _edited(texts)
        prints = fingerprints(texts + edited)
        own, changed = prints[: len(texts)], prints[len(texts) :]
        out = [
            (
                doc,
                len(texts[i]),
                hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(),
                own[i],
                changed[i],
                likeness(own[i], changed[i]),
                likeness(own[i], own[i + 1]),
            )
            for i, (doc, _, is_next) in enumerate(table[:-1])
            if not is_next
        ]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pd.DataFrame(out, columns=names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.withColumn("id", marked(F.col("id"))).mapInPandas(run, schema)
    return out.withColumn("id", unmarked(F.col("id"))).withColumnRenamed("id", id_col)
