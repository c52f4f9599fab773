"""Importance resampling towards a target: hashed word counts weigh each document, noise makes the draw random, and a
distributed radix sort ranks what is drawn."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from formscribe.llm.radix import radix_places
from formscribe.llm.stages import stored
from formscribe.llm.terms import LETTERS_DIGITS, spans, text_slices

#: Consecutive words of a feature (from, to), buckets that features are hashed to, words of a document that may be drawn,
#: percent of such documents that are drawn, and the seed of the noise.
GRAMS, BUCKETS, LEAST_WORDS, PERCENT, SEED = (1, 1), 10_000, 20, 10, 2024
#: Features of more bytes than this are hashed one by one.
LONG_BYTES = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of many spans at once, a byte of all of them at a time; the longest spans come first, so those that still
    have bytes are a prefix."""
    out = np.zeros(len(start), dtype=np.uint32)
    for i in np.flatnonzero(length > LONG_BYTES):
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]])
    short = np.flatnonzero(length <= LONG_BYTES)
    short = short[np.argsort(-length[short], kind="stable")]
    at, sizes = start[short], length[short]
    value = np.full(len(short), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -i, side="left"))
        value[:k] = _CRC[(value[:k] ^ data[at[:k] + i]) & 0xFF] ^ (value[:k] >> 8)
    out[short] = value ^ np.uint32(0xFFFFFFFF)
    return out


def _features(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every feature, rows ascending, and the number of words of each row."""
    start, length, row = spans(data, offsets, LETTERS_DIGITS)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    if grams != (1, 1):  # words of a row one blank apart, so that a run of words is one span
        joined = np.full(int(length.sum() + len(length)), 0x20, dtype=np.uint8)
        to = np.cumsum(length + 1) - (length + 1)
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        joined[np.repeat(to, length) + inside] = data[np.repeat(start, length) + inside]
        data, start = joined, to
    found, rows = [], []
    for n in range(grams[0], grams[1] + 1):
        lo = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else row[:0]
        hi = lo + n - 1
        found.append(crc32s(data, start[lo], start[hi] + length[hi] - start[lo]) % np.uint32(buckets))
        rows.append(row[lo])
    bucket, rows = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return bucket[order], rows[order], n_words


def feature_table(documents: DataFrame, columns: dict[str, Column], text_col: str, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """The named columns, n_words, n_features and the buckets of all features as packed 16- or 32-bit numbers."""
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch["f_text"]):
                rows = len(offsets) - 1
                bucket, owner, n_words = _features(data, offsets, grams, buckets)
                times = np.bincount(owner, minlength=rows)
                ends = np.concatenate(([0], np.cumsum(times) * width.itemsize)).astype(np.int64)
                packed = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bucket.astype(width).tobytes())])
                part = batch.slice(row, rows)
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in names], pa.array(n_words, pa.int64()), pa.array(times, pa.int64()), packed.cast(pa.binary())],
                    names=[*names, "n_words", "n_features", "buckets"],
                )

    given = documents.select(*[c.alias(n) for n, c in columns.items()], F.col(text_col).cast("string").alias("f_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields if f.name != "f_text")
    return given.mapInArrow(run, types + "n_words long, n_features long, buckets binary")


def _flat(column: pa.Array, width: str) -> np.ndarray:
    """The packed numbers of all rows, one row after another."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(width) if data is not None and len(column) else np.zeros(0, dtype=width)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. Tasks add up their own rows; the driver gets one number per bucket, whatever the input."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch["buckets"], width), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(buckets, dtype=np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed bucket shares, target over source."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target)], dtype=np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows without their buckets, with `weight`: the floored mean gain of all features, 0 without any."""
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"
    kept = [c for c in features.columns if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n_features"].to_numpy()
            before = np.concatenate(([0], np.cumsum(gain[_flat(batch["buckets"], width)])))
            ends = np.cumsum(n)
            weight = np.where(n > 0, (before[ends] - before[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(weight, pa.int64())], names=[*kept, "weight"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields if f.name != "buckets")
    return features.mapInArrow(run, types + ", weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Whole thousandths of a Gumbel variate that follows from seed and id; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    documents: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    grams: tuple[int, int] = GRAMS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_features, weight, score and rank (null if it is not drawn).

    Words are runs of letters and digits (all characters beyond ASCII count), A-Z lower-cased; features are runs of
    `grams` words, hashed to `buckets`. The weight is the mean log ratio of the target's to the documents' smoothed bucket
    shares, the score adds Gumbel noise, and of the documents with `least_words` words or more the highest `percent`
    scores are drawn without replacement. Ties go to the smaller id, then to fewer features; null ids come last.

    Null and empty texts have no features and weight 0. Texts are read whole, however long. Repeated rows are documents of
    their own with neighbouring ranks. An empty table gives no rows, an empty target no preference but that of rare
    buckets. Other columns are not looked at. The driver holds one number per bucket.
    """
    features = stored(feature_table(documents, {"doc_id": F.col(id_col).cast("long")}, text_col, grams, buckets), "features")
    wanted = feature_table(target, {}, target_text, grams, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = stored(weighed(features, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    able = F.col("n_words") >= least_words
    places = radix_places(scored.where(able).drop("n_words"), [("score", True), ("doc_id", False), ("n_features", False)])
    drawn = percent * places.count() // 100
    ranked = places.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    rest = scored.where(~able).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")
