"""Vector tables: rows of (composite_key, id, value, vec array<float>).

One row per vector; a per-key index is simply the rows of that key.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators.blocks import matrix
from formscribe.operators.profile import KEY

Encoder = Callable[[list[str]], np.ndarray]


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""

    def scaled(length: Column) -> Column:
        divisor = F.when(length == 0, F.lit(1.0)).otherwise(length)
        return F.transform(vector, lambda x: x.cast("double") / divisor)

    return text.let(norm(vector), scaled)


def cosine(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    lengths = norm(left) * norm(right)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot / lengths)


def paired_cosine(left: Column, right: Column) -> Column:
    """`cosine` for many pairs: worked out in Arrow batches, with the same sums in the same order."""

    @F.arrow_udf(DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        there = pc.and_(a.is_valid(), b.is_valid())
        x, y = matrix(a.filter(there)), matrix(b.filter(there))
        dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        with np.errstate(all="ignore"):
            for p, q in zip(x.T, y.T, strict=True):
                dot += p * q
                xx += p * p
                yy += q * q
            lengths = np.sqrt(xx) * np.sqrt(yy)
            found = np.where(lengths == 0, 0.0, dot / lengths)
        return pc.replace_with_mask(pa.nulls(len(a), pa.float64()), there, pa.array(found))

    return run(left, right)


def value_id(value: Column) -> Column:
    """Stable id of a value inside its key; md5 keeps accidental equality out at any table size."""
    return F.md5(value)


def positions(values: DataFrame) -> DataFrame:
    """0-based position of each distinct value within its key, in value order."""
    from formscribe.operators.ranking import number_items

    return number_items(values.select(KEY, "value").distinct(), [KEY], "value", "position")


def char_ngram_encoder(dimension: int = Settings.dimension, sizes: tuple[int, ...] = (2, 3)) -> Callable[[], Encoder]:
    """Deterministic default encoder: signed hashes of lower-cased character n-grams, L2-normalised.

    Needs no corpus statistics, so a request gets the same vector as the stored value it equals.
    """

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            framed = [np.frombuffer(f"\x02{t.lower()}\x03".encode("utf-32-le"), dtype=np.uint32) for t in texts]
            lengths = np.array([len(f) for f in framed])
            codes = np.concatenate(framed).astype(np.uint64) if framed else np.zeros(0, np.uint64)
            rows = np.repeat(np.arange(len(texts)), lengths)
            for size in sizes:
                if len(codes) < size:
                    continue
                spans = len(codes) - size + 1
                hashed = np.full(spans, size, dtype=np.uint64)
                for offset in range(size):
                    hashed = (hashed ^ codes[offset : offset + spans]) * np.uint64(0x9E3779B97F4A7C15)
                    hashed ^= hashed >> np.uint64(29)
                whole = rows[:spans] == rows[size - 1 : size - 1 + spans]
                hashed, owner = hashed[whole], rows[:spans][whole]
                cell = owner * dimension + (hashed % np.uint64(dimension)).astype(np.int64)
                sign = np.where((hashed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
                out += np.bincount(cell, weights=sign, minlength=out.size).reshape(out.shape)
            out[np.array([t == "" for t in texts], dtype=bool)] = 0.0
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

        return encode

    return load


def embed_column(
    value: Column, encoder: Callable[[], Encoder] | None = None, batch: int = 1024, on_error: str = "fail"
) -> Column:
    """Vector of each text. `encoder` is a factory that loads the model once per task.

    An encoder that raises fails the job. With `on_error="status"` its batch gets NULL vectors; operators leave those
    rows out, and `failed_vectors` lists them.
    """
    if on_error not in ("fail", "status"):
        raise ValueError("on_error must be fail or status")
    factory = encoder or char_ngram_encoder()

    @F.arrow_udf(ArrayType(FloatType()))
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = factory()
        for array in arrays:
            texts = [t or "" for t in array.to_pylist()]
            pieces = []
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                try:
                    rows = np.asarray(encode(part), dtype=np.float32)
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * rows.shape[1])
                    pieces.append(pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float32())))
                except Exception:
                    if on_error == "fail":
                        raise
                    pieces.append(pa.nulls(len(part), pa.list_(pa.float32())))
            yield pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(pa.float32()))

    # kept where it is written: the optimizer may neither repeat the model call nor move it into a filter
    return run.asNondeterministic()(text.embedding_text(value))


def with_vectors(vectors: DataFrame) -> DataFrame:
    """The rows that have a vector."""
    return vectors.where(F.col("vec").isNotNull())


def failed_vectors(vectors: DataFrame) -> DataFrame:
    """(key, id, status) of the rows whose encoder failed; no search, pair or index holds them."""
    return vectors.where(F.col("vec").isNull()).select(KEY, "id", F.lit("no_vector").alias("status"))


def embed_values(df: DataFrame, encoder: Callable[[], Encoder] | None = None, on_error: str = "fail") -> DataFrame:
    """Vector table of the distinct values of every key. Each distinct text is encoded once, whatever the
    number of keys that hold it."""
    keyed = df.where(F.col("value").isNotNull()).select(KEY, "value").distinct()
    texts = keyed.select("value").distinct().withColumn("vec", embed_column(F.col("value"), encoder, on_error=on_error))
    return keyed.join(texts, "value").select(KEY, value_id(F.col("value")).alias("id"), "value", "vec")


def vector_stats(vectors: DataFrame, per_key: bool = True) -> DataFrame:
    """count, dimension and norm statistics (population std)."""
    keys = [KEY] if per_key else []
    measured = vectors.withColumn("_norm", norm(F.col("vec")))
    measures = [
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dimension"),
        *[
            F.coalesce(f("_norm"), F.lit(0.0)).alias(f"{n}_norm")
            for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
        ],
    ]
    return measured.groupBy(*keys).agg(*measures)


def index_status(keys: DataFrame, vectors: DataFrame, settings: Settings = Settings(), index_type: str = "flat") -> DataFrame:
    """One row per wanted key: count, dimension, index type in effect, success or empty."""
    counted = vectors.groupBy(KEY).agg(F.count(F.lit(1)).alias("count"), F.max(F.size("vec")).alias("dimension"))
    n = F.coalesce("count", F.lit(0)).cast("long")
    effective = F.when(F.lit(index_type != "flat") & (n >= settings.nlist), F.lit(index_type)).otherwise(F.lit("flat"))
    return keys.select(KEY).distinct().join(counted, KEY, "left").select(
        KEY,
        effective.alias("index_type"),
        F.coalesce("dimension", F.lit(0)).cast("long").alias("dimension"),
        n.alias("count"),
        F.when(n > 0, F.lit("success")).otherwise(F.lit("empty")).alias("status"),
    )


def index_totals(vectors: DataFrame, settings: Settings = Settings(), index_type: str = "flat") -> DataFrame:
    return vectors.agg(
        F.count_distinct(KEY).alias("total_indices"), F.count(F.lit(1)).alias("total_vectors")
    ).withColumns({"index_type": F.lit(index_type), "metric": F.lit(settings.metric)})


def remove_keys(vectors: DataFrame, dropped: DataFrame) -> DataFrame:
    return vectors.join(dropped.select(KEY), KEY, "left_anti")


def add_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vector table after an append; an id that exists already keeps its first vector."""
    fresh = new.join(vectors.select(KEY, "id"), [KEY, "id"], "left_anti")
    return vectors.unionByName(fresh.select(*vectors.columns))
