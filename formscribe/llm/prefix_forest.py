"""Approximate nearest neighbours by a hash-prefix forest.

Every tree is one array of long hash strings, sorted and cut into parts. A query first looks at the strings beside its own
place in every tree, where the longest common prefixes are, and then ascends in all trees at once, one shorter prefix after
another, until vectors as near as those found so far would hardly be missed.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from formscribe.llm.stages import stored

#: Neighbours asked for, the share of them that is to be found, and which rows are queries.
K, RECALL, EVERY = 5, 0.95, 50
#: Trees, and symbols of a hash string. A symbol is a byte: the largest of at most `AXES` rotated axes and its sign.
TREES, SYMBOLS, AXES = 48, 8, 64
#: Strings on each side of a query's place that it looks at first.
BESIDE = 4
#: Vectors of a block, strings of a part: what a task holds of either while queries stream by.
BLOCK, PART = 1 << 14, 1 << 17
SEED = 71


@lru_cache(maxsize=128)
def _rotations(tree: int, dim: int) -> np.ndarray:
    """(dim, SYMBOLS * axes): the axes of all symbols of a tree."""
    axes = min(dim, AXES)
    given = np.random.default_rng((SEED, tree, dim)).standard_normal((SYMBOLS, dim, axes))
    return np.concatenate(list(np.linalg.qr(given)[0]), axis=1).astype(np.float32)


def _symbols(rotated: np.ndarray) -> np.ndarray:
    """Largest axis in absolute value, and its sign, along the last dimension."""
    axis = np.abs(rotated).argmax(axis=-1)
    return axis * 2 + (np.take_along_axis(rotated, axis[..., None], axis=-1)[..., 0] < 0)


def hash_strings(vectors: np.ndarray, tree: int) -> np.ndarray:
    """The hash string of each vector in a tree, as a whole number whose highest byte is the first symbol."""
    axes = min(vectors.shape[1], AXES)
    rotated = (vectors.astype(np.float32) @ _rotations(tree, vectors.shape[1])).reshape(len(vectors), SYMBOLS, axes)
    out = np.zeros(len(vectors), dtype=np.int64)
    for symbol in _symbols(rotated).T:
        out = out << 8 | symbol
    return out


@lru_cache(maxsize=16)
def level_cosines(dim: int, trees: int = TREES, recall: float = RECALL) -> list[float]:
    """For 1, 2, ... symbols: the least cosine at which a pair shares such a prefix in some tree with the wanted recall.

    How often two vectors of a given cosine share a symbol is measured on 10,000 random pairs.
    """
    rng, axes = np.random.default_rng((SEED, dim)), min(dim, AXES)
    one = rng.standard_normal((10_000, dim))
    one /= np.linalg.norm(one, axis=1)[:, None]
    two = rng.standard_normal((10_000, dim))
    two -= (two * one).sum(axis=1)[:, None] * one
    two /= np.maximum(np.linalg.norm(two, axis=1)[:, None], 1e-300)
    grid = np.linspace(0, 1, 51)
    mine = _symbols(one[:, :axes])
    share = np.maximum.accumulate([(mine == _symbols((c * one + math.sqrt(1 - c * c) * two)[:, :axes])).mean() for c in grid])
    share[-1] = 1.0
    needed = [(1 - (1 - recall) ** (1 / trees)) ** (1 / level) for level in range(1, SYMBOLS + 1)]
    return [float(grid[np.searchsorted(share, p)]) for p in needed]


def _stream(held: DataFrame, asking: DataFrame, key: str, order: list[str], load: Callable, answer: Callable, schema: str, tasks: int) -> DataFrame:
    """answer(load(held rows of a key), asking rows) for each key and batch: a task keeps the held rows of one key at a
    time, which are bounded, and any number of asking rows stream by in batches."""
    kind = "s_asks"
    both = held.withColumn(kind, F.lit(0)).unionByName(asking.withColumn(kind, F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(tasks, key).sortWithinPartitions(key, kind, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, ready = None, [], None
        for pdf in batches:
            keys, asks = pdf[key].to_numpy(), pdf[kind].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks) != 0)) + 1), len(pdf)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != now:
                    now, parts, ready = keys[lo], [], None
                if not asks[lo]:
                    parts.append(pdf.iloc[lo:hi])
                elif parts or ready is not None:
                    if ready is None:
                        ready, parts = load(pd.concat(parts)), []
                    yield from answer(ready, pdf.iloc[lo:hi])

    return dealt.mapInPandas(run, schema)


def _packed(column: pa.Array, dtype: np.dtype) -> pa.Array:
    """Vectors of one length as fixed numbers of bytes."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=dtype)
    width = len(values) // max(len(column), 1) * dtype.itemsize
    ends = pa.py_buffer((np.arange(len(column) + 1, dtype=np.int64) * width).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, ends, pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _vectors(column: pd.Series, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1)


class Forest:
    """The index over the distinct vectors of a table, as stored tables.

    nodes: (block, pos, node, least, vec), one row per distinct vector; members: its smallest ids; strings: (part, tree,
    key, block, pos) in sorted order, cut into parts; heads: the first string of each part, one number per `PART` strings.
    """

    def __init__(self, rows: DataFrame, id_col: str, vec_col: str, k: int, trees: int) -> None:
        self.spark, self.k, self.trees = rows.sparkSession, k, trees
        single = isinstance(rows.schema[vec_col].dataType.elementType, FloatType)
        self.dtype = np.dtype("<f4" if single else "<f8")
        given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        valid = given.where((square > 0) & (square < float("inf")))
        sizes = valid.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
        self.dim = sizes[0].dim if sizes else 1
        valid = valid.where(F.size("vec") == self.dim).withColumn("node", F.md5(F.col("vec").cast("string")))
        self.valid = valid
        by_id = Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last())
        members = stored(valid.withColumn("copy", F.row_number().over(by_id)).where(F.col("copy") <= k + 1), "vector-members")
        self.members = members.drop("vec")
        self.n = members.where("copy = 1").count()
        self.blocks = max(1, math.ceil(self.n / BLOCK))
        self.tasks = max(self.blocks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        block = F.pmod(F.xxhash64("node"), F.lit(self.blocks)).cast("int")
        placed = members.where("copy = 1").select("node", F.col("vec_id").alias("least"), "vec", block.alias("block"))
        placed = placed.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1)
        dtype = self.dtype

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["block"], b["pos"], b["node"], b["least"], _packed(b["vec"], dtype)], names=["block", "pos", "node", "least", "vec"])

        self.nodes = stored(placed.mapInArrow(pack, "block int, pos int, node string, least long, vec binary"), "vector-nodes")
        parts = max(1, math.ceil(self.n * trees / PART))
        order = ["tree", "key", "block", "pos"]
        sorted_strings = self._strings(self.nodes, ["block", "pos"]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.strings = stored(sorted_strings.withColumn("part", F.spark_partition_id()), "hash-strings")
        heads = self.strings.groupBy("part").agg(F.min(F.struct("tree", "key")).alias("head")).select("part", "head.*").orderBy("tree", "key", "part").toPandas()
        self.heads = (heads["part"].to_numpy(np.int32), heads["tree"].to_numpy(np.int64), heads["key"].to_numpy(np.int64))

    def _strings(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """A row per tree for each row of (names, vec), with its hash string."""
        dtype, trees = self.dtype, self.trees

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 4096):
                    part = pdf.iloc[lo : lo + 4096]
                    vectors = _vectors(part["vec"], dtype).astype(np.float64)
                    vectors /= np.abs(vectors).max(axis=1)[:, None]
                    for tree in range(trees):
                        yield part[names].assign(tree=np.int32(tree), key=hash_strings(vectors, tree))

        return rows.mapInPandas(run, ", ".join(f"{c} int" for c in names) + ", tree int, key long")

    def _routed(self, asked: DataFrame) -> DataFrame:
        """Asking rows once for each part that holds strings of their tree from `low` to `high`."""
        parts, trees, keys = self.heads

        @F.pandas_udf("array<int>")
        def find(tree: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
            out = []
            for t, a, b in zip(tree, lo, hi):
                from_, to = np.searchsorted(trees, [t, t + 1])
                first = from_ + np.searchsorted(keys[from_:to], a, side="left") - 1
                last = from_ + np.searchsorted(keys[from_:to], b, side="right") - 1
                out.append(parts[max(first, 0) : max(last, first, 0) + 1])
            return pd.Series(out)

        return asked.withColumn("part", F.explode(find("tree", "low", "high")))

    def _found(self, asked: DataFrame, beside: int) -> DataFrame:
        """(q_block, q_pos, block, places): packed places of the strings from `low` to `high`, or with `beside` that many on
        each side of `low`; one row per query, tree, part and block."""

        def load(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
            return tuple(pdf[c].to_numpy(np.int64) for c in ("tree", "key", "block", "pos"))

        def answer(ready: tuple[np.ndarray, ...], pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            tree, key, block, pos = ready
            out: list[tuple] = []
            for q_block, q_pos, t, lo, hi in zip(pdf["q_block"], pdf["q_pos"], pdf["tree"], pdf["low"], pdf["high"]):
                from_, to = np.searchsorted(tree, [t, t + 1])
                a, b = from_ + np.searchsorted(key[from_:to], lo, side="left"), from_ + np.searchsorted(key[from_:to], hi, side="right")
                if beside:
                    a, b = max(from_, a - beside), min(to, a + beside)
                if a >= b:
                    continue
                order = np.argsort(block[a:b], kind="stable")
                blocks, places = block[a:b][order], pos[a:b][order].astype(np.int32)
                cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), b - a]
                out += [(q_block, q_pos, blocks[x], places[x:y].tobytes()) for x, y in zip(cuts, cuts[1:])]
            if out:
                yield pd.DataFrame(out, columns=["q_block", "q_pos", "block", "places"])

        schema = "q_block int, q_pos int, block int, places binary"
        return _stream(self.strings, self._routed(asked), "part", ["tree", "key", "block", "pos"], load, answer, schema, max(self.tasks, len(self.heads[0])))

    def _scored(self, asked: DataFrame) -> DataFrame:
        """(q_block, q_pos, block, pos, score, least): the k + 1 best of each row of (q_block, q_pos, q_vec, block, lists);
        lists of places may overlap, null stands for the whole block. Ties go to the smaller id, null last."""
        dtype, keep = self.dtype, self.k + 1

        def load(pdf: pd.DataFrame) -> tuple:
            vectors = _vectors(pdf["vec"], dtype).astype(np.float64)
            least = pdf["least"].to_numpy(dtype="float64", na_value=np.nan)  # only to see which are null
            ids = pdf["least"].fillna(0).to_numpy(np.int64)
            return vectors, np.sqrt((vectors * vectors).sum(axis=1)), np.isnan(least), ids, pdf["pos"].to_numpy(np.int64)

        def answer(ready: tuple, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            vectors, norms, unnamed, ids, pos = ready
            out = []
            for q_block, q_pos, q_vec, block, lists in zip(pdf["q_block"], pdf["q_pos"], pdf["q_vec"], pdf["block"], pdf["lists"]):
                at = np.arange(len(ids)) if lists is None else np.unique(np.frombuffer(b"".join(lists), dtype=np.int32))
                q = np.frombuffer(q_vec, dtype=dtype).astype(np.float64)[None, :]
                score = (vectors[at] * q).sum(axis=1) / (norms[at] * np.sqrt((q * q).sum(axis=1)))
                if len(at) > keep:
                    near = np.flatnonzero(score >= np.partition(score, len(at) - keep)[len(at) - keep])
                    at, score = at[near], score[near]
                best = np.lexsort((ids[at], unnamed[at], -score))[:keep]
                out += [(q_block, q_pos, block, pos[i], s, None if unnamed[i] else ids[i]) for i, s in zip(at[best], score[best])]
            frame = pd.DataFrame(out, columns=["q_block", "q_pos", "block", "pos", "score", "least"])
            yield frame.assign(least=pd.array([x[5] for x in out], dtype="Int64"))

        schema = "q_block int, q_pos int, block int, pos int, score double, least long"
        return _stream(self.nodes.drop("node"), asked, "block", ["pos"], load, answer, schema, self.tasks)

    def _best(self, found: DataFrame) -> DataFrame:
        """The k + 1 best nodes of each query node, with the cosine of the last of them, null if there are fewer."""
        query = Window.partitionBy("q_block", "q_pos")
        order = query.orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "block", "pos")
        top = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= self.k + 1)
        return stored(top.withColumn("reached", F.min(F.when(F.col("at") == self.k + 1, F.col("score"))).over(query)), "best-nodes")

    def _search(self, asked: DataFrame, queries: DataFrame, beside: int = 0) -> DataFrame:
        lists = self._found(asked, beside).groupBy("q_block", "q_pos", "block").agg(F.collect_list("places").alias("lists"))
        return self._scored(lists.join(queries, ["q_block", "q_pos"]).select("q_block", "q_pos", "q_vec", "block", "lists"))

    def nearest(self, every: int, recall: float) -> DataFrame:
        """(q_block, q_pos, block, pos, score): the k + 1 nearest nodes found for each node that holds a query row."""
        wanted = self.valid.where(F.col("vec_id") % every == 0).select("node").distinct()
        queries = self.nodes.join(wanted, "node", "left_semi").select(F.col("block").alias("q_block"), F.col("pos").alias("q_pos"), F.col("vec").alias("q_vec"))
        queries = stored(queries, "query-nodes")
        strings = stored(self._strings(queries.withColumnRenamed("q_vec", "vec"), ["q_block", "q_pos"]), "query-strings")
        beside = strings.select("q_block", "q_pos", "tree", F.col("key").alias("low"), F.col("key").alias("high"))
        best = self._best(self._search(beside, queries, BESIDE)).withColumn("level", F.lit(SYMBOLS + 1))
        steps = level_cosines(self.dim, self.trees, recall)
        enough = sum((F.when(F.coalesce("reached", F.lit(-1.0)) >= c, 1).otherwise(0) for c in steps), F.lit(0))
        # up to the prefix that meets the recall; what meets it nowhere goes to one symbol first, and only then to the root
        goal = F.least("level", F.when((enough == 0) & (F.col("level") > 1), 1).otherwise(enough))
        settled = []
        while True:
            best = best.withColumn("goal", goal)
            settled.append(best.where("goal = level").select("q_block", "q_pos", "block", "pos", "score"))
            climbing = stored(best.where("goal < level").select("q_block", "q_pos", F.col("goal").alias("level")).distinct(), "climbing")
            if climbing.isEmpty():
                return reduce(DataFrame.unionByName, settled)
            rest = F.expr(f"shiftleft(1L, 8 * ({SYMBOLS} - level)) - 1")
            prefixes = strings.join(climbing.where("level > 0"), ["q_block", "q_pos"]).select(
                "q_block", "q_pos", "tree", F.col("key").bitwiseAND(F.bitwise_not(rest)).alias("low"), F.col("key").bitwiseOR(rest).alias("high")
            )
            root = climbing.where("level = 0").join(queries, ["q_block", "q_pos"]).select(
                "q_block", "q_pos", "q_vec", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"), F.lit(None).cast("array<binary>").alias("lists")
            )
            found = self._search(prefixes, queries).unionByName(self._scored(root))
            best = self._best(found).join(climbing, ["q_block", "q_pos"])


def nearest_neighbours(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    every: int = EVERY,
    recall: float = RECALL,
    trees: int = TREES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows of largest cosine found for each row whose id `every` divides.

    Every other row is a candidate, also one of the same id or with the same vector. Ties go to the smaller id, null last;
    null ids are candidates only. Vectors that are null, zero (or so small or large that their squared length is no
    positive finite number) or hold null, NaN or infinity take no part, nor do vectors of another length than the most
    frequent one. Repeated query rows each give their neighbours. With fewer candidates than `k`, all are returned; a lone
    row and an empty table give none. Other columns are not looked at.

    Scores are exact; which rows are scored follows from the forest: a query ascends until a row as near as its k-th best
    shares a prefix in some tree with probability `recall` or more. Where not even one symbol is enough, that is, where the
    neighbours are hardly nearer than any row, the query is compared with all rows in blocks, so recall holds at every size
    and for every distribution; only the work differs. Copies of a vector are one entry of the forest. Nothing is cut: a
    prefix that a third of all rows share is read whole, as packed places, never as rows of pairs.
    """
    forest = Forest(rows, id_col, vec_col, k, trees)
    near = forest.nearest(every, recall)
    named = forest.nodes.select("block", "pos", "node")
    near = near.join(named, ["block", "pos"]).select("q_block", "q_pos", "node", "score")
    near = near.join(named.select(F.col("block").alias("q_block"), F.col("pos").alias("q_pos"), F.col("node").alias("q_node")), ["q_block", "q_pos"])
    once = Window.partitionBy("node", "vec_id").orderBy("copy")
    members = forest.members.withColumn("own", F.row_number().over(once) == 1)
    nearest = Window.partitionBy("q_node").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "node", "copy")
    each = near.join(members, "node").withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1)
    asked = forest.valid.where(F.col("vec_id") % every == 0).groupBy("node", F.col("vec_id").alias("query_id")).agg(F.count(F.lit(1)).alias("times"))
    pairs = each.join(asked.withColumnRenamed("node", "q_node"), "q_node")
    pairs = pairs.where("not (node = q_node and vec_id <=> query_id and own)")
    rank = F.row_number().over(Window.partitionBy("q_node", "query_id").orderBy("at"))
    ranked = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")
