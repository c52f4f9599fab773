"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide, classes and link counts come out."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from formscribe.llm.hashing import chunks, mix, randoms, window_hashes, word_hashes
from formscribe.llm.stages import stored
from formscribe.llm.words import free_name, marked, unmarked
from formscribe.operators.density import connected

#: Words of an n-gram, the similarity of a link, and the recall wanted of a single pair at that similarity.
N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Minima of a band. More keep unlike texts apart; the number of bands follows from the recall.
ROWS = 6
#: Texts of a block, and blocks of a segment: a task holds one block of a candidate group while a segment streams by.
BLOCK, SEGMENT = 256, 32


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed so that a pair at the threshold shares one with the wanted recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def shingles(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-grams, sorted, one text after another, and their number per text.

    A text of fewer words has one n-gram of all its words; one without words has none.
    """
    words, counts = word_hashes(texts)
    grams, runs = window_hashes(words, counts, n)
    owner = np.repeat(np.arange(len(texts)), runs)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        more = [window_hashes(words[first[i] : first[i] + counts[i]], counts[i : i + 1], int(counts[i]))[0][0] for i in short]
        grams, owner = np.concatenate((grams, np.array(more, dtype=np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(texts))


def _signatures(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per text and band: a hash of that band's minima. Texts without n-grams must be left out."""
    starts = np.cumsum(counts) - counts
    a, b = randoms(31, bands * rows) | np.uint64(1), randoms(32, bands * rows)
    out = np.zeros((len(counts), bands), dtype=np.uint64)
    for i in range(bands):
        for j in range(i * rows, (i + 1) * rows):
            out[:, i] = mix(out[:, i] ^ np.minimum.reduceat((grams ^ b[j]) * a[j], starts))
    return out


def _digest(grams: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits of each text's n-gram set."""
    starts = np.cumsum(counts) - counts
    halves = [mix(np.add.reduceat(mix(grams ^ s), starts) + counts.astype(np.uint64)) for s in randoms(33, 2)]
    return [x.tobytes() for x in np.stack(halves, axis=1)]


def signature_table(documents: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, node (digest of the n-gram set, null without n-grams) and bands, stored; one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts, 1 << 18):
                grams, counts = shingles(texts[lo:hi])
                full = np.flatnonzero(counts)
                node = pd.Series([None] * (hi - lo), dtype=object)
                keys = pd.Series([None] * (hi - lo), dtype=object)
                if len(full):
                    for i, d, s in zip(full, _digest(grams, counts[full]), _signatures(grams, counts[full], bands, rows).view(np.int64)):
                        node[i], keys[i] = d, s
                part = pdf.iloc[lo:hi][["doc_id", "text_hash"]].reset_index(drop=True)
                yield part.assign(node=node, bands=keys)

    given = documents.select(marked(F.col(id_col)).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "doc_id long, text_hash long, node binary, bands array<long>"
    return stored(given.mapInPandas(run, schema).withColumn("doc_id", unmarked(F.col("doc_id"))), "signatures")


class _Texts:
    """N-grams of a block's distinct texts, ready to be met with another block."""

    def __init__(self, table: pd.DataFrame):
        self.node = table["node"].to_numpy()
        self.copies = table["copies"].to_numpy(np.int64)
        self.label = table["label"].to_numpy()
        self.grams, self.counts = shingles(table["text"].tolist())
        self.owner = np.repeat(np.arange(len(table)), self.counts)

    def near(self, other: _Texts, threshold: float) -> np.ndarray:
        """Which own texts (rows) are linked to which of the other block (columns).

        Only n-grams of both blocks matter for the overlap; they become two 0/1 matrices, a slice of columns at a time.
        """
        shared = np.intersect1d(self.grams, other.grams)
        both = np.zeros((len(self.node), len(other.node)), dtype=np.float32)
        sides = []
        for texts in (self, other):
            at = np.searchsorted(shared, texts.grams)
            hit = shared[np.minimum(at, len(shared) - 1)] == texts.grams if len(shared) else np.zeros(len(at), dtype=bool)
            order = np.argsort(at[hit], kind="stable")
            sides.append((texts.owner[hit][order], at[hit][order]))
        width = 1 << 13
        for lo in range(0, len(shared), width):
            parts = []
            for (owner, column), texts in zip(sides, (self, other)):
                a, b = np.searchsorted(column, (lo, lo + width))
                part = np.zeros((len(texts.node), min(width, len(shared) - lo)), dtype=np.float32)
                part[owner[a:b], column[a:b] - lo] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
        union = self.counts[:, None] + other.counts[None, :] - both
        return (both >= threshold * union - 1e-6) & (self.node[:, None] != other.node[None, :])


class _Roots:
    """Labels that links have joined, each with the smallest label it is joined to."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, own: np.ndarray, other: np.ndarray, near: np.ndarray) -> None:
        one, one_code = np.unique(own, return_inverse=True)
        two, two_code = np.unique(other, return_inverse=True)
        met = np.zeros((len(one), len(two)), dtype=bool)
        i, j = np.nonzero(near)
        met[one_code[i], two_code[j]] = True
        for a, b in zip(*np.nonzero(met)):
            x, y = self.root(one[a]), self.root(two[b])
            if x != y:
                self.up[max(x, y)] = min(x, y)


def compare_blocks(members: DataFrame, threshold: float, others: Column) -> DataFrame:
    """node, links, root from members (grp, size, node, copies, label, text): every text of a group against those of
    the blocks `others`, an array of block numbers.

    A group is cut into blocks by hash. A task holds one block while a segment of the others streams by, one block at a
    time. It gives a row per held text, with the number of its links and its label, and a row per label that links join
    to another, so rows stay in proportion to the texts: nothing is emitted per pair or per pair of blocks.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("others", others)
    segments = F.array_distinct(F.transform("others", lambda o: F.floor(o / SEGMENT).cast("int")))
    columns = ["grp", "own", "segment", "other", "node", "copies", "label", "text"]
    held = cut.withColumn("segment", F.explode(segments)).withColumn("own", F.col("block")).withColumn("other", F.lit(-1))
    passing = (
        cut.where(F.array_contains("others", F.col("block"))).withColumn("segment", F.floor(F.col("block") / SEGMENT).cast("int"))
        .withColumn("own", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("other", F.col("block"))
    )
    rows = held.select(*columns).unionByName(passing.select(*columns))
    order = ["grp", "own", "segment"]
    dealt = rows.repartition(*order).sortWithinPartitions(*order, "other", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = part = own = roots = links = None
        held: list[pd.DataFrame] = []

        def meet() -> None:
            nonlocal own, links
            texts = _Texts(pd.concat(held))
            if own is None:
                own, links = texts, np.zeros(len(texts.node), dtype=np.int64)
            else:
                near = own.near(texts, threshold)
                links += near @ texts.copies
                roots.join(own.label, texts.label, near & (own.label[:, None] != texts.label[None, :]))

        def told() -> pd.DataFrame:
            joined = [(x, 0, roots.root(x)) for x in roots.up]
            some = (links > 0) | (own.label != own.node)
            mine = zip(own.node[some], links[some], own.label[some])
            return pd.DataFrame([*mine, *joined], columns=["node", "links", "root"])

        for pdf in batches:
            keys = list(zip(pdf["grp"], pdf["own"], pdf["segment"], pdf["other"]))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if part != keys[lo]:
                    if held:
                        meet()
                        held = []
                    part = keys[lo]
                if key != part[:3]:
                    if own is not None:
                        yield told()
                    key, own, roots = part[:3], None, _Roots()
                held.append(pdf.iloc[lo:hi])
        if held:
            meet()
            yield told()

    return dealt.mapInPandas(run, "node binary, links long, root binary")


def verify_groups(members: DataFrame, threshold: float) -> DataFrame:
    """node, links, root from members (grp, size, node, copies, text): all links of each group, exactly.

    Groups of several blocks are first compared with their first block alone; what that joins has one label, and the
    full comparison names only links between different labels. So a large group of near copies gives a few rows a text.
    """
    alone = members.withColumn("label", F.col("node"))
    large = alone.where(F.col("size") > BLOCK)
    first = stored(compare_blocks(large, threshold, F.array(F.lit(0))), "first-links")
    joined = connected(first.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), [])
    labels = joined.select(F.col("id").alias("node"), F.col("root").alias("new"))
    known = alone.join(labels, "node", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
    return compare_blocks(known, threshold, F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1))


def jaccard_join(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: id, text_hash, class_id and n_links.

    Two documents are linked if the Jaccard similarity of their sets of five-word n-grams is `threshold` or more; equal
    sets are. class_id is the smallest id that a chain of links reaches, n_links the number of documents linked directly,
    copies included. Links are exact: candidates come from the bands, full sets decide.

    Documents of equal sets are one node first, so thousands of copies cost one. Nodes of a band go to the smallest of
    them, and what hangs together is a candidate group; all pairs of a group are compared, so a pair is missed only if
    bands connect it in no way. A group of n texts is compared in blocks: n / BLOCK copies of each text are moved, and no
    pair is ever a row. That work grows with the square of a group of different near copies, as link counts ask for it;
    the rows that come out grow with n.

    Null and empty texts have no n-grams, no links and a class of their own; texts of fewer than five words are one
    n-gram. Null ids come last: a class has a null id only if all its documents have. Repeated rows are copies. Texts are
    read whole, however long; other columns are not looked at. An empty table gives no rows.
    """
    bands = bands_for(threshold, recall, rows)
    table = signature_table(documents, id_col, text_col, bands, rows)
    some = table.where(F.col("node").isNotNull())
    nodes = some.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("least"),
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one"),
        F.min("bands").alias("bands"),
    )
    nodes = stored(nodes, "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    heads = banded.groupBy("band", "key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a node meets its least head, and its other heads (at most one a band) meet that one: as many edges as nodes and pairs of heads
    met = banded.join(heads.drop("n"), ["band", "key"]).groupBy("node").agg(F.array_sort(F.collect_set("head")).alias("heads"))
    ends = F.array_union(F.array("node"), F.slice("heads", 2, bands))
    stars = met.select(F.explode(ends).alias("a"), F.col("heads")[0].alias("b")).where("a != b").distinct()
    groups = connected(stars, []).select(F.col("id").alias("node"), F.col("root").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    wanted = groups.join(sizes, "grp").join(nodes.select("node", "copies", "one"), "node").select(
        "grp", "size", "node", "copies", F.col("one.doc_id").alias("w_id"), F.col("one.text_hash").alias("w_hash")
    )
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    members = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).dropDuplicates(["node"])
    verified = stored(verify_groups(members.select("grp", "size", "node", "copies", "text"), threshold), "links")
    edges = verified.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    classes = connected(edges, []).select(F.col("id").alias("node"), "root")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = (
        nodes.select("node", "copies", "least")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .select("node", "copies", "least", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    known = rooted.join(named, "root").select("node", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    joined = table.select("doc_id", "text_hash", "node").join(known, "node", "left")
    return joined.select(
        F.col("doc_id").alias(id_col),
        "text_hash",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("node").alias("set_digest"),
    )


def keep_one_per_class(documents: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first of each class, by id (null last) and text; all columns stay.

    Of rows with equal id and text one stays. Documents without n-grams are classes of their own.
    """
    first = F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("doc_id"), "text_hash"))
    grouped = classes.where("set_digest is not null").groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("set_digest")).alias("lone"))
    kept = grouped.agg(first.alias("f")).select(F.col("f.doc_id").alias("k_id"), F.col("f.text_hash").alias("k_hash"))
    alone = classes.where("set_digest is null").select(F.col(id_col).alias("k_id"), F.col("text_hash").alias("k_hash"))
    digest, key, other = free_name(documents, "digest"), free_name(documents, "key"), free_name(documents, "other")
    kept = kept.unionByName(alone).toDF(key, other)
    match = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(other))
    hashed = documents.withColumn(digest, F.xxhash64(text_col))
    return hashed.join(kept, match, "left_semi").dropDuplicates([id_col, digest]).drop(digest)
