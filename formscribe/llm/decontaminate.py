"""Benchmark decontamination: CGK random walks over word windows, bit-sampling LSH, then exact edit distance."""
from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from formscribe.llm.hashing import chunks, mix, randoms, span_hashes
from formscribe.llm.stages import stored
from formscribe.llm.words import free_name, marked, unmarked

#: Share of an item's words that may be edited, and the recall wanted for passages at that distance.
MAX_EDITS = 0.2
TARGET_RECALL = 0.95
#: Items of fewer words are met exactly, by their runs of words with a few left out; walks over so few words miss many.
SHORT_WORDS = 10
#: Words that the walk of one key samples, the bits of the filter, and how many of them each benchmark key sets.
SAMPLED = 5
#: Independent windows that give an item's recall for a number of walks, at the lengths where it is lowest.
MET_WINDOWS = 3.8
FILTER_BITS = 1 << 27
PROBES = 3

#: Scripts without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters.
_DENSE = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0f40-\u0fbc\u1000-\u1049\u1050-\u109d\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f" \
    "\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
_TOKEN, _ANY_DENSE = re.compile(r"\w+"), re.compile(f"[{_DENSE}]")
_DENSE_TOKEN = re.compile(rf"[{_DENSE}]|[^\W{_DENSE}]+")
_KINDS = (4, 8, 16, 32)  # at most 32 steps, so the 64 bits of a word are enough


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; in scripts without blanks every character is a word."""
    if not text:
        return []
    dense = not text.isascii() and _ANY_DENSE.search(text)
    return (_DENSE_TOKEN if dense else _TOKEN).findall(text.lower())


def window_of(words: int) -> int:
    """Words of the windows that an item is cut into: the largest of 4, 8, 16 and 32 within three fifths of the item."""
    return max([k for k in _KINDS if 5 * k <= 3 * words], default=_KINDS[0])


def repetitions(recall: float, max_edits: float) -> int:
    """Walks needed so that a passage with that share of edited words is met with the wanted recall.

    One key survives if its sampled words do: each is off with about the share of edits, and an edit shifts the walk for
    about as long again, so a key agrees with (1 - 2 * edits) ^ SAMPLED. An item holds several sampled windows that overlap;
    together they count as `MET_WINDOWS`. Measured on 300 items of each length with all their edits (20 %), 10 walks find
    0.977 at 54 words, 0.983 at 14, 0.987 at 27 and 60, and all at 10, 11, 20, 35, 70 and 100 words.
    """
    agree = (1 - 2 * max_edits) ** SAMPLED
    return max(1, math.ceil(math.log(1 - recall) / (MET_WINDOWS * math.log(1 - agree))))


#: Code points that may be part of a word are below this one.
_POINTS = 0x32400


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point: 0 between words, 1 inside words, 2 a word of its own."""
    out = np.zeros(_POINTS, dtype=np.uint8)
    for c in range(_POINTS - 1):
        out[c] = 2 if _ANY_DENSE.match(chr(c)) else chr(c).isalnum()
    out[ord("_")] = 1
    return out


def word_numbers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the words that `tokens` gives for each text, one text after another, and how many each has."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.zeros(len(points) + 2, dtype=np.uint8)
    kind[1:-1] = _classes()[np.minimum(points, _POINTS - 1)]
    here, before, after = kind[1:-1], kind[:-2], kind[2:]
    lo = np.flatnonzero((here == 2) | ((here == 1) & (before != 1)))
    hi = np.flatnonzero((here == 2) | ((here == 1) & (after != 1))) + 1
    ends = np.cumsum(np.array([len(t) + 1 for t in lowered], dtype=np.int64))
    counts = np.diff(np.searchsorted(lo, ends), prepend=0)
    values = randoms(79, _POINTS)[np.minimum(points, _POINTS - 1)]
    return mix(span_hashes(values, lo, hi, 0) + (hi - lo).astype(np.uint64)), counts


def _steps(window: int) -> int:
    """Steps of a walk: it moves every second one, so it crosses half of its window and few of its edits."""
    return window


def _sampled(window: int, rep: int) -> np.ndarray:
    """The steps of the walk whose words make the key: a random choice, the same everywhere."""
    order = np.argsort(randoms(1000 * rep + window, _steps(window)))
    return np.sort(order[: min(SAMPLED, _steps(window))])


def coins_of(numbers: np.ndarray, rep: int) -> np.ndarray:
    """64 random bits of every word for one walk, shared by windows of all sizes."""
    return mix(numbers ^ randoms(77, rep + 1)[rep]).view(np.int64)


def embed_keys(coins: np.ndarray, starts: np.ndarray, window: int, rep: int) -> tuple[np.ndarray, np.ndarray]:
    """LSH keys of the windows at `starts`, and which windows they are.

    The CGK walk stands on a word at every step and moves on if that word's random bit of that step is set; the words it
    stands on are its embedding, in which an edit costs a few places. The key hashes the words at the sampled steps. A
    walk that stood still between more than one pair of them says too little and has no key; equal walks move alike.
    """
    wanted = set(_sampled(window, rep).tolist())
    at, key = starts.astype(np.int64), np.full(len(starts), window * 64 + rep, dtype=np.int64)
    still, last = np.zeros(len(starts), dtype=np.int8), np.full(len(starts), -1, dtype=np.int64)
    here = np.empty(len(starts), dtype=np.int64)
    for step in range(max(wanted) + 1):
        np.take(coins, at, out=here, mode="clip")
        if step in wanted:
            key = (key ^ here) * np.int64(0x1E3779B97F4A7C15)
            key ^= key >> 32
            still += at == last
            last[:] = at
        np.right_shift(here, step, out=here)
        np.bitwise_and(here, 1, out=here)
        np.add(at, here, out=at)
    moved = np.flatnonzero(still <= 1)
    return key.view(np.uint64)[moved], moved


def _bits(key: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of the filter that a key sets at one of its probes."""
    bit = (mix(key + np.uint64(probe)) if probe else key >> np.uint64(7)) & np.uint64(FILTER_BITS - 1)
    return (bit >> np.uint64(3)).astype(np.int64), np.left_shift(1, (bit & np.uint64(7)).astype(np.uint8), dtype=np.uint8)


def _may_occur(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Numbers of the keys whose probes are all set."""
    left = np.arange(len(key))
    for probe in range(PROBES):
        byte, bit = _bits(key[left], probe)
        left = left[bits[byte] & bit != 0]
    return left


def _padded(numbers: np.ndarray) -> np.ndarray:
    return np.concatenate((numbers, np.zeros(_steps(_KINDS[-1]) + 1, dtype=np.uint64)))


def edits_of(words: int, max_edits: float) -> int:
    """Word edits that an item of so many words allows."""
    return math.floor(words * max_edits + 1e-9)


def short_patterns(words: int, max_edits: float) -> set[tuple[int, ...]]:
    """Places of the words that a run of a document keeps, from its first, for items of so many words.

    A run within k edits of an item gives the same words in the same order once at most k are left out on either side.
    A run need not lose its first or last word, since a shorter run does the same.
    """
    k, out = edits_of(words, max_edits), set()
    for gone, lost in itertools.product(range(min(k, words - 1) + 1), range(k + 1)):
        span = words - gone + lost
        for inner in itertools.combinations(range(1, span - 1), lost):
            out.add(tuple(p for p in range(span) if p not in inner))
    return out


def _placed(numbers: np.ndarray, places: int) -> list[np.ndarray]:
    """What a word adds to a key at each of the first places."""
    return [mix(numbers ^ randoms(78, places)[j]) for j in range(places)]


def _short_keys(words: list[str], max_edits: float) -> np.ndarray:
    """Keys of an item with up to its allowed number of words left out, at any places."""
    at, out = _placed(word_numbers([" ".join(words)])[0], len(words)), set()
    for lost in range(min(edits_of(len(words), max_edits), len(words) - 1) + 1):
        for gone in itertools.combinations(range(len(words)), lost):
            kept = [p for p in range(len(words)) if p not in gone]
            out.add(sum(int(at[j][p]) for j, p in enumerate(kept)) % (1 << 64))
    return np.array(sorted(out), dtype=np.uint64)


def _item_keys(items: pd.DataFrame, reps: int, max_edits: float) -> pd.DataFrame:
    """Keys of every window of every item, at every word: item_id, words (their number), window, key; short items have
    window 0."""
    out = []
    for item, text in zip(items["item_id"], items["text"]):
        words = tokens(text)
        if not words:
            continue
        if len(words) < SHORT_WORDS:
            out.append(pd.DataFrame({"item_id": item, "words": len(words), "window": 0, "key": _short_keys(words, max_edits).view(np.int64)}))
            continue
        window = window_of(len(words))
        numbers, starts = _padded(word_numbers([text])[0]), np.arange(len(words) - window + 1)
        for rep in range(reps):
            keys = np.unique(embed_keys(coins_of(numbers, rep), starts, window, rep)[0]).view(np.int64)
            out.append(pd.DataFrame({"item_id": item, "words": len(words), "window": window, "key": keys}))
    columns = ["item_id", "words", "window", "key"]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def _filters(keys: DataFrame) -> np.ndarray:
    """The filter's bits over all benchmark keys: FILTER_BITS / 8 bytes, however many keys there are.

    Each task sends the bytes that it sets; they are merged by byte before they come to the driver.
    """

    def setting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for probe in range(PROBES):
                byte, bit = _bits(pdf["key"].to_numpy(np.int64).view(np.uint64), probe)
                yield pd.DataFrame({"byte": byte, "bit": bit.astype(np.int32)})

    merged = keys.select("key").mapInPandas(setting, "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    table = merged.toPandas()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    out[table["byte"].to_numpy(np.int64)] = table["bit"].to_numpy(np.uint8)
    return out


def edit_distance(item: list[str], text: list[str]) -> tuple[int, int]:
    """Fewest word edits that turn the item into some run of the text, and where that run ends; a row at a time."""
    numbers: dict[str, int] = {}
    a = [numbers.setdefault(w, len(numbers)) for w in item]
    b = np.array([numbers.get(w, -1) for w in text], dtype=np.int32)
    row, steps = np.zeros(len(b) + 1, dtype=np.int32), np.arange(len(b) + 1, dtype=np.int32)
    for i, x in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_edits: float = MAX_EDITS,
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """Every (document, item) whose document holds a passage within `max_edits` word edits of the item, per item word.

    Columns: the ids, item_words (their number), edits and similarity (1 - edits / item_words). One row per pair of ids.

    Items are cut into windows at every word, documents at every quarter of a window; both are embedded by the same
    walks, and equal sampled places give equal keys. A filter of fixed size over the benchmark's keys lets a document
    window go on only if its key may occur. The words around such windows are stored once, as passages with their keys;
    the keys meet the items in an equi-join, and the exact edit distance between item and passage decides, once per
    (document, passage, item). The documents' side is one pass without a shuffle of texts.

    Items of fewer than SHORT_WORDS words have no walks: all their runs with up to the allowed number of words left out
    are keys, and so are a document's, so every passage of them is found. In scripts without blanks a character counts as
    a word. Null and empty texts match nothing. Null document ids are one document;
    rows with equal ids are one document for the result. Texts are read whole, however long; of several passages of an
    item the one with the fewest edits counts. Other columns are not looked at. Empty tables give no rows.
    """
    spark = documents.sparkSession
    reps = repetitions(recall, max_edits)
    items = benchmark.select(marked(F.col(item_id_col)).alias("item_id"), F.col(item_text_col).alias("text"))
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    key_schema = "item_id long, words int, window int, key long"
    keys = items.repartition(spread, "item_id").mapInPandas(lambda batches: (_item_keys(pdf, reps, max_edits) for pdf in batches), key_schema)
    keys = stored(keys, "benchmark-keys")
    kinds = {r["window"]: r["most"] for r in keys.groupBy("window").agg(F.max("words").alias("most")).collect()}
    kinds, short = {w: most for w, most in kinds.items() if w}, kinds.get(0, 0)
    lengths = [r["words"] for r in keys.where("window = 0").select("words").distinct().collect()]
    patterns = sorted(set().union(*(short_patterns(n, max_edits) for n in lengths)))
    shared = spark.sparkContext.broadcast(_filters(keys))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for lo, hi in chunks(texts, 1 << 18):
                found = meet(texts[lo:hi], bits)
                if found:
                    out = pd.DataFrame(found, columns=["doc", "passage", "words", "keys"])
                    out["doc_id"] = [ids[lo + d] for d in out["doc"]]
                    yield out[["doc_id", "passage", "words", "keys"]]

    def meet(docs: list[str | None], bits: np.ndarray) -> list[tuple]:
        """(document, number of the passage's first word, words, keys) of all passages around windows that may match."""
        numbers, counts = word_numbers(docs)
        if not len(numbers):
            return []
        numbers = _padded(numbers)
        begins = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(docs)), counts)
        inside = np.arange(len(owner)) - begins[owner]
        hits: dict[int, list[tuple[int, int, int]]] = {}

        def hit(start: int, reach: int, key: np.uint64) -> None:
            at = int(inside[start])
            hits.setdefault(int(owner[start]), []).append((max(0, at - reach), at + reach, int(key.view(np.int64))))

        placed, reach = _placed(numbers, max(map(len, patterns), default=0)), short + edits_of(short, max_edits)
        for pattern in patterns:
            key = np.zeros(len(owner), dtype=np.uint64)
            for j, p in enumerate(pattern):
                key += placed[j][p : p + len(owner)]
            for i in _may_occur(key, bits):
                if inside[i] + pattern[-1] < counts[owner[i]]:
                    hit(i, reach, key[i])
        room = counts[owner] - inside
        places = {w: np.flatnonzero((inside % max(1, w // 4) == 0) & (room >= w)) for w in kinds}
        for rep in range(reps if kinds else 0):
            coins = coins_of(numbers, rep)
            for window, most in kinds.items():
                key, moved = embed_keys(coins, places[window], window, rep)
                for i in _may_occur(key, bits):
                    hit(places[window][moved[i]], most + math.ceil(max_edits * most), key[i])
        found = []
        for doc, around in hits.items():
            words = tokens(docs[doc])
            merged: list[list] = []
            for lo, hi, key in sorted(around):
                if not merged or lo > merged[-1][1]:
                    merged.append([lo, hi, set()])
                merged[-1][1] = max(merged[-1][1], hi)
                merged[-1][2].add(key)
            found += [(doc, lo, " ".join(words[lo:hi]), sorted(seen)) for lo, hi, seen in merged]
        return found

    rows = documents.select(marked(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, passage long, words string, keys array<long>"
    passages = stored(rows.mapInPandas(search, schema), "passages").withColumn("digest", F.xxhash64("words"))
    hits = passages.select("doc_id", "passage", "digest", F.explode("keys").alias("key"))
    place = ["doc_id", "passage", "digest"]
    pairs = hits.join(keys.select("key", "item_id"), "key").select(*place, "item_id").distinct()
    pairs = pairs.select(*[F.col(c).alias(f"p_{c}") for c in place], "item_id")
    texts = items.select(F.col("item_id").alias("i"), F.col("text").alias("item"))
    both = (
        passages.select(*place, "words")
        .join(pairs, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in place])
        .join(texts, F.col("item_id") == F.col("i"))
        .select("doc_id", "item_id", "words", "item")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for passage, text in zip(pdf["words"], pdf["item"]):
                item = tokens(text)
                exact = f" {' '.join(item)} " in f" {passage} "
                out.append((len(item), 0 if exact else edit_distance(item, passage.split(" "))[0]))
            yield pdf[["doc_id", "item_id"]].assign(item_words=[n for n, _ in out], edits=[e for _, e in out])

    checked = both.mapInPandas(verify, "doc_id long, item_id long, item_words int, edits int").where(
        F.col("edits") <= F.floor(F.col("item_words") * max_edits + 1e-9)
    )
    best = checked.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "item_words")).alias("m"))
    return best.select(
        unmarked(F.col("doc_id")).alias(id_col),
        unmarked(F.col("item_id")).alias(item_id_col),
        F.col("m.item_words").alias("item_words"),
        F.col("m.edits").alias("edits"),
        (1 - F.col("m.edits") / F.col("m.item_words")).alias("similarity"),
    )


def drop_contaminated(documents: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without a leak, with all their columns."""
    name = free_name(documents, "leaked")
    bad = leaks.select(F.col(id_col).alias(name)).distinct()
    return documents.join(bad, documents[id_col].eqNullSafe(bad[name]), "left_anti")
