"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps."""
from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window as W, functions as F

from formscribe.llm.hashing import chunks
from formscribe.llm.ranges import id_bounds, id_range
from formscribe.llm.stages import early_cleanup
from formscribe.llm.words import marked, unmarked

#: Words that a worker remembers with their ids; beyond that it forgets all of them.
REMEMBERED = 1_000_000

_SPACES = re.compile(r"[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Marks behind a word, and letters that every release of Unicode has.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts by the tokenizers library; words seen before are not encoded again.

    A byte-level tokenizer never joins a word to what stands before its blank or line break, so a text is cut before
    each blank or line break that a word follows, and each piece's ids are remembered. A text with other white space,
    runs of it, or the written form of a special token goes to the library as a whole.

    A blank and letters are one piece for such a tokenizer, and the marks after them another, so a new word of this kind goes
    straight to the library's model, which takes under half the time of the way through its pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        parts = json.loads(self.tokenizer.to_str())
        cutter = parts["pre_tokenizer"] or {}
        self.by_model = (
            parts["normalizer"] is None
            and parts["model"].get("type") == "BPE"
            and (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex")) == ("ByteLevel", False, True)
        )
        self.model, self.signs, self.line = self.tokenizer.model, _byte_signs(), self.whole("\n")
        self.letter = "H" if self.dtype.itemsize == 2 else "I"

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def pieces(self, text: str) -> list[str] | None:
        if _SPACES.search(text) or text[-1:] in (" ", "\n") or any(s in text for s in ("  ", " \n", "\n ", "\n\n", *self.special)):
            return None
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def word(self, begin: str, letters: str) -> bytes:
        """Ids of letters and of the blank or line break before them."""
        if begin == "\n":
            return self.line + self.word("", letters)
        signs = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.signs)
        ids = [t.id for t in self.model.tokenize("Ġ" + signs if begin else signs)]
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def learn(self, words: list[str]) -> None:
        """Encode unseen pieces of texts; a word with marks behind it is the word's ids and those of the marks."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {"": b""}
        known, others = self.known, []
        for w in words:
            body = w.rstrip(_MARKS)
            begin = w[0] if w[0] in " \n" else ""
            letters = body[1:] if begin else body
            if not (self.by_model and letters.isalpha() and (letters.isascii() or _LETTERS.fullmatch(letters))):
                others.append(w)
                continue
            raw = known.get(body)
            if raw is None:
                raw = known[body] = self.word(begin, letters)
            if len(body) < len(w):
                marks = w[len(body) :]
                if marks not in known:
                    known[marks] = self.whole(marks)
                known[w] = raw + known[marks]
        self._learn(others)

    def _learn(self, words: list[str]) -> None:
        """Encode pieces in one go: each begins with a blank or line break, so they stand one after another."""
        joined = [w for w in words if w[0] in " \n"]
        for w in words:
            if w[0] not in " \n":
                self.known[w] = self.whole(w)
        if not joined:
            return
        got = self.tokenizer.encode("".join(joined), add_special_tokens=False)
        raw = np.array(got.ids, dtype=self.dtype).tobytes()
        at = np.fromiter((o[0] for o in got.offsets), dtype=np.int64, count=len(got.offsets))
        starts = np.cumsum([0, *map(len, joined)])[:-1]
        cuts = [*(np.searchsorted(at, starts) * self.dtype.itemsize).tolist(), len(raw)]
        for w, lo, hi in zip(joined, cuts, cuts[1:]):
            self.known[w] = raw[lo:hi]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        got = [None if c is None else list(map(self.known.get, c)) for c in cut]
        # the ids of a piece are never empty, but for the empty piece
        holes = [[] if c is None else [i for i in compress(range(len(c)), map(not_, g)) if c[i]] for c, g in zip(cut, got)]
        unseen = {c[i]: None for c, missing in zip(cut, holes) for i in missing}
        if unseen:
            self.learn(list(unseen))
        out = []
        for t, g, c, missing in zip(texts, got, cut, holes):
            if c is None:
                out.append(self.whole(t))
                continue
            for i in missing:
                g[i] = self.known[c[i]]
            out.append(b"".join(g))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Part:
    """The three files of one id range. Every attempt writes under a name of its own; only named files count."""

    def __init__(self, root: str, part: int):
        store, base = pafs.FileSystem.from_uri(root)
        self.name = f"part-{part:08d}-{uuid.uuid4().hex[:12]}"
        self.store, self.path = store, f"{base}/{self.name}"
        self.part, self.ids, self.ends, self.n = part, [], [], 0
        self.out = store.open_output_stream(f"{self.path}.bin")

    def add(self, doc_id: int, raw: bytes, size: int) -> None:
        self.out.write(raw)
        self.n += len(raw) // size
        self.ids.append(doc_id)
        self.ends.append(self.n)

    def close(self) -> dict:
        self.out.close()
        for end, values, kind in ((".off", [0, *self.ends], "<u8"), (".ids", self.ids, "<i8")):
            with self.store.open_output_stream(self.path + end) as f:
                f.write(np.array(values, dtype=kind).tobytes())
        return {"part": self.part, "name": self.name, "docs": len(self.ids), "tokens": self.n}


def write_token_files(
    documents: DataFrame, tokenizer: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """Encode every whole text, append `end_id`, and write the ids in ascending id order below `out_dir`.

    Id ranges become parts: `.bin` holds ids (16 bits wide if the vocabulary allows, else 32), `.off` 64-bit offsets
    (documents + 1) and `.ids` the 64-bit document ids
    (the smallest number stands for null). The returned manifest, stored as a table in `out_dir`, has part,
    name, docs, tokens, width and base, the number of ids in all parts before, from a prefix sum over the parts. Files
    that a lost or repeated task left are not in it.

    `out_dir` has to be a folder that all executors share. Texts are shuffled once. Null texts are empty and hold
    `end_id` only; null document ids come last; rows with equal ids are ordered by text.
    Texts are encoded whole, however long, and other columns are not looked at. An empty table has no parts.
    """
    spark = documents.sparkSession
    bounds = id_bounds(documents.select(F.col(id_col).cast("long").alias("id")), "id")
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("part", id_range(F.col("id"), bounds)).repartition("part").sortWithinPartitions("part", "id", "text")
    rows = rows.withColumn("id", marked(F.col("id")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, current = encoder(tokenizer), None
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for pdf in batches:
            ids, texts, parts = pdf["id"].tolist(), pdf["text"].tolist(), pdf["part"].tolist()
            for lo, hi in chunks(texts):
                for i, raw in zip(range(lo, hi), enc.encode(texts[lo:hi])):
                    if current is None or current.part != parts[i]:
                        if current is not None:
                            yield pd.DataFrame([current.close() | {"width": enc.dtype.itemsize}])
                        current = _Part(out_dir, parts[i])
                    current.add(ids[i], raw + end, enc.dtype.itemsize)
        if current is not None:
            yield pd.DataFrame([current.close() | {"width": enc.dtype.itemsize}])

    store, base = pafs.FileSystem.from_uri(out_dir)
    store.create_dir(base, recursive=True)
    schema = "part int, name string, docs long, tokens long, width int"
    with early_cleanup(spark):
        rows.mapInPandas(write, schema).write.mode("overwrite").parquet(f"{out_dir}/parts")
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    manifest = spark.read.schema(schema).parquet(f"{out_dir}/parts").withColumn("base", F.coalesce(before, F.lit(0)))
    manifest.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def _open(store: pafs.FileSystem, path: str) -> pa.Buffer:
    if isinstance(store, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer() if store.get_file_info(path).size else pa.py_buffer(b"")
    with store.open_input_file(path) as f:
        return f.read_buffer()


def read_token_files(manifest: DataFrame, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files of the manifest.

    start counts the ids of all documents before it; the checksum is that of the ids as 32-bit little-endian numbers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(out_dir)
        for pdf in batches:
            for name, width, base in zip(pdf["name"], pdf["width"], pdf["base"]):
                ids = np.frombuffer(_open(store, f"{root}/{name}.bin"), dtype=f"<u{width}")
                off = np.frombuffer(_open(store, f"{root}/{name}.off"), dtype="<u8").astype(np.int64)
                docs = np.frombuffer(_open(store, f"{root}/{name}.ids"), dtype="<i8")
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off, off[1:])]
                yield pd.DataFrame(
                    {
                        "doc_id": docs,
                        "start": base + off[:-1],
                        "n_tokens": np.diff(off),
                        "ids_crc32": np.array(crc, dtype=np.int64),
                    }
                )

    # the manifest is tiny, the files are not: a stated number of tasks, which adaptive execution does not merge
    tasks = min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = manifest.select("part", "name", "width", "base").repartition(max(1, tasks), "part")
    out = parts.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", unmarked(F.col("doc_id")))
