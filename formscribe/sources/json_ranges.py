"""One JSON object of many members, read in byte ranges.

A file is cut at every comma by Spark's line reader, so a range is what one split gives: pieces without commas, in order. No
escape in a JSON string spans a comma, so a piece tells by itself how it leaves strings and nesting, from outside a string
or from inside one. Pass 1 sums that up per range; from these rows every range's entry state follows, and pass 2 cuts the
ranges at the commas of the outermost object. A member that crosses ranges comes out as fragments and is joined.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


def _through(piece: str, inside: bool, depth: int) -> tuple[bool, int]:
    """String state and nesting behind a piece."""
    for mark in _MARK.findall(piece):
        if mark == '"':
            inside = not inside
        elif not inside:
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(mark, 0)
    return inside, depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", ",").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The pieces of a range together; a range is at most one split."""
    key, held = None, []
    for pdf in batches:
        for file, start, piece in zip(pdf["file"], pdf["start"], pdf["value"]):
            if key is not None and key != (file, start):
                yield key, held
                held = []
            key = (file, start)
            held.append(piece)
    if key is not None:
        yield key, held


def _summaries(pieces: DataFrame) -> pd.DataFrame:
    """Per range: string state and change of nesting at its end, from outside and from inside a string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, start), held in _ranges(batches):
            out: tuple[bool, int] = (False, 0)
            within: tuple[bool, int] = (True, 0)
            for piece in held:
                out, within = _through(piece, *out), _through(piece, *within)
            yield pd.DataFrame([(file, start, *out, *within)], columns=["file", "start", "out_inside", "out_depth", "in_inside", "in_depth"])

    return pieces.mapInPandas(run, "file string, start long, out_inside boolean, out_depth int, in_inside boolean, in_depth int").toPandas()


def _entries(table: pd.DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """String state and nesting at the begin of every range."""
    known = {}
    for file, rows in table.sort_values(["file", "start"]).groupby("file", sort=False):
        inside, depth = False, 0
        for r in rows.itertuples():
            known[(file, r.start)] = (inside, depth)
            inside, depth = (r.in_inside, depth + r.in_depth) if inside else (r.out_inside, depth + r.out_depth)
    return known


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(name, body): every member of the object in each file, its value as JSON text.

    The driver gets one row per range. Names and values may hold any JSON; a member is put together in one task, so it has
    to fit there. A file that is no object gives no rows; members that are no JSON fail the job.
    """
    pieces = _pieces(spark, path)
    known = _entries(_summaries(pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, start), held in _ranges(batches):
            if (file, start) not in known:
                raise RuntimeError(f"range {start} of {file} was cut in another way in the first pass; pin spark.sql.files.minPartitionNum")
            inside, depth = known[file, start]
            # number: a member that begins in this range; -1 continues the last one of an earlier range
            out, number, parts = [], 0 if start == 0 else -1, []
            for piece in held:
                inside, depth = _through(piece, inside, depth)
                parts.append(piece)
                if not inside and depth == 1:
                    out.append((number, ",".join(parts), True))
                    number, parts = max(number, -1) + 1, []
            if parts:
                out.append((number, ",".join(parts), False))
            yield pd.DataFrame(out, columns=["number", "text", "ends"]).assign(file=file, start=start)

    cut = pieces.mapInPandas(run, "number int, text string, ends boolean, file string, start long")
    # a member that does not end where it begins is followed by the first rows (number -1) of the ranges behind it
    whole = cut.where("ends and number >= 0").select("file", "text")
    open_ = cut.where("not ends or number < 0")
    order = F.struct("start", "number", "ends", "text")
    joined = open_.groupBy("file").agg(F.sort_array(F.collect_list(order)).alias("rows"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, rows in zip(pdf["file"], pdf["rows"]):
                parts = []
                for r in rows:
                    parts.append(r["text"])
                    if r["ends"]:
                        yield pd.DataFrame({"file": [file], "text": [",".join(parts)]})
                        parts = []
                if parts:
                    yield pd.DataFrame({"file": [file], "text": [",".join(parts)]})

    members = whole.unionByName(joined.mapInPandas(join, "file string, text string"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                text = text.strip().removeprefix("\ufeff")
                if text.startswith("{"):
                    text = text[1:].lstrip()
                if not text.startswith('"'):
                    continue
                name, end = decoder.raw_decode(text)
                begin = text.index(":", end) + 1
                begin += len(text[begin:]) - len(text[begin:].lstrip())
                _, stop = decoder.raw_decode(text, begin)
                out.append((name, text[begin:stop]))
            yield pd.DataFrame(out, columns=["name", "body"])

    return members.mapInPandas(parse, "name string, body string")
