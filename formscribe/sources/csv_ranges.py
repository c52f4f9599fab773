"""CSV records out of files that are read in byte ranges, also where cells hold line breaks and quotes stay open.

A range is what Spark's line reader gives one split: the lines that begin in it, in order. Two passes make records of them:

1. Every range is walked once and summed up in one row (`_summary`): where it would first leave a quoted cell that an
   earlier range had left open, and which of its own lines leave a cell open at its end.
2. From these rows, one per range, it follows where each range really starts (`entries`), and every range is walked again
   from there. Lines of a record that crosses ranges come out as fragments and are put together by their record.

A line that opens a cell begins a record if the first later line that can close it does so properly and the record then has
the right number of cells. Otherwise that line alone is unreadable, with the broken lines behind it, and reading goes on at
the next line that parses. So one odd quote costs one row, wherever the next one stands.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a cell from its start to the separator or the line's end; only a quote at the start of a cell is one
_CELL = re.compile(r'(?:"(?:[^"]|"")*+"|[^",][^,]*+|)(,|\r?$)', re.DOTALL)
_OPEN = re.compile(r'"(?:[^"]|"")*+$', re.DOTALL)
_CLOSE = re.compile(r'(?:[^"]|"")*+"(,|\r?$)', re.DOTALL)
_STAY = re.compile(r'(?:[^"]|"")*+$', re.DOTALL)

WHOLE, OPEN, CLOSE, STAY, BROKEN = "whole", "open", "close", "stay", "broken"


def _outside(line: str, at: int = 0) -> tuple[str, int]:
    """What a line is that begins outside quotes, and its separators: WHOLE, OPEN (ends inside quotes) or BROKEN."""
    if at == 0 and '"' not in line:
        return WHOLE, line.count(",")
    cells = 0
    while True:
        found = _CELL.match(line, at)
        if found is None:
            return (OPEN if _OPEN.match(line, at) else BROKEN), cells
        if found.group(1) != ",":
            return WHOLE, cells
        at, cells = found.end(), cells + 1


def _inside(line: str) -> tuple[str, int]:
    """What a line is that begins inside quotes, and its separators: CLOSE, STAY (ends inside quotes) or BROKEN."""
    if '"' not in line:
        return STAY, 0
    found = _CLOSE.match(line)
    if found is None:
        return (STAY if _STAY.match(line) else BROKEN), 0
    if found.group(1) != ",":
        return CLOSE, 0
    kind, cells = _outside(line, found.end())
    return {WHOLE: CLOSE, OPEN: STAY, BROKEN: BROKEN}[kind], cells + 1


@dataclass
class _Range:
    """What one walk over the lines of a range has to remember: only lines with quotes."""

    n: int = 0
    # (line, kind from outside, separators; kind from inside, separators)
    events: list[tuple[int, str, int, str, int]] = field(default_factory=list)

    def add(self, line: str) -> None:
        if '"' in line:
            kind, cells = _outside(line)
            inner, inner_cells = _inside(line)
            if kind != WHOLE or inner != STAY or inner_cells:
                self.events.append((self.n, kind, cells, inner, inner_cells))
        self.n += 1

    def first_stop(self, event: int = 0) -> tuple[int, str, int]:
        """(line, kind, separators up to it) of the first event from `event` on that ends a quoted cell for good or breaks
        it; line -1 if the range has none."""
        cells = 0
        for i in range(event, len(self.events)):
            at, _, _, inner, more = self.events[i]
            cells += more
            if inner != STAY:
                return at, inner, cells
        return -1, STAY, cells

    def walk(self, start: int, separators: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """From line `start`, outside quotes: records (first, last line) that end in this range, and open lines
        (line, separators so far) of which it cannot tell: the first that holds is the one left open at the end.

        Unreadable open lines are (line, -1) among the records.
        """
        records, pending, at = [], [], start
        for i, (line, kind, cells, _, _) in enumerate(self.events):
            if line < at or kind != OPEN:
                continue
            stop, how, more = self.first_stop(i + 1)
            if stop < 0:
                pending.append((line, cells + more))
            elif how == CLOSE and cells + more == separators:
                records.append((line, stop))
                at = stop + 1
            else:
                records.append((line, -1))
        return records, pending


_SUMMARY = (
    "file string, start long, lines long, stop long, stop_kind string, stop_cells int, "
    "from_top array<struct<line:long,cells:int>>, from_stop array<struct<line:long,cells:int>>, busy boolean"
)


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], _Range]]:
    key, current = None, _Range()
    for pdf in batches:
        for file, start, line in zip(pdf["file"], pdf["start"], pdf["value"]):
            if key != (file, start):
                if key is not None:
                    yield key, current
                key, current = (file, start), _Range()
            current.add(line)
    if key is not None:
        yield key, current


def range_lines(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame:
    """file, start (of the range) and value of every line; the lines of a range are consecutive and in order.

    Spark's line reader takes bytes as they are, so another encoding is decoded here; it has to be one in which line breaks
    are single bytes.
    """
    value = F.col("value")
    if encoding.lower().replace("-", "") != "utf8":
        value = F.decode(value.cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("value"))


#: Bytes of input, about, that a task reads where ranges are smaller.
TASK_BYTES = 8 << 20


def gathered(lines: DataFrame) -> DataFrame:
    """The same ranges, several in a task where they are small: starting a task costs more than walking a few of them. The
    lines of a range stay together and in order, because nothing is shuffled."""
    spark = lines.sparkSession
    size, count = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes(), lines.rdd.getNumPartitions()
    tasks = max(-(-count * size // TASK_BYTES), 4 * spark.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if tasks < count else lines


def summaries(lines: DataFrame, separators: int) -> pd.DataFrame:
    """One row per range. What comes to the driver grows with the number of ranges, not with their content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for (file, start), r in _walked(batches):
            stop, kind, cells = r.first_stop()
            top, below = r.walk(0, separators)[1], r.walk(stop + 1, separators)[1] if stop >= 0 else []
            named = [[{"line": a, "cells": c} for a, c in p] for p in (top, below)]
            rows.append((file, start, r.n, stop, kind, cells, *named, any(k == OPEN for _, k, *_ in r.events)))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _SUMMARY.split(", ")])

    return lines.mapInPandas(run, _SUMMARY).toPandas()


@dataclass
class Entry:
    """How a range is walked: lines before `begin` belong to the record `record` (file, start, line) of an earlier range,
    and line `left_open` (-1: none) begins a record that ends in a later one."""

    begin: int = 0
    record: tuple[int, int] | None = None
    left_open: int = -1
    plain: bool = False


def entries(table: pd.DataFrame, separators: int) -> dict[tuple[str, int], Entry]:
    """The entry of every range, from the summaries: files from end to start to see where an open cell would be closed,
    then from start to end to see which lines are left open."""
    out: dict[tuple[str, int], Entry] = {}
    for file, rows in table.sort_values(["file", "start"]).groupby("file", sort=False):
        ranges = list(rows.itertuples())
        # for each range: how a cell that is open at its end is closed later, (range, line, kind, separators)
        later: list[tuple[int, int, str, int]] = [(-1, -1, BROKEN, 0)] * len(ranges)
        for i in range(len(ranges) - 2, -1, -1):
            after = ranges[i + 1]
            if after.stop >= 0:
                later[i] = (i + 1, after.stop, after.stop_kind, after.stop_cells)
            else:
                which, line, kind, cells = later[i + 1]
                later[i] = (which, line, kind, cells + after.stop_cells)
        i, begin, record = 0, 0, None
        while i < len(ranges):
            r = ranges[i]
            entry = Entry(begin, record, plain=not r.busy and record is None)
            out[(file, r.start)] = entry
            record, begin = None, 0
            which, line, kind, cells = later[i]
            for p in r.from_top if entry.begin == 0 else r.from_stop:
                if kind == CLOSE and p["cells"] + cells == separators:
                    entry.left_open = p["line"]
                    record = (r.start, p["line"])
                    for k in range(i + 1, which):
                        out[(file, ranges[k].start)] = Entry(ranges[k].lines, record)
                    i, begin = which - 1, line + 1
                    break
            i += 1
    return out


#: Characters of records, about, that a task gathers before it sends them on.
SENT_CHARS = 1 << 22
_OUT = "record string, readable boolean, owner long, line long, file string, start long"


def records(walked: DataFrame, separators: int, header: bool) -> DataFrame:
    """file, start, record (the lines of one record) and readable; fragments of records over ranges are joined.

    Every line brings the entry of its range (`entry_rows`), so a task knows its own ranges and no others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in _cut(batches, separators, header):
            rows.append(row)
            size += len(row[0]) + 64
            if size >= SENT_CHARS:
                yield _frame(rows)
                rows, size = [], 0
        if rows:
            yield _frame(rows)

    cut = walked.mapInPandas(run, _OUT)
    whole = cut.where("owner is null").select("file", "record", "readable")
    parts = cut.where("owner is not null").groupBy("file", "owner", "line").agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"))
    joined = parts.select("file", F.array_join("parts.record", "\n").alias("record"), F.lit(True).alias("readable"))
    return whole.unionByName(joined)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _OUT.split(", ")]).astype({"owner": "Int64", "line": "Int64"})


def _cut(batches: Iterator[pd.DataFrame], separators: int, header: bool) -> Iterator[tuple]:
    key, cutter = None, None
    for pdf in batches:
        entry = zip(*(pdf[c] for c in ("begin", "owner", "owner_line", "left_open")))
        for file, start, line, known in zip(pdf["file"], pdf["start"], pdf["value"], entry):
            if key != (file, start):
                if cutter is not None:
                    yield from ((*row, *key) for row in cutter.end())
                if pd.isna(known[0]):
                    raise RuntimeError(f"range {start} of {file} was cut in another way in the first pass; pin spark.sql.files.minPartitionNum")
                key, cutter = (file, start), _Cutter(*map(int, known), start, separators, header)
            yield from ((*row, *key) for row in cutter.add(line))
    if cutter is not None:
        yield from ((*row, *key) for row in cutter.end())


class _Cutter:
    """Cuts the lines of one range into (record, readable, owner, line) as they come: owner and line name the record that a
    fragment belongs to. Only lines of a record that is not decided yet are held."""

    def __init__(self, begin: int, owner: int, owner_line: int, left_open: int, start: int, separators: int, header: bool) -> None:
        self.owner = (owner, owner_line) if owner >= 0 else None
        self.begin = max(begin, 1) if self.owner is None and start == 0 and header else begin
        self.left_open, self.start, self.separators, self.at = left_open, start, separators, 0
        # lines of an earlier record; from a quote on that is open; behind a quote that nothing closes; left open at the end
        self.earlier: list[str] = []
        self.opened: list[str] = []
        self.cells = 0
        self.broken: list[str] = []
        self.tail: list[str] | None = None

    def add(self, line: str) -> Iterator[tuple]:
        return self._all([line])

    def end(self) -> Iterator[tuple]:
        if self.at <= self.begin:
            yield from self._earlier()
        while self.opened:
            yield from self._all(self._unclosed())
        yield from self._broken()
        if self.tail is not None:
            yield "\n".join(self.tail), True, self.start, self.left_open

    def _all(self, lines: list[str]) -> Iterator[tuple]:
        waiting = lines[::-1]
        while waiting:
            again = yield from self._one(waiting.pop())
            waiting.extend(reversed(again))

    def _one(self, line: str) -> Iterator[tuple]:
        """Returns the lines that have to be looked at again."""
        i = self.at
        self.at += 1
        if i < self.begin:
            if self.owner is not None:
                self.earlier.append(line)
            return []
        if i == self.begin:
            yield from self._earlier()
        if self.tail is not None:
            self.tail.append(line)
            return []
        if self.opened:
            self.opened.append(line)
            kind, cells = _inside(line)
            self.cells += cells
            if kind == STAY:
                return []
            if kind == CLOSE and self.cells == self.separators:
                record = "\n".join(self.opened).removesuffix("\r")
                self.opened = []
                if record:
                    yield record, True, None, None
                return []
            return self._unclosed()
        kind, cells = _outside(line)
        if i == self.left_open:
            yield from self._broken()
            self.tail = [line]
        elif kind == OPEN:
            yield from self._broken()
            self.opened, self.cells = [line], cells
        elif self.broken and _outside(line.removesuffix("\r")) != (WHOLE, self.separators):
            self.broken.append(line)
        else:
            yield from self._broken()
            if record := line.removesuffix("\r"):
                yield record, True, None, None
        return []

    def _unclosed(self) -> list[str]:
        """The open line is unreadable; the lines behind it are to be looked at again."""
        self.broken, again, self.opened = [self.opened[0]], self.opened[1:], []
        self.at -= len(again)
        return again

    def _earlier(self) -> Iterator[tuple]:
        if self.owner is not None:
            yield "\n".join(self.earlier), True, *self.owner
            self.earlier, self.owner = [], None

    def _broken(self) -> Iterator[tuple]:
        """An open line that nothing closes, and the lines behind it that are no record either."""
        if self.broken:
            yield "\n".join(self.broken), False, None, None
            self.broken = []


def entry_rows(known: dict[tuple[str, int], Entry], header: bool) -> list[tuple]:
    """(file, start, plain, begin, owner, owner line, left open) of every range; plain: each of its lines is a record."""
    return [(file, start, e.plain and not (header and start == 0), e.begin, *(e.record or (-1, -1)), e.left_open) for (file, start), e in known.items()]


def read_records(spark: SparkSession, path: str, columns: int, encoding: str, header: bool) -> DataFrame:
    """file, record and readable for every record of the files below `path`.

    The first pass runs here. In the second, only ranges with an open quote or a record that crosses ranges go through
    Python, and the first range of a file for its header line; in all others every line is a record.
    """
    lines = gathered(range_lines(spark, path, encoding))
    known = entries(summaries(lines, columns - 1), columns - 1)
    if not known:
        return spark.createDataFrame([], "file string, record string, readable boolean")
    rows = [tuple(int(x) if i > 2 or i == 1 else x for i, x in enumerate(row)) for row in entry_rows(known, header)]
    # one row per range of the input; a join that shuffled would lose the order of lines, so it has to be a broadcast
    ranges = F.broadcast(spark.createDataFrame(rows, "p_file string, p_start long, plain boolean, begin long, owner long, owner_line long, left_open long"))
    joined = lines.join(ranges, (F.col("file") == F.col("p_file")) & (F.col("start") == F.col("p_start")), "left").drop("p_file", "p_start")
    out = records(joined.where("plain is null or not plain").drop("plain"), columns - 1, header)
    if any(row[2] for row in rows):
        line = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
        out = out.unionByName(joined.where("plain").select("file", line.alias("record"), F.lit(True).alias("readable")).where("record != ''"))
    return out
