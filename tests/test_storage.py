"""Sources, sinks and streams."""
import csv
import io
import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from formscribe.config import Settings
from formscribe.operators import merge, profile
from formscribe.operators.profile import KEY
from formscribe.sources import artefacts, json_ranges, tables
from formscribe.streaming import streams

CSV = 'key_part1,key_part2,key_part3,value\nA,X,1,"va,l1"\nA,X,1,NA\nB,Y,2,"say ""hi"""\nB,Y,2,v,extra,cells\nC,,3,v5\n'


@pytest.fixture()
def csv_path(tmp_path):
    path = tmp_path / "items.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_read_items(spark, csv_path):
    good, bad = tables.split_corrupt(tables.read_items(spark, csv_path))
    assert {f.dataType.typeName() for f in good.schema} == {"string"}
    assert [r.value for r in good.collect()] == ["va,l1", None, 'say "hi"', "v5"]
    assert [r[0] for r in bad.collect()] == ["B,Y,2,v,extra,cells"]


def test_cells_with_line_breaks(spark, tmp_path):
    text = 'key_part1,key_part2,key_part3,value\na,b,c,"two\nlines"\r\na,b,c,"x, ""y""\r\nz"\na,b,c,plain\n'
    (tmp_path / "m.csv").write_bytes(text.encode())
    good, bad = tables.split_corrupt(tables.read_items(spark, str(tmp_path / "m.csv")))
    assert [r.value.replace("\r\n", "\n") for r in good.collect()] == ["two\nlines", 'x, "y"\nz', "plain"] and bad.count() == 0


def test_an_open_last_quote_is_never_good(spark, tmp_path):
    (tmp_path / "o.csv").write_text('key_part1,key_part2,key_part3,value\na,b,c,fine\na,b,c,"cut\nhere\n')
    good, bad = tables.split_corrupt(tables.read_items(spark, str(tmp_path / "o.csv")))
    assert [r.value for r in good.collect()] == ["fine"] and bad.count() == 1


HEADER = "key_part1,key_part2,key_part3,value\n"


@contextmanager
def ranges_of(spark, size):
    """Files are cut into ranges of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read_back(spark, path, text):
    path.write_text(text, encoding="utf-8", newline="")
    good, bad = tables.split_corrupt(tables.read_items(spark, str(path)))
    return [tuple(r) for r in good.collect()], [r[0] for r in bad.collect()]


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_open_quotes_cost_their_own_row(spark, tmp_path, size):
    """Two open quotes far apart, and one behind rows with proper line breaks; whatever the ranges."""
    far = [f'a,b,c,{chr(34) if i in (20, 70) else ""}v{i}' for i in range(100)]
    last = [f'a,b,c,"x\ny{i}"' if i % 10 == 3 else f"a,b,c,v{i}" for i in range(99)] + ['a,b,c,"open']
    with ranges_of(spark, size):
        good, bad = read_back(spark, tmp_path / "far.csv", HEADER + "\n".join(far) + "\n")
        assert sorted(g[3] for g in good) == sorted(f"v{i}" for i in range(100) if i not in (20, 70))
        assert sorted(bad) == ['a,b,c,"v20', 'a,b,c,"v70']
        good, bad = read_back(spark, tmp_path / "last.csv", HEADER + "\n".join(last) + "\n")
        assert sorted(g[3] for g in good) == sorted(f"x\ny{i}" if i % 10 == 3 else f"v{i}" for i in range(99))
        assert bad == ['a,b,c,"open']


@pytest.mark.parametrize("size", [80, 700, 1 << 20])
def test_csv_ranges_against_the_csv_module(spark, tmp_path, size):
    """Random cells of quotes, separators and line breaks, also longer than several ranges."""
    rng = random.Random(size)
    rows = []
    for i in range(300):
        longest = 400 if i % 50 == 0 else 40
        value = "".join(rng.choice(['"', ",", "\n", "a", "bc", " ", "é"]) for _ in range(rng.randrange(longest))) + str(i)
        rows.append((f"k{i % 3}", "p,2" if i % 2 else "p", "z\nz" if i % 7 == 0 else "z", value))
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([HEADER.strip().split(","), *rows])
    with ranges_of(spark, size):
        good, bad = read_back(spark, tmp_path / "r.csv", out.getvalue())
    assert sorted(good) == sorted(rows) and not bad


def test_csv_ranges_run_in_many_tasks(spark, tmp_path):
    text = HEADER + "".join(f'a,b,c,"two\nlines {i}"\na,b,c,plain {i}\n' for i in range(2000))
    (tmp_path / "m.csv").write_text(text)
    with ranges_of(spark, 4096):
        good, _ = tables.split_corrupt(tables.read_items(spark, str(tmp_path / "m.csv")))
        assert good.rdd.getNumPartitions() > 10 and good.count() == 4000
        empty, _ = tables.split_corrupt(tables.read_items(spark, str(tmp_path / "m.csv")))
        assert {r.value for r in empty.where("value like 'two%'").collect()} == {f"two\nlines {i}" for i in range(2000)}


def test_csv_cells_without_quotes_at_their_start(spark, tmp_path):
    """Quotes inside plain cells are text; a file without header; blank lines; a header alone."""
    good, bad = read_back(spark, tmp_path / "q.csv", HEADER + 'a,b,c,5" pipe\n\na,b,c,say "hi"\r\n')
    assert [g[3] for g in good] == ['5" pipe', 'say "hi"'] and not bad
    (tmp_path / "n.csv").write_text('a,b,c,"x\ny"\nd,e,f,g\n')
    read = tables.read_items(spark, str(tmp_path / "n.csv"), columns=["key_part1", "key_part2", "key_part3", "value"], header=False)
    assert [r.value for r in tables.split_corrupt(read)[0].collect()] == ["x\ny", "g"]
    assert read_back(spark, tmp_path / "h.csv", HEADER) == ([], [])


def test_complete_tables_survive_a_failed_batch(spark, tmp_path):
    out = str(tmp_path / "t")
    streams._write_version(spark.range(3), 0, out)
    streams._write_version(spark.range(5), 1, out)
    spark.range(9).write.parquet(f"{out}/data/version=2")  # a write that ended before its marker
    assert streams.read_latest(spark, out).count() == 5


def test_only_the_newest_versions_stay(spark, tmp_path):
    out = str(tmp_path / "t")
    for number in range(4):
        streams._write_version(spark.range(number + 1), number, out)
        assert streams.read_latest(spark, out).count() == number + 1
    assert sorted(p.name for p in (tmp_path / "t" / "data").iterdir() if not p.name.startswith(".")) == ["version=2", "version=3"]


def test_ingest(spark, csv_path):
    rows, stats = tables.ingest_checked(spark, csv_path)
    assert rows.count() == 4
    assert {r[KEY]: r["count"] for r in stats.collect()} == {"A||X||1": 1, "B||Y||2": 1, "C||nan||3": 1}


def test_ingest_refuses_an_empty_table(spark, tmp_path):
    (tmp_path / "e.csv").write_text("key_part1,key_part2,key_part3,value\n")
    with pytest.raises(ValueError, match="DataFrame is empty"):
        tables.ingest_checked(spark, str(tmp_path / "e.csv"))


def test_other_encoding(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("key_part1,key_part2,key_part3,value\nA,B,C,né\n".encode("latin-1"))
    read = tables.read_items(spark, str(tmp_path / "l.csv"), Settings(encoding="ISO-8859-1"))
    assert read.first().value == "né"


def test_typed_preview(spark, csv_path):
    row = tables.preview(spark.range(30), 3, order="id").collect()
    assert [r.id for r in row] == [0, 1, 2] and row[0].total_rows == 30 and row[0].total_columns == 1


def test_json_map(spark, tmp_path):
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps({"A||B": {"count": 2, "candidate_regex": "x"}, "C||D": {"count": 1}}, indent=2))
    entry = StructType([StructField("count", LongType()), StructField("candidate_regex", StringType())])
    got = artefacts.read_json_map(spark, str(path), entry).orderBy(KEY).collect()
    assert [tuple(r) for r in got] == [("A||B", 2, "x"), ("C||D", 1, None)]


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_json_members_in_ranges(spark, tmp_path, size):
    """Commas, quotes, braces and backslashes in names and values, nested values, members longer than ranges."""
    rng = random.Random(size)
    odd = ["a,b", 'say "x", {y', "back\\\\,slash\\\\", "}]", "\\u00e9,é", ", "]

    def value(depth=0):
        kind = rng.randrange(5 if depth < 3 else 2)
        if kind == 0:
            return rng.choice([1, 2.5, None, True])
        if kind == 1:
            return rng.choice(odd) * rng.randrange(1, 40)
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 2 else {rng.choice(odd): value(depth + 1) for _ in range(rng.randrange(4))}

    members = {f"{rng.choice(odd)}{i}": value() for i in range(60)}
    for indent in (None, 2):
        path = tmp_path / f"m{indent}.json"
        path.write_text(json.dumps(members, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
        with ranges_of(spark, size):
            got = {r.name: json.loads(r.body) for r in json_ranges.read_members(spark, str(path)).collect()}
        assert got == members
    (tmp_path / "e.json").write_text("{}")
    assert json_ranges.read_members(spark, str(tmp_path / "e.json")).count() == 0


def test_batches_are_folded(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = [[("k", "x" * (n % 50)) for n in range(b, 400, 4)] for b in range(4)]
    for b, values in enumerate(rows):
        merge.length_sketches(spark.createDataFrame(values, f"{KEY} string, value string")).write.parquet(f"{out}/batch={b}")
    want = merge.merged_length_stats(streams.read_batches(spark, out)).collect()
    assert streams.compact_batches(spark, out, merge.merge_length_sketches) == 2
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["batch=3"]
    assert [r[:5] for r in streams.merged_lengths(spark, out).collect()] == [r[:5] for r in want]
    assert streams.compact_batches(spark, out, merge.merge_length_sketches) is None
    merge.length_sketches(spark.createDataFrame([("k", "abc")], f"{KEY} string, value string")).write.parquet(f"{out}/batch=4")
    assert streams.compact_batches(spark, out, merge.merge_length_sketches) == 3
    got = streams.merged_lengths(spark, out).first()
    assert got["count"] == 401 and got["max"] == 49 and abs(got["median"] - 24.5) <= 1


def test_csv_sink_writes_nested_as_json(spark, tmp_path):
    df = spark.createDataFrame([("k", ["a", "b"])], f"{KEY} string, v array<string>")
    artefacts.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first().v == '["a","b"]'


def test_read_one_key_prunes_buckets(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(200)], f"{KEY} string, v long")
    artefacts.write_keyed(df, str(tmp_path / "t"))
    one = artefacts.read_key(spark, str(tmp_path / "t"), "k7")
    assert [tuple(r) for r in one.collect()] == [("k7", 7)]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_stage_skips_what_is_stored_and_redoes_half_written(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "s")
    assert artefacts.stage(spark, path, build).count() == 3
    assert artefacts.stage(spark, path, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "s" / "_SUCCESS").unlink()
    assert artefacts.stage(spark, path, build).count() == 3
    assert len(calls) == 2


SCHEMA = "row_id long, key_part1 string, key_part2 string, key_part3 string, value string"


def test_statistics_stream_equals_batch_over_many_batches(spark, tmp_path):
    rows = [(i, "A", "B", str(i % 2), f"v{i % 7}") for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    like = spark.createDataFrame([], SCHEMA)
    for _ in range(2):  # the second run finds nothing new
        stream = streams.read_files(spark, str(tmp_path / "in"), like, files_per_trigger=1)
        streams.statistics_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    merged = streams.merged_statistics(spark, str(tmp_path / "out"))
    batch = profile.key_stats(spark.createDataFrame(rows, SCHEMA))
    columns = [KEY, "count", "unique_values"]
    assert merged.select(columns).orderBy(KEY).collect() == batch.select(columns).orderBy(KEY).collect()


def test_expired_items_come_out(spark, tmp_path):
    items = [("1", "k", "2024-01-01 00:00:00"), ("2", "k", "2024-01-01 00:00:00"), ("3", "k", "2024-02-01 00:00:00")]
    decisions = [("1", "accept", None, "2024-01-02 00:00:00"), ("9", "accept", None, "2024-02-01 00:00:00")]
    kinds = {
        "items": (items, f"id string, {KEY} string, ts string", "ts"),
        "decisions": (decisions, "id string, decision string, corrected_value string, reviewed_at string", "reviewed_at"),
    }
    opened = {}
    for name, (rows, schema, time) in kinds.items():
        df = spark.createDataFrame(rows, schema).withColumn(time, F.col(time).cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / name))
        opened[name] = streams.read_files(spark, str(tmp_path / name), df)
    outcome = streams.review_outcomes(opened["items"], opened["decisions"])
    streams.write_table(outcome, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": "accept", "2": "expired"}


def test_learning_run_resumes(spark, tmp_path):
    from formscribe.plans.learn import learn

    rows = [(i, "A", "B", str(i % 2), f"red widget {i % 9} large part") for i in range(40)]
    items = spark.createDataFrame(rows, SCHEMA)
    tables_ = learn(spark, items, str(tmp_path / "run"))
    report = tables_["report"].first()
    assert (report.total_rows, report.unique_keys, report.embedding_vectors) == (40, 2, 18)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "run").iterdir()}
    learn(spark, items, str(tmp_path / "run"))
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "run").iterdir()} == before
