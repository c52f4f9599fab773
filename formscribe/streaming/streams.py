"""Structured Streaming forms of validation, statistics and the review loop."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formscribe.config import Settings
from formscribe.operators.keys import add_composite_key
from formscribe.operators.merge import batch_stats, length_sketches, merge_batch_stats, merged_length_stats
from formscribe.operators.profile import KEY
from formscribe.sources.artefacts import is_complete

Batch = Callable[[DataFrame], DataFrame]
#: Versions of a complete-mode table that stay: the newest, and the one that a reader may still be reading.
KEPT_VERSIONS = 2


def read_files(spark: SparkSession, pattern: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files that match `pattern`, as a stream with the schema of `like`."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)


def write_batches(stream: DataFrame, work: Batch, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run `work` on every micro-batch and store its result under batch=<id>.

    A repeated batch overwrites its own folder, so a restart after a lost executor or driver neither loses
    nor doubles rows.
    """

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _write_version(batch: DataFrame, number: int, out: str) -> None:
    batch.write.mode("overwrite").parquet(f"{out}/data/version={number}")
    marker = batch.sparkSession.range(1).select(F.lit(number).cast("long").alias("complete"))
    marker.write.mode("overwrite").parquet(f"{out}/markers/version={number}")
    _drop_versions_before(batch.sparkSession, out, number - KEPT_VERSIONS + 1)


def _drop_versions_before(spark: SparkSession, out: str, number: int) -> None:
    """Markers first, so that no reader takes a version whose data is going."""
    jvm = spark.sparkContext._jvm
    for part in ("markers", "data"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{out}/{part}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("version=") and int(name.removeprefix("version=")) < number:
                fs.delete(status.getPath(), True)


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete version of a table that `write_table` keeps in complete mode."""
    newest = spark.read.parquet(f"{out}/markers").agg(F.max("complete")).first()[0]
    return spark.read.parquet(f"{out}/data/version={newest}")


def write_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Append mode goes to the exactly-once file sink. Complete mode writes every batch as a version of its own, then a
    marker; `read_latest` reads the newest version that has one, so a failed write never costs the table. The newest two
    versions are kept."""
    trigger = trigger or {"availableNow": True}
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(
            lambda batch, number: _write_version(batch, number, out)
        )
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def validation_stream(
    requests: DataFrame, profiles: DataFrame, rules: DataFrame, out: str, checkpoint: str,
    duplicates: Callable[[DataFrame], DataFrame] | None = None, **trigger,
) -> StreamingQuery:
    """Continuous validation: every micro-batch takes the batch plan against the static tables.

    `duplicates` gets the prepared requests of the batch and returns their near duplicates.
    """
    from formscribe.operators.validate import prepare_requests, validate_values

    def work(batch: DataFrame) -> DataFrame:
        found = None
        if duplicates is not None:
            found = duplicates(prepare_requests(batch, profiles, rules).where(F.col("known")))
        return validate_values(batch, profiles, rules, found)

    return write_batches(requests, work, out, checkpoint, **trigger)


def statistics_stream(items: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Mergeable statistics of every micro-batch; read them with `merged_statistics`."""
    return write_batches(items, lambda batch: batch_stats(add_composite_key(batch, settings), settings), out, checkpoint, **trigger)


def length_stream(items: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Mergeable length statistics of every micro-batch; read them with `merged_lengths`, fold them with `compact_batches`."""
    return write_batches(items, lambda batch: length_sketches(add_composite_key(batch, settings)), out, checkpoint, **trigger)


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and is_complete(spark, f"{folder}/{n}"))


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """What `write_batches` stored: the newest folded version and the batches behind it."""
    folded = _numbers(spark, f"{out}-folded", "upto=")
    later = [n for n in _numbers(spark, out, "batch=") if not folded or n > folded[-1]]
    paths = [f"{out}/batch={n}" for n in later] + [f"{out}-folded/upto={n}" for n in folded[-1:]]
    return spark.read.parquet(*paths)


def compact_batches(spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame]) -> int | None:
    """Fold all batches but the newest, which a restarted stream may write again, into one table of the same form; the
    folded batches and older folds are then removed. Gives the last folded batch, or None if there was nothing to do."""
    folded, batches = _numbers(spark, f"{out}-folded", "upto="), _numbers(spark, out, "batch=")
    wanted = [n for n in batches[:-1] if not folded or n > folded[-1]]
    if not wanted:
        return None
    paths = [f"{out}/batch={n}" for n in wanted] + [f"{out}-folded/upto={n}" for n in folded[-1:]]
    merge(spark.read.parquet(*paths)).write.parquet(f"{out}-folded/upto={wanted[-1]}")
    jvm = spark.sparkContext._jvm
    for gone in [f"{out}/batch={n}" for n in batches if n <= wanted[-1]] + [f"{out}-folded/upto={n}" for n in folded]:
        path = jvm.org.apache.hadoop.fs.Path(gone)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return wanted[-1]


def merged_lengths(spark: SparkSession, out: str) -> DataFrame:
    return merged_length_stats(read_batches(spark, out))


def merged_statistics(spark: SparkSession, out: str, settings: Settings = Settings()) -> DataFrame:
    return merge_batch_stats(spark.read.parquet(out).drop("batch"), settings)


def review_outcomes(items: DataFrame, decisions: DataFrame, open_for: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Review items joined with their decision; items without one within `open_for` come out as expired.

    Both sides carry a watermark, so the state of an item is dropped once it is decided or too old.
    """
    opened = items.withWatermark("ts", late)
    decided = decisions.select(
        F.col("id").alias("decision_id"), "decision", "corrected_value", "reviewed_at"
    ).withWatermark("reviewed_at", late)
    matches = (
        (F.col("id") == F.col("decision_id"))
        & (F.col("reviewed_at") >= F.col("ts"))
        & (F.col("reviewed_at") <= F.col("ts") + F.expr(f"interval {open_for}"))
    )
    joined = opened.join(decided, matches, "left_outer")
    return joined.withColumn("status", F.coalesce("decision", F.lit("expired"))).drop("decision_id")


def retrain_windows(labels: DataFrame, least: int = Settings.retrain_labels, late: str = "1 hour") -> DataFrame:
    """Sliding days, every hour, in which a key gained enough labels."""
    counted = (
        labels.withWatermark("reviewed_at", late)
        .groupBy(F.window("reviewed_at", "1 day", "1 hour"), KEY)
        .agg(F.count(F.lit(1)).alias("labels"))
    )
    return counted.where(F.col("labels") >= least).select(KEY, F.col("window.start").alias("window_start"), "labels")


def weekly_rates(labels: DataFrame, late: str = "1 hour") -> DataFrame:
    """Labels per day over sliding weeks."""
    counted = (
        labels.withWatermark("reviewed_at", late)
        .groupBy(F.window("reviewed_at", "7 days", "1 day"), KEY)
        .agg(F.count(F.lit(1)).alias("labels"))
    )
    return counted.select(KEY, F.col("window.start").alias("window_start"), "labels", (F.col("labels") / 7.0).alias("learning_rate"))


def first_submits(decisions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Decisions without the repetitions that a retried submit sends."""
    return decisions.withWatermark("reviewed_at", late).dropDuplicatesWithinWatermark(["id"])
