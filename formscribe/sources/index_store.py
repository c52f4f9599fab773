"""A stored cell index that grows and shrinks: segments of vectors, lists of removed ids, and a log of versions.

Nothing that a version names is ever rewritten. `append` adds a segment, `remove` a list of ids, `compact` writes the live
vectors as one segment again; each then adds a version to the log, and readers take the newest one that was written to its
end. A vector is live if its segment is the newest with its key and id and no later list holds them.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.operators.ann import assign_cells, train_cells
from formscribe.operators.kmeans import assign_centres, train_centres
from formscribe.operators.profile import KEY
from formscribe.operators.vectors import unit, with_vectors
from formscribe.session import cut_lineage
from formscribe.sources.artefacts import is_complete

LOG = "kind string, name string, version int"
#: A cell with more vectors than this many times its key's mean, and than `block_rows`, is split by `compact`.
OVERGROWN = 4


class IndexStore:
    """The index below one folder, which all executors have to share."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and is_complete(self.spark, f"{self.path}/log/{n}"))

    def _log(self, version: int | None = None) -> list[tuple[str, str, int]]:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        return [tuple(r) for r in self.spark.read.schema(LOG).parquet(f"{self.path}/log/{version or known[-1]}").collect()]

    def _commit(self, entries: list[tuple[str, str, int]], version: int) -> int:
        """Fails if another writer has made the same version meanwhile."""
        self.spark.createDataFrame(entries, LOG).coalesce(1).write.mode("error").parquet(f"{self.path}/log/{version}")
        return version

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _named(self, log: list[tuple[str, str, int]], kind: str) -> list[tuple[str, int]]:
        return sorted(((name, version) for k, name, version in log if k == kind), key=lambda x: x[1])

    def create(self, vectors: DataFrame) -> int:
        """Version 1: cells trained on all vectors (key, id, vec), and one segment."""
        centres = cut_lineage(train_cells(vectors, self.settings))
        segment = self._write(assign_cells(with_vectors(vectors), centres, self.settings), "segments")
        return self._commit([("centres", self._write(centres, "centres"), 1), ("segment", segment, 1)], 1)

    def append(self, vectors: DataFrame) -> int:
        """New vectors take their place in the existing cells; a vector of a known key and id replaces that one. Keys that
        the index does not have get cells of their own."""
        log, version = self._log(), self.versions()[-1] + 1
        centres = self._centres(log)
        new_keys = cut_lineage(with_vectors(vectors).join(centres.select(KEY).distinct(), KEY, "left_anti"))
        if not new_keys.isEmpty():
            added = cut_lineage(train_cells(new_keys, self.settings))
            log = [e for e in log if e[0] != "centres"] + [("centres", self._write(centres.unionByName(added), "centres"), version)]
            centres = self._centres(log)
        segment = self._write(assign_cells(with_vectors(vectors), centres, self.settings), "segments")
        return self._commit([*log, ("segment", segment, version)], version)

    def remove(self, ids: DataFrame) -> int:
        """The vectors of these (key, id) are gone from now on; unknown ones do no harm, and a later append brings one back."""
        log, version = self._log(), self.versions()[-1] + 1
        return self._commit([*log, ("removed", self._write(ids.select(KEY, "id").distinct(), "removed"), version)], version)

    def _centres(self, log: list[tuple[str, str, int]]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._named(log, 'centres')[-1][0]}")

    def load(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(live vectors with their cell, centres) of the newest or a given version."""
        log = self._log(version)
        segments = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("_at", F.lit(at)) for name, at in self._named(log, "segment")]
        removed = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("_gone", F.lit(at)) for name, at in self._named(log, "removed")]
        rows = segments[0]
        for s in segments[1:]:
            rows = rows.unionByName(s)
        if len(segments) > 1:
            newest = rows.groupBy(KEY, "id").agg(F.max("_at").alias("_at"))
            rows = rows.join(newest, [KEY, "id", "_at"])
        if removed:
            gone = removed[0]
            for r in removed[1:]:
                gone = gone.unionByName(r)
            gone = gone.groupBy(KEY, "id").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(gone, [KEY, "id"], "left").where(F.col("_gone").isNull() | (F.col("_gone") < F.col("_at"))).drop("_gone")
        return rows.drop("_at"), self._centres(log)

    def compact(self, split: bool = True) -> int:
        """One segment of the live vectors, without lists of removed ids; overgrown cells become two."""
        version = self.versions()[-1] + 1
        rows, centres = self.load()
        if split:
            rows, centres = split_cells(rows, centres, self.settings)
        named = [("centres", self._write(centres, "centres"), version), ("segment", self._write(rows, "segments"), version)]
        return self._commit(named, version)


def split_cells(index: DataFrame, centres: DataFrame, settings: Settings = Settings(), overgrown: int = OVERGROWN) -> tuple[DataFrame, DataFrame]:
    """Index and centres in which cells that have outgrown their key's other cells are two; their vectors move, all others
    stay where they are."""
    sizes = index.groupBy(KEY, "cell").agg(F.count(F.lit(1)).alias("_n"))
    means = sizes.groupBy(KEY).agg(F.avg("_n").alias("_mean"), F.count(F.lit(1)).alias("_cells"))
    large = sizes.join(means, KEY).where((F.col("_n") > overgrown * F.col("_mean")) & (F.col("_n") > settings.block_rows) & (F.col("_cells") > 1))
    large = cut_lineage(large.select(KEY, "cell"))
    if large.isEmpty():
        return index, centres
    moving = cut_lineage(index.join(large, [KEY, "cell"]))
    rows = moving.select(KEY, "cell", "id", F.lit(1).cast("long").alias("n"), F.lit(2).alias("k"), F.sequence(F.lit(0), F.size("vec") - 1).alias("idx"), unit(F.col("vec")).alias("w"))
    halves = train_centres(rows, [KEY, "cell"], "k", whole=True, settings=settings)
    last = centres.groupBy(KEY).agg((F.max("cell") + 1).alias("_next"))
    # the first half keeps the cell's number, the others are numbered behind the key's last cell, by cell
    fresh = halves.where("cluster > 0").groupBy(KEY).agg(F.sort_array(F.collect_set("cell")).alias("_order"))
    numbered = halves.join(last, KEY).join(fresh, KEY, "left").withColumn(
        "_new", F.when(F.col("cluster") == 0, F.col("cell")).otherwise(F.col("_next") + F.array_position("_order", F.col("cell")).cast("int") - 1)
    )
    new_centres = cut_lineage(numbered.select(KEY, F.col("_new").cast("int").alias("cell"), F.col("w").alias("vec"), F.col("cell").alias("_old")))
    untouched = centres.join(large, [KEY, "cell"], "left_anti")
    all_centres = cut_lineage(untouched.unionByName(new_centres.drop("_old").select(*untouched.columns)))
    own = moving.withColumnRenamed("cell", "_old")
    # within a cell only its own halves are looked at
    spread = new_centres.select(KEY, "_old", F.col("cell").alias("cluster"), F.sequence(F.lit(0), F.size("vec") - 1).alias("idx"), F.col("vec").alias("w"))
    placed = assign_centres(rows.withColumnRenamed("cell", "_old"), spread, [KEY, "_old"], settings)
    moved = own.join(placed.withColumnRenamed("cluster", "cell"), [KEY, "_old", "id"]).drop("_old")
    stay = index.join(large, [KEY, "cell"], "left_anti")
    return stay.unionByName(moved.select(*stay.columns)), all_centres
