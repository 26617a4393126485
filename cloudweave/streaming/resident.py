"""A resident cloud: the points of the chunks that a pool holds, as versions of a table of slots.

The pool's changes are a log: what each slot holds since which generation. The points of a chunk are written once, in the
generation that places them, with their slot. So a version is a list of such tables, and what is resident in it are the
points whose slot still holds what was placed with them. Removing a chunk writes a few log rows; its points go when the
cloud is compacted, and are deleted when no version that is kept names them. A reader holds a version, and sees the same
points whatever is committed meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.operators.tables import ranked_within, written
from cloudweave.operators.versions import Versions

LOG = "cloud_id string, generation bigint, slot int, chunk_id string, part int, num_points int, state int"
PLACED = "cloud_id string, generation bigint, slot int, src_idx bigint, point_id bigint, x double, y double, z double, rgba bigint"
#: Slots of one partition of a compacted cloud's points.
SLOTS_TOGETHER = 256


def parts(points: DataFrame, points_per_batch: int) -> DataFrame:
    """Points (cloud_id, chunk_id, point_id, x, y, z, rgba) with part and place: the batch of its chunk that a point lies in,
    and where there, in the order of point_id. A chunk may hold any share of all points."""
    chunk = F.struct("cloud_id", "chunk_id")
    named = points.withColumn("_chunk", chunk)
    keep = ["cloud_id", "chunk_id", "point_id", "x", "y", "z", "rgba"]
    numbered = ranked_within(named, "_chunk", ["point_id"], "_place", keep, {})
    return numbered.select(*keep, F.floor(F.col("_place") / points_per_batch).cast("int").alias("part"), (F.col("_place") % points_per_batch).alias("place"))


def latest(log: DataFrame) -> DataFrame:
    """What each slot of a log (LOG) holds at its end; empty slots are left out."""
    held = log.groupBy("cloud_id", "slot").agg(F.max_by(F.struct("generation", "chunk_id", "part", "num_points", "state"), "generation").alias("now"))
    return held.where("now.state = 1").select("cloud_id", "now.generation", "slot", "now.chunk_id", "now.part", "now.num_points", "now.state")


def dirty_ranges(log: DataFrame, since: int | Column, until: int | Column) -> DataFrame:
    """cloud_id, first_slot, slots: the runs of slots that changed after generation `since`, up to `until`."""
    changed = log.where((F.col("generation") > since) & (F.col("generation") <= until)).select("cloud_id", "slot").distinct()
    # Slots of a run are all as far from their numbers.
    run = changed.withColumn("_run", F.col("slot") - F.row_number().over(Window.partitionBy("cloud_id").orderBy("slot")))
    return run.groupBy("cloud_id", "_run").agg(F.min("slot").alias("first_slot"), F.count("*").alias("slots")).drop("_run")


class ResidentCloud:
    """The versions of a resident cloud in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, points_per_batch: int = 256) -> None:
        self.spark, self.points_per_batch = spark, points_per_batch
        self.versions = Versions(spark, path)

    def commit(self, changes: DataFrame, points: DataFrame, batch: int | None = None) -> int:
        """A new version after changes (of follow_changes or replay_changes; one generation or more).

        points: those of the chunks that are placed, with part and place (see parts). Others of them are not written, nor
        those that are gone again by the last change, which no version would show.
        batch: the number of a stream's micro-batch; one that was committed before is not committed again.
        """
        last = self.versions.latest
        now = self.versions.read(last)
        if batch is not None and now.get("batch") is not None and batch <= now["batch"]:
            return last
        log = written(changes.select(*(c.split()[0] for c in LOG.split(", "))), "changes")
        placed = latest(log).select("cloud_id", "generation", "slot", "chunk_id", "part")
        src = F.col("slot").cast("long") * self.points_per_batch + F.col("place")
        rows = points.join(placed, ["cloud_id", "chunk_id", "part"]).select("cloud_id", "generation", "slot", src.alias("src_idx"), "point_id", "x", "y", "z", "rgba")
        return self.versions.commit({"log": [*now.get("log", []), self.versions.write(log)], "points": [*now.get("points", []), self.versions.write(rows)], "batch": batch if batch is not None else now.get("batch")}, last)

    def log(self, version: int | None = None) -> DataFrame:
        return self.versions.table(self.versions.read(version).get("log", []), LOG)

    def slots(self, version: int | None = None) -> DataFrame:
        """The slots that hold something in a version (the last), as LOG rows."""
        return latest(self.log(version))

    def points(self, version: int | None = None) -> DataFrame:
        """The resident points of a version (the last): src_idx (place in the pool), point_id, x, y, z, rgba.

        A pool's slots are the small side of the join: a row for points_per_batch points.
        """
        version = self.versions.latest if version is None else version
        placed = self.versions.table(self.versions.read(version).get("points", []), PLACED)
        return placed.join(self.slots(version).select("cloud_id", "slot", "generation"), ["cloud_id", "slot", "generation"]).select("cloud_id", "src_idx", "point_id", "x", "y", "z", "rgba")

    def batches(self, version: int | None = None) -> DataFrame:
        """Zone maps of the resident slots: bounds, points, first_point; selection takes them as those of a packed cloud."""
        axes = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
        by_slot = self.points(version).groupBy("cloud_id", F.floor(F.col("src_idx") / self.points_per_batch).cast("bigint").alias("batch_id")).agg(*axes, F.count("*").alias("num_points"))
        return by_slot.withColumns({"first_point": F.col("batch_id") * self.points_per_batch, "lod_cum": F.lit(None).cast("array<bigint>"), "state": F.lit(1)})

    def dirty(self, since: int, version: int | None = None) -> DataFrame:
        """Runs of slots that changed between two versions: what a reader of the older one has to load again."""
        known = self.log(since).agg(F.max("generation").alias("g")).first()["g"]
        return dirty_ranges(self.log(version), -1 if known is None else known, (1 << 62))

    def compact(self) -> int:
        """The same points as one log and one table sorted by slots, as a new version."""
        last = self.versions.latest
        log, rows = self.slots(last), self._placed(last)
        n = max(1, -(-log.count() // SLOTS_TOGETHER))
        tidy = rows.repartitionByRange(n, "cloud_id", "slot").sortWithinPartitions("cloud_id", "slot", "src_idx")
        return self.versions.commit({"log": [self.versions.write(log)], "points": [self.versions.write(tidy)], "batch": self.versions.read(last).get("batch")}, last)

    def _placed(self, version: int | None) -> DataFrame:
        placed = self.versions.table(self.versions.read(version).get("points", []), PLACED)
        return placed.join(self.slots(version).select("cloud_id", "slot", "generation"), ["cloud_id", "slot", "generation"]).select(*(c.split()[0] for c in PLACED.split(", ")))
