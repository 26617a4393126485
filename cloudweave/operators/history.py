"""What points' displacements were in the last frame of each view, for the motion of points that move by themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.operators.features import DISPLACEMENT
from cloudweave.operators.tables import dropped, shared_folder


class DisplacementHistory:
    """Tables of src_idx, dx, dy, dz by view and cloud, in buckets by src_idx.

    A cloud's own points can be stored in the same buckets, so a frame joins the former displacements without a shuffle
    or a sort. A view keeps the tables of its last two frames: an image must be read before the next but one is made.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or spark.sparkContext.defaultParallelism
        self._frames: dict[tuple[str, str], list[tuple[str, str]]] = {}
        self._clouds: dict[str, tuple[str, str]] = {}

    def _store(self, rows: DataFrame) -> tuple[str, str]:
        name = f"cloudweave_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/cloudweave/{name}"
        # One file a bucket, so its order is known to the join.
        placed = rows.repartition(self.buckets, "src_idx")
        placed.write.format("parquet").option("path", path).bucketBy(self.buckets, "src_idx").sortBy("src_idx").saveAsTable(name)
        return name, path

    def _drop(self, table: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table[0]}")
        dropped(self.spark, table[1])

    def bucketed(self, cloud: str, points: DataFrame) -> DataFrame:
        """A cloud's points (with src_idx), stored in the buckets; those that were stored before are deleted."""
        former, self._clouds[cloud] = self._clouds.get(cloud), self._store(points)
        if former:
            self._drop(former)
        return self.spark.table(self._clouds[cloud][0])

    def with_former(self, view: str, cloud: str, points: DataFrame) -> DataFrame:
        """points (src_idx, dx, dy, dz) with prev_dx, prev_dy, prev_dz: their displacement in the view's last frame.

        A point that was not there then, or was deleted by its displacement, and any in a first frame, has its own.
        """
        frames = self._frames.get((view, cloud))
        if not frames:
            return points.withColumns({f"prev_{n}": F.col(n) for n in DISPLACEMENT})
        then = self.spark.table(frames[-1][0]).select("src_idx", *(F.col(n).alias(f"_{n}") for n in DISPLACEMENT))
        whole = F.col("_dx").isNotNull() & ~(F.isnan("_dx") | F.isnan("_dy") | F.isnan("_dz"))
        joined = points.join(then, "src_idx", "left")
        return joined.withColumns({f"prev_{n}": F.when(whole, F.col(f"_{n}")).otherwise(F.col(n)) for n in DISPLACEMENT}).drop("_dx", "_dy", "_dz")

    def snapshot(self, view: str, cloud: str, points: DataFrame) -> None:
        """Keeps the displacements of a frame."""
        frames = self._frames.setdefault((view, cloud), [])
        frames.append(self._store(points.select("src_idx", *DISPLACEMENT)))
        while len(frames) > 2:
            self._drop(frames.pop(0))

    def forget(self, view: str | None = None, cloud: str | None = None) -> None:
        """Deletes what is kept of a view, a cloud, or both."""
        for key in [k for k in self._frames if view in (None, k[0]) and cloud in (None, k[1])]:
            for table in self._frames.pop(key):
                self._drop(table)
        for name in [n for n in self._clouds if view is None and cloud in (None, n)]:
            self._drop(self._clouds.pop(name))
