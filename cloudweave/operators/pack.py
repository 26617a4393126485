"""Packing: bounds, Z-order rank, levels of detail, batches with zone maps, quantised words, shuffled batch order."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import PackConfig
from cloudweave.operators.tables import file_by_file, owned, pinned, ranked, ranked_counted, shared_folder, written

AXES = ("x", "y", "z")
#: Points of a block of a packed cloud, at most: a task sorts, boxes and writes a block as a whole, so its memory hangs on
#: this and not on the cloud. A cloud has a block for each core at least, if it has as many batches.
BLOCK_POINTS = 1 << 19


@dataclass(frozen=True)
class Bounds:
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def extent(self) -> tuple[float, float, float]:
        return tuple(h - a for a, h in zip(self.low, self.high, strict=True))


def bounds_frame(points: DataFrame) -> DataFrame:
    """One row of least and greatest coordinates; partial sums are per task."""
    return points.agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES))


def bounds(points: DataFrame) -> Bounds:
    """The bounds on the driver; zeros for no points."""
    r = bounds_frame(points).first()
    return Bounds(tuple(float(r[f"min_{a}"] or 0.0) for a in AXES), tuple(float(r[f"max_{a}"] or 0.0) for a in AXES))


def union_bounds(clouds: list[DataFrame]) -> DataFrame:
    """Bounds of several clouds: the bounds of each, then of these."""
    out = None
    for c in clouds:
        b = bounds_frame(c)
        out = b if out is None else out.unionByName(b)
    return out.agg(*(f(f"{n}_{a}").alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES))


def morton_keys(points: DataFrame, b: Bounds) -> DataFrame:
    cells = [g.grid10(F.col(a), b.low[k], b.extent[k]) for k, a in enumerate(AXES)]
    return pinned(pinned(points, dict(zip(("_gx", "_gy", "_gz"), cells, strict=True))), {"mk": g.morton(F.col("_gx"), F.col("_gy"), F.col("_gz"))}).drop("_gx", "_gy", "_gz")


def morton_ranks(points: DataFrame, b: Bounds) -> DataFrame:
    """pk: the place in Z-order, ties by point_id."""
    return ranked(morton_keys(points, b), "mk", ["point_id"], "pk")


def voxel_edge(b: Bounds, divisions: int, level: int) -> float:
    return max(max(b.extent), g.TINY) / divisions * 0.5**level


def slices(rows: DataFrame, points: int) -> tuple[DataFrame, int]:
    """Rows with pk (below points) in partitions of BLOCK_POINTS ranks at most, and how many; a scan's splits hold any number."""
    size = max(1, min(BLOCK_POINTS, -(-points // rows.sparkSession.sparkContext.defaultParallelism)))
    count = max(1, -(-points // size))
    return rows.repartitionById(count, F.floor(F.col("pk") / F.lit(size)).cast("int")), count


def lod_claims(rows: DataFrame, b: Bounds, config: PackConfig, points: int) -> DataFrame:
    """pk, lod_level of the rows (with pk, of `points` ranks) that a level but the finest claims: at each level the unclaimed
    row of the least pk in each voxel.

    A voxel halves from level to level, so those of a finer level lie within one of a coarser, and of the finest voxels
    that claim none but the first few rows, one for each level, can ever be claimed. Only these, with their pk and voxel
    alone, are shuffled (each task sends no more of a voxel), by their coarsest voxel, in which all levels are settled.
    Voxels are sorted in slices of the ranks, so a task's memory doesn't hang on the cloud or its files.
    """
    claiming = config.lod_levels - 1
    if not claiming:
        return rows.select("pk", F.lit(0).alias("lod_level")).where(F.lit(False))
    edge = voxel_edge(b, config.coarse_divisions, claiming - 1)
    finest = {f"_{a}": g.voxel(F.col(a), b.low[k], edge).cast("bigint") for k, a in enumerate(AXES)}
    first = F.row_number().over(Window.partitionBy(*finest).orderBy("pk"))
    sliced, count = slices(pinned(rows, finest).select("pk", *finest), points)
    few = sliced.withColumn("_place", first).where(F.col("_place") <= claiming).drop("_place")
    coarsest = [F.shiftright(n, claiming - 1).alias(f"_c{n}") for n in finest]
    out = few.select("pk", *finest, *coarsest).repartition(count, *(f"_c{n}" for n in finest)).withColumn("lod_level", F.lit(None).cast("int"))
    for level in range(claiming):
        voxel = Window.partitionBy(*(f"_c{n}" for n in finest), *(F.shiftright(n, claiming - 1 - level) for n in finest if level))
        least = F.min(F.when(F.col("lod_level").isNull(), F.col("pk"))).over(voxel)
        out = out.withColumn("lod_level", F.coalesce("lod_level", F.when(F.col("pk") == least, F.lit(level))))
    return out.where("lod_level is not null").select("pk", "lod_level")


def batches_per_block(points: int, config: PackConfig, cores: int, block_points: int | None = None) -> int:
    """Whole batches of a block, so that there are enough blocks for tasks, and none of them is large."""
    batches = -(-points // config.points_per_batch)
    blocks = max(-(-points // (block_points or BLOCK_POINTS)), cores if block_points is None else 1)
    return max(1, -(-batches // blocks))


def batched(rows: DataFrame, claims: DataFrame, config: PackConfig, points: int, block_points: int | None = None) -> DataFrame:
    """lod_level of rows with pk, batch_id by pk, block by batch_id, and local_idx in the order of level, then pk.

    A batch is points_per_batch rows at most. Both sides go to the partition of their block by its number, so blocks are
    spread evenly, and all that follows (levels, places, boxes, files) is done there without another shuffle. The claims
    of a block are a hash table, a row for each of its points at most.
    """
    per = batches_per_block(points, config, rows.sparkSession.sparkContext.defaultParallelism, block_points)
    batch = F.floor(F.col("pk") / F.lit(config.points_per_batch)).cast("bigint")
    block = F.floor(F.col("pk") / F.lit(config.points_per_batch * per)).cast("int")
    blocks = max(1, -(-points // (config.points_per_batch * per)))
    placed = rows.withColumns({"batch_id": batch, "block": block}).repartitionById(blocks, F.col("block"))
    claimed = claims.select("pk", block.alias("block"), F.col("lod_level").alias("_claim")).repartitionById(blocks, F.col("block")).hint("shuffle_hash")
    levelled = placed.join(claimed, ["block", "pk"], "left").withColumn("lod_level", F.coalesce("_claim", F.lit(config.lod_levels - 1))).drop("_claim")
    return levelled.withColumn("local_idx", F.row_number().over(Window.partitionBy("block", "batch_id").orderBy("lod_level", "pk")).cast("bigint") - 1)


def zone_maps(rows: DataFrame) -> DataFrame:
    """batch_id, bounds, num_points and lod_cum: how many points have level 0, up to 1, ... up to 7."""
    cum = F.array(*(F.count_if(F.col("lod_level") <= k) for k in range(8)))
    return rows.groupBy("batch_id", *(["block"] if "block" in rows.columns else [])).agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES), F.count("*").alias("num_points"), cum.alias("lod_cum"))


def quantised(rows: DataFrame) -> DataFrame:
    """xyz_low, xyz_med, xyz_high of rows with block and batch_id, within the bounds of their batches."""
    w = Window.partitionBy("block", "batch_id")
    boxed = rows.withColumns({f"_{n}_{a}": f(a).over(w) for n, f in (("min", F.min), ("max", F.max)) for a in AXES})
    q = [g.quantise30(F.col(a), F.col(f"_min_{a}"), F.col(f"_max_{a}")) for a in AXES]
    gridded = boxed.withColumns({f"_q{a}": c for a, c in zip(AXES, q, strict=True)})
    words = {f"xyz_{n}": g.word(F.col("_qx"), F.col("_qy"), F.col("_qz"), n) for n in ("low", "med", "high")}
    return gridded.withColumns(words).drop(*(f"_{n}_{a}" for n in ("min", "max") for a in AXES), "_qx", "_qy", "_qz")


def shuffled_id(batch_id: Column, n: Column) -> Column:
    """Where a batch goes when every odd batch of the first half changes places with its mirror image. It is its own inverse."""
    mirror = n - 1 - batch_id
    swaps = ((batch_id % 2 == 1) & (batch_id < mirror)) | ((mirror % 2 == 1) & (mirror < batch_id))
    return F.when(swaps, mirror).otherwise(batch_id)


def shuffle_batches(batches: DataFrame, points_per_batch: int, points: int | None = None) -> DataFrame:
    """new_id and first_point of batches (batch_id, num_points) after the shuffle. points: of all, where they are known.

    Only the last batch may be short, so a batch begins at new_id * points_per_batch, less what the last one lacks if
    that comes before it: no running sum over all batches is needed.
    """
    if points is None:
        last = batches.agg(F.max("batch_id").alias("last"), F.max_by("num_points", "batch_id").alias("size")).first()
        count, size = (last["last"] or 0) + 1, last["size"] or 0
    else:
        count = max(1, -(-points // points_per_batch))
        size = points - (count - 1) * points_per_batch
    n = F.lit(count)
    moved = batches.withColumn("new_id", shuffled_id(F.col("batch_id"), n))
    lacking = F.when(F.col("new_id") > shuffled_id(F.lit(count - 1), n), F.lit(points_per_batch - size)).otherwise(F.lit(0))
    return moved.withColumn("first_point", (F.col("new_id") * points_per_batch - lacking).cast("bigint"))


@dataclass(frozen=True)
class PackedCloud:
    """points: all points, or, of a cloud with a layout, what `scan` prunes. batches: their zone maps, with their block."""

    points: DataFrame
    batches: DataFrame
    bounds: Bounds
    config: PackConfig

    def scan(self, zones: DataFrame) -> DataFrame:
        """The points of the files in which zones (block, and the level `top` down to which points are wanted) lie.

        Batches follow the Z-order, so what a camera sees is a few ranges of blocks. They are worked out on zone maps, and
        come to the driver as MOST_RANGES ranges for each level at most; beyond, those with the least gaps are put
        together. They are conditions on partition columns, so other files are not opened, nor finer levels.
        """
        if "block" not in self.points.columns:
            return self.points
        wanted = None
        for top, ranges in block_ranges(zones, self.config.lod_levels).items():
            inside = None
            for first, last in ranges:
                part = F.col("block").between(first, last)
                inside = part if inside is None else inside | part
            if inside is not None:
                seen = (F.col("lod_level") <= top) & inside
                wanted = seen if wanted is None else wanted | seen
        return self.points.where(F.lit(False) if wanted is None else wanted)


#: Ranges of blocks that a selection reads, for each level; more are put together where the gaps are least.
MOST_RANGES = 256


def block_ranges(zones: DataFrame, levels: int) -> dict[int, list[tuple[int, int]]]:
    """For each level, the ranges of blocks (first, last) of zones (block, top) that are wanted down to it.

    A block is one row before ranges are found; levels beyond the last are the last.
    """
    blocks = zones.groupBy("block").agg(F.least(F.max("top"), F.lit(levels - 1)).alias("top"))
    step = F.col("block") - F.lag("block").over(Window.partitionBy("top").orderBy("block"))
    gaps = blocks.withColumn("_gap", F.coalesce(step, F.lit(0)) - 1)
    # Cut where the gaps are largest; between neighbours there is none.
    place = F.row_number().over(Window.partitionBy("top").orderBy(F.col("_gap").desc(), "block"))
    cut = gaps.withColumn("_cut", ((F.col("_gap") > 0) & (place < MOST_RANGES)).cast("int"))
    run = cut.withColumn("_run", F.sum("_cut").over(Window.partitionBy("top").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    found = run.groupBy("top", "_run").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    out: dict[int, list[tuple[int, int]]] = {}
    for r in found.collect():  # MOST_RANGES for each level at most
        out.setdefault(r["top"], []).append((r["first"], r["last"]))
    return {top: sorted(ranges) for top, ranges in out.items()}


def written_layout(rows: DataFrame) -> tuple[DataFrame, str]:
    """Writes rows in a folder for each block and level, sorted by batch and place, and reads them back; with where they are.

    A task writes whole blocks, so there is one file of a block and level, and a filter on these two columns chooses files.
    """
    path = f"{shared_folder(rows.sparkSession)}/cloudweave/packed-{uuid.uuid4().hex}"
    names = [c for c in rows.columns if c not in ("block", "lod_level")]
    owned.add(path)
    rows.select(*names, "block", "lod_level").sortWithinPartitions("block", "lod_level", "batch_id", "local_idx").write.partitionBy("block", "lod_level").parquet(path)
    return rows.sparkSession.read.schema(rows.select(*names, "block", "lod_level").schema).parquet(path), path


def pack(points: DataFrame, config: PackConfig = PackConfig(), within: Bounds | None = None, block_points: int | None = None) -> PackedCloud:
    """Packs points (point_id, x, y, z, rgba): every point in a batch, batches in their shuffled order.

    An empty cloud has no batches and zero bounds. The cloud is written to the shared folder twice: sorted by its ranks,
    and packed in files by block (of block_points at most) and level; and its zone maps once. Files follow the Z-order,
    not the shuffled order in which batches are numbered, as what lies together is seen together. within: the bounds,
    where they are known.
    """
    b = within or bounds(points)
    with owned(points.sparkSession) as mine:  # the ranks are done with when the cloud is packed
        ranks, total = ranked_counted(morton_keys(points, b), "mk", ["point_id"], "pk")
        with file_by_file(points.sparkSession):
            rows, path = written_layout(quantised(batched(ranks, lod_claims(ranks, b, config, total), config, total, block_points)))
        mine.keep(path)
    zones = zone_maps(rows).withColumn("state", F.lit(1)).withColumn("file_index", F.lit(0))
    if config.shuffle_batches:
        zones = shuffle_batches(zones, config.points_per_batch, total)
    else:
        zones = zones.withColumn("new_id", F.col("batch_id")).withColumn("first_point", F.col("batch_id") * config.points_per_batch)
    return PackedCloud(rows, written(zones, "zones"), b, config)


def point_to_batch(indices: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id and local_idx of pack indices i, by the batch of the greatest first_point at or before i.

    Batches are the smaller side of a range join; it is an equi-join on the block of points_per_batch that an index
    lies in, to each of which belong at most the two batches that overlap it.
    """
    width = batches.agg(F.max("num_points").alias("w")).first()["w"] or 1
    spread = batches.where("state <> 0").withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_point") / F.lit(width)), F.floor((F.col("first_point") + F.col("num_points") - 1) / F.lit(width)))))
    keyed = indices.withColumn("_block", F.floor(F.col("i") / F.lit(width)))
    found = keyed.join(spread, "_block").where((F.col("first_point") <= F.col("i")) & (F.col("i") < F.col("first_point") + F.col("num_points")))
    return found.select("i", "batch_id", (F.col("i") - F.col("first_point")).alias("local_idx"))
