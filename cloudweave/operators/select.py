"""Selection: batches by frustum and size on screen, then points by level prefix and dithered level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import IDENTITY, Camera, Matrix, RasterConfig
from cloudweave.operators.pack import PackedCloud
from cloudweave.operators.tables import owned, pinned, ranked, written, written_at


def visible_batches(batches: DataFrame, camera: Camera, config: RasterConfig, model: Matrix = IDENTITY) -> DataFrame:
    """The batches of sized_batches that have points to draw.

    It works on zone maps alone, so what it drops is never joined to points.
    """
    return sized_batches(batches, camera, config, model).where("active_points > 0")


def sized_batches(batches: DataFrame, camera: Camera, config: RasterConfig, model: Matrix = IDENTITY) -> DataFrame:
    """All resident batches in the frustum, with pixel_size, precision, lod_threshold, top (the finest level of a point that
    is drawn) and active_points, of which there may be none. A null lod_cum keeps all points.
    """
    kept = batches.where("state <> 0")
    if config.enable_frustum_culling:
        kept = kept.where(g.in_frustum(camera.clip(model)))
    # Step by step, each worked out once: as one expression this is too large for the JVM to compile well.
    ends = pinned(pinned(kept, g.view_centre(camera, model)), g.diagonal_ends(camera, *config.size)).drop("_vx", "_vy", "_vz", "_diagonal")
    sized = pinned(ends, {"pixel_size": g.pixel_size()}).drop("_ax", "_ay", "_bx", "_by")
    levelled = pinned(sized, {"precision": g.precision_level(F.col("pixel_size")), "lod_threshold": g.lod_threshold(F.col("pixel_size"), config)})
    top = g.clamp(F.floor(F.col("lod_threshold") + 0.5).cast("int"), 0, 7)
    counted = pinned(levelled, {"top": F.when(F.col("lod_cum").isNull(), F.lit(7)).otherwise(top)})
    return counted.withColumn("active_points", F.coalesce(F.get("lod_cum", "top"), F.col("num_points")))


def visible_batches_of_files(batches: DataFrame, camera: Camera, config: RasterConfig, models: dict[int, Matrix]) -> DataFrame:
    """As visible_batches, of batches whose file_index names the file that they come from, each file with its own model.

    Matrices are literals, one part of the plan for each file; files without one stand where they are.
    """
    rest = batches if not models else batches.where(~F.coalesce(F.col("file_index").isin(*models), F.lit(False)))
    out = visible_batches(rest, camera, config)
    for index, model in models.items():
        out = out.unionByName(visible_batches(batches.where(F.col("file_index") == index), camera, config, model))
    return out


def kept_level(lod_level: Column, threshold: Column, index: Column, dither: bool) -> Column:
    """Whether a point's level is within the threshold, dithered by a hash of its pack index."""
    by = g.hash_unit(index.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))) if dither else g.num(0.5)
    return by < threshold - lod_level + g.num(0.5)


def select_points(packed: PackedCloud, camera: Camera, config: RasterConfig, model: Matrix = IDENTITY) -> DataFrame:
    """src_idx (pack index), point_id, decoded x, y, z, rgba and lod_level of the selected points.

    Only the files of blocks and levels that the visible batches ask for are read. The selection is written to the shared
    folder: it is asked for by depth and by colour, and by later frames of the same camera.
    """
    return kept_selection(packed, camera, config, model)[0]


def kept_selection(packed: PackedCloud, camera: Camera, config: RasterConfig, model: Matrix = IDENTITY) -> tuple[DataFrame, str]:
    """As select_points, with the path of the table, for one who deletes it."""
    with owned(packed.batches.sparkSession) as mine:  # the zone maps that were seen are done with
        out, path = written_at(selected_points(packed, camera, config, model), "selected")
        mine.keep(path)
    return out, path


def selected_points(packed: PackedCloud, camera: Camera, config: RasterConfig, model: Matrix = IDENTITY) -> DataFrame:
    """As select_points, for one use."""
    # What is the same for all points of a batch is worked out on its zone map. These are one row for points_per_batch
    # points; Spark chooses the join by their size.
    seen = visible_batches(packed.batches, camera, config, model)
    steps = {f"_step_{a}": g.decode_step(F.col(f"min_{a}"), F.col(f"max_{a}"), F.col("precision")) for a in "xyz"}
    zones = written(seen.select("batch_id", *(c for c in ("block", "top") if c in seen.columns), "first_point", "active_points", "lod_threshold", "precision", "min_x", "min_y", "min_z", *(c.alias(n) for n, c in steps.items())), "visible")
    joined = packed.scan(zones).select("batch_id", "local_idx", "point_id", "xyz_low", "xyz_med", "xyz_high", "rgba", "lod_level").join(zones.drop("block", "top"), "batch_id").where("local_idx < active_points")
    indexed = pinned(joined, {"src_idx": F.col("first_point") + F.col("local_idx")})
    chosen = indexed.where(kept_level(F.col("lod_level"), F.col("lod_threshold"), F.col("src_idx"), config.enable_lod_dither))
    words = (F.col("xyz_low"), F.col("xyz_med"), F.col("xyz_high"))
    place = {a: g.decode_cells(k, words, F.col("precision")) * F.col(f"_step_{a}") + F.col(f"min_{a}") for k, a in enumerate("xyz")}
    return chosen.select("src_idx", "point_id", "batch_id", "lod_level", "rgba", *(c.alias(a) for a, c in place.items()))


def capped(selected: DataFrame, capacity: int) -> DataFrame:
    """The points of the least src_idx, `capacity` at most (the cap is the feature: a fixed survivor buffer).

    A capacity may be as large as the cloud, so points are numbered in ranges, not gathered in one task.
    """
    return ranked(selected, "src_idx", [], "_place").where(F.col("_place") < capacity).drop("_place")


def selection_stats(selected: DataFrame, capacity: int) -> DataFrame:
    """One row: survivors, overflow beyond the capacity, and what is kept."""
    n = F.count("*")
    return selected.agg(n.alias("appended"), F.greatest(n - capacity, F.lit(0)).alias("overflow"), F.least(n, F.lit(capacity)).alias("kept"))
