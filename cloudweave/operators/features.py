"""Displacement and tint of points: user functions, their contract, and samples.

A displacement gives dx, dy, dz; a null or NaN in one deletes the point. A tint gives tint_r, tint_g, tint_b, tint_a: a
negative alpha discards the colour (in coverage mode the depth too, else the point still hides what is behind it).
Functions are Columns where they can be; a pandas function may give structs of the same fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import Camera, Matrix, multiply
from cloudweave.operators.tables import pinned

DISPLACEMENT = ("dx", "dy", "dz")
TINT = ("tint_r", "tint_g", "tint_b", "tint_a")
DISPLACEMENT_TYPE = "dx double, dy double, dz double"
TINT_TYPE = "r double, g double, b double, a double"


def with_displacement(points: DataFrame, delta: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Adds dx, dy, dz from a struct column (or a function of the points that gives one); null fields become NaN."""
    column = delta(points) if callable(delta) else delta
    placed = pinned(points, {"_d": column})
    return placed.withColumns({n: F.coalesce(F.col(f"_d.{n}"), F.lit(float("nan"))) for n in DISPLACEMENT}).drop("_d")


def with_tint(points: DataFrame, tint: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Adds tint_r, tint_g, tint_b, tint_a from a struct column of r, g, b, a."""
    column = tint(points) if callable(tint) else tint
    return pinned(points, {"_t": column}).withColumns({f"tint_{n}": F.col(f"_t.{n}") for n in "rgba"}).drop("_t")


def join_features(points: DataFrame, features: DataFrame) -> DataFrame:
    """Adds displacement and tint columns of a side table by src_idx; points that it lacks stay where they are."""
    names = [c for c in (*DISPLACEMENT, *TINT) if c in features.columns]
    marked = features.select("src_idx", F.lit(True).alias("_has"), *(F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in names))
    joined = points.join(marked, "src_idx", "left")
    return joined.withColumns({c: F.when(F.col("_has"), F.col(c)).otherwise(0.0) for c in names}).drop("_has")


def displaced(points: DataFrame) -> DataFrame:
    """Points moved by dx, dy, dz, without those that are deleted; where they were is base_x, base_y, base_z."""
    if "dx" not in points.columns:
        return points
    gone = F.lit(False)
    for n in DISPLACEMENT:
        gone = gone | F.isnull(n) | F.isnan(n)
    kept = points.where(~gone)
    moved = {f"base_{a}": F.col(a) for a in "xyz"} | {a: F.col(a) + F.col(f"d{a}") for a in "xyz"}
    return kept.withColumns(moved)


def sine_wave(frequency: float, amplitude: float, time: float) -> Column:
    """A wave along x that moves points up and down."""
    return F.struct(F.lit(0.0).alias("dx"), (F.sin(F.col("x") * g.num(frequency) + g.num(3.0 * time)) * g.num(amplitude)).alias("dy"), F.lit(0.0).alias("dz"))


def _hash01(index: Column, salt: int) -> Column:
    return g.hash_unit((index * 3 + salt).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def circle_of_confusion(camera: Camera, model: Matrix, focus: float, band: float, falloff: float) -> Column:
    """How far out of focus a point is, 0 to 1, by its distance from the focal plane beyond a sharp band."""
    depth = -g.transform_row(multiply(camera.view, model), 2, F.col("x"), F.col("y"), F.col("z"))
    return g.saturate((F.abs(depth - g.num(focus)) - g.num(band)) / g.num(falloff))


def defocus_scatter(coc: Column, index: Column, focus: float, scatter: float) -> Column:
    """Points out of focus are scattered by a hash of their index."""
    size = coc * coc * g.num(focus * scatter)
    return F.struct(*(((_hash01(index, k) * 2.0 - 1.0) * size).alias(n) for k, n in enumerate(DISPLACEMENT)))


def defocus_tint(coc: Column, most: float) -> Column:
    """Points out of focus let through what is behind them."""
    return F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), (coc * g.num(most)).alias("a"))


def decode_for_udf(points: DataFrame) -> DataFrame:
    """x, y, z as user functions see them: decoded by the point's level, so finer levels are coarser here."""
    words = (F.col("xyz_low"), F.col("xyz_med"), F.col("xyz_high"))
    return points.withColumns({a: g.decode(k, F.col(f"min_{a}"), F.col(f"max_{a}"), words, F.col("lod_level")) for k, a in enumerate("xyz")})
