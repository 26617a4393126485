"""Resolving pixels to an image: rejection, averages, hole filling, compositing and picking.

All tables here have at most a row for each pixel of the image.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import Camera, Cloud, RasterConfig, RenderMode
from cloudweave.operators import raster
from cloudweave.operators.tables import written

REJECT_RADIUS = 3
LOG = logging.getLogger("cloudweave")


def _neighbours(radius: int) -> Column:
    cells = [f"named_struct('dx', {dx}, 'dy', {dy})" for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx or dy]
    return F.expr(f"array({', '.join(cells)})")


def _inside(config: RasterConfig) -> Column:
    width, height = config.size
    return (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)


def view_position(px: Column, py: Column, depth: Column, camera: Camera, config: RasterConfig) -> list[Column]:
    """The view-space position of a pixel's centre at its depth."""
    width, height = config.size
    nx = (px + 0.5) / num_(width) * 2.0 - 1.0
    ny = (F.lit(height - 1) - py + 0.5) / num_(height) * 2.0 - 1.0
    nz = g.decode_depth(depth)
    m = camera.inverse_projection
    w = g.transform_row(m, 3, nx, ny, nz)
    return [g.transform_row(m, k, nx, ny, nz) / w for k in range(3)]


def num_(v: float) -> Column:
    return F.lit(float(v))


def rejected(pixels: DataFrame, camera: Camera, config: RasterConfig) -> DataFrame:
    """px, py of pixels that nearer neighbours within 7x7 hide: the widest free cone towards the eye is too narrow.

    A neighbour counts if it is nearer by more than the depth tolerance. The least angle to the eye's direction is under
    the threshold just if the greatest cosine is over the threshold's, so no inverse cosine is taken. pixels: px, py,
    depth of covered pixels.
    """
    table = written(pixels.select("px", "py", "depth").where("depth > 0"), "covered")
    v = view_position(F.col("px"), F.col("py"), F.col("depth"), camera, config)
    placed = table.withColumns(dict(zip(("vx", "vy", "vz"), v, strict=True)))
    sent = placed.withColumn("_o", F.explode(_neighbours(REJECT_RADIUS))).select((F.col("px") + F.col("_o.dx")).alias("px"), (F.col("py") + F.col("_o.dy")).alias("py"), *(F.col(c).alias(f"n_{c}") for c in ("depth", "vx", "vy", "vz")))
    pairs = placed.join(sent, ["px", "py"]).where((F.col("n_depth") > F.col("depth")) & (g.decode_depth(F.col("n_depth")) > g.decode_depth(F.col("depth")) * num_(1.0 + config.depth_tolerance)))
    d = [F.col(f"n_{c}") - F.col(c) for c in ("vx", "vy", "vz")]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    if camera.is_orthographic:
        cosine = d[2] / F.col("_len")
    else:
        own = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
        cosine = (-F.col("vx") * d[0] - F.col("vy") * d[1] - F.col("vz") * d[2]) / (own * F.col("_len"))
    cones = pairs.withColumn("_len", length).where("_len >= 1e-6").withColumn("_cos", g.clamp(cosine, -1.0, 1.0)).groupBy("px", "py").agg(F.max("_cos").alias("_cos"))
    return cones.where(F.col("_cos") > math.cos(config.rejection_cone_threshold)).select("px", "py")


def resolve(pixels: DataFrame, camera: Camera, config: RasterConfig) -> DataFrame:
    """px, py, r, g, b, a, depth of the covered pixels of accumulated sums; pixels that are not in it are background."""
    cnt = F.col("cnt").cast("double")
    mean = [F.col(f"sum_{n}") / cnt for n in "rgb"]
    depth = g.decode_depth(F.col("depth"))
    if config.oit:
        colour, alpha = mean, g.saturate(1.0 - F.exp(-(cnt / num_(g.WEIGHT))))
    elif config.point_edge_antialiasing:
        colour, alpha = mean, g.saturate(cnt / num_(g.WEIGHT))
    else:
        colour, alpha = [m / 255.0 for m in mean], num_(1.0)
    rows = pixels.where("cnt > 0")
    if config.enable_point_rejection and not config.oit:
        rows = written(rows, "pixels")
        rows = rows.join(rejected(rows, camera, config), ["px", "py"], "left_anti")
    return rows.select("px", "py", *(c.alias(n) for c, n in zip(colour, "rgb", strict=True)), alpha.alias("a"), depth.alias("depth"))


def resolve_nearest(winners: DataFrame, camera: Camera, config: RasterConfig) -> DataFrame:
    """px, py, r, g, b, a, depth, src_idx of winners, without those that nearer neighbours hide."""
    rows = winners
    if config.enable_point_rejection:
        rows = written(rows, "winners")
        rows = rows.join(rejected(rows, camera, config), ["px", "py"], "left_anti")
    return rows.select("px", "py", *((g.channel(F.col("rgba"), k) / 255.0).alias(n) for k, n in enumerate("rgb")), num_(1.0).alias("a"), g.decode_depth(F.col("depth")).alias("depth"), "src_idx")


def bytes_image(image: DataFrame) -> DataFrame:
    """An image as it is stored: 8 bits a channel (ri, gi, bi, ai), depth in fixed point (d)."""
    to8 = lambda n: F.floor(g.saturate(F.col(n)) * 255.0 + 0.5).cast("bigint").alias(f"{n}i")
    return image.select("px", "py", *(to8(n) for n in "rgba"), g.encode_depth(F.col("depth")).alias("d"))


def hole_filled(stored: DataFrame, config: RasterConfig, iterations: int | None = None) -> DataFrame:
    """px, py, ri, gi, bi, ai, d after filling pixels of alpha under one half from their 3x3 neighbours.

    Each round is one aggregation: pixels send themselves to their own place, and those that are valid also to the eight
    around them. A place keeps its own valid pixel, else takes the mean of what it got, else keeps what it had. Sums are
    of integers, and colours are 8 bits again after each round.
    """
    rows = stored
    around = F.expr(f"array({', '.join(f'named_struct({chr(39)}dx{chr(39)}, {dx}, {chr(39)}dy{chr(39)}, {dy})' for dy in (-1, 0, 1) for dx in (-1, 0, 1))})")
    for _ in range(config.hole_fill_iterations if iterations is None else iterations):
        valid = 2 * F.col("ai") >= 255
        alone = F.filter(around, lambda o: (o["dx"] == 0) & (o["dy"] == 0))
        sent = rows.withColumn("_valid", valid).withColumn("_o", F.explode(F.when(F.col("_valid"), around).otherwise(alone)))
        sent = sent.withColumn("_own", (F.col("_o.dx") == 0) & (F.col("_o.dy") == 0)).withColumns({"px": F.col("px") + F.col("_o.dx"), "py": F.col("py") + F.col("_o.dy")}).where(_inside(config))
        channels = ("ri", "gi", "bi", "d")
        other = F.col("_valid") & ~F.col("_own")
        got = sent.groupBy("px", "py").agg(
            F.max(F.when(F.col("_own"), F.struct("_valid", "ri", "gi", "bi", "ai", "d"))).alias("own"), F.count_if(other).alias("n"), *(F.sum(F.when(other, F.col(c))).alias(f"s_{c}") for c in channels)
        )
        fill = ~F.coalesce("own._valid", F.lit(False)) & (F.col("n") > 0)
        mean = lambda c: F.floor(F.col(f"s_{c}") / F.col("n") + 0.5).cast("bigint")
        rows = got.select("px", "py", *(F.when(fill, mean(c)).otherwise(F.col(f"own.{c}")).alias(c) for c in ("ri", "gi", "bi")), F.when(fill, F.lit(255).cast("bigint")).otherwise(F.col("own.ai")).alias("ai"), F.when(fill, mean("d")).otherwise(F.col("own.d")).alias("d"))
    return rows


def dense(image: DataFrame, config: RasterConfig) -> DataFrame:
    """An image with a row for every pixel; those that are not covered are background of alpha and depth 0."""
    width, height = config.size
    every = image.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))
    filled = every.join(image, ["px", "py"], "left")
    back = dict(zip("rgb", config.background, strict=True)) | {"a": 0.0, "depth": 0.0}
    return filled.select("px", "py", *(F.coalesce(n, num_(v)).alias(n) for n, v in back.items()))


def downsampled(image: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor pixels; pixels that are not in the image count as empty. Depth is the nearest."""
    n = float(factor * factor)
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("px", "py")]
    return image.groupBy(*cell).agg(*((F.sum(F.col(c) * F.col("a")) / F.sum("a")).alias(c) for c in "rgb"), (F.sum("a") / n).alias("a"), F.max("depth").alias("depth"))


def in_viewport(image: DataFrame, origin: tuple[int, int], scale: int = 1) -> DataFrame:
    """The image moved (and blown up by whole pixels) to a part of a larger one."""
    out = image
    if scale > 1:
        cells = ", ".join(f"named_struct('dx', {dx}, 'dy', {dy})" for dy in range(scale) for dx in range(scale))
        out = out.withColumn("_o", F.explode(F.expr(f"array({cells})"))).withColumns({"px": F.col("px") * scale + F.col("_o.dx"), "py": F.col("py") * scale + F.col("_o.dy")}).drop("_o")
    return out.withColumns({"px": (F.col("px") + origin[0]).cast("int"), "py": (F.col("py") + origin[1]).cast("int")})


def composite_over(image: DataFrame, scene: DataFrame) -> DataFrame:
    """The image blended over a scene (same columns), whatever their depths; the scene's depth stays."""
    c, s = image.alias("c"), scene.alias("s")
    a = F.coalesce(F.col("c.a"), num_(0.0))
    blend = lambda n: F.when(F.col("s.a").isNull(), F.col(f"c.{n}")).otherwise(F.coalesce(F.col(f"c.{n}"), num_(0.0)) * a + F.col(f"s.{n}") * (1.0 - a)).alias(n)
    over = F.coalesce(F.col("s.a"), num_(0.0))
    return c.join(s, ["px", "py"], "full").select("px", "py", *(blend(n) for n in "rgb"), (a + over * (1.0 - a)).alias("a"), F.coalesce(F.col("s.depth"), num_(0.0)).alias("depth"))


def composite_depth(image: DataFrame, scene: DataFrame) -> DataFrame:
    """Of each pixel the image's where it is covered and not behind the scene, else the scene's."""
    c, s = image.where("depth > 0").alias("c"), scene.alias("s")
    front = F.col("c.depth").isNotNull() & (F.col("c.depth") >= F.coalesce(F.col("s.depth"), num_(0.0)))
    return c.join(s, ["px", "py"], "full").select("px", "py", *(F.when(front, F.col(f"c.{n}")).otherwise(F.col(f"s.{n}")).alias(n) for n in ("r", "g", "b", "a", "depth")), front.alias("from_cloud"))


def pick(winners: DataFrame, ndc: tuple[float, float], config: RasterConfig, radius: int = 10) -> DataFrame:
    """src_idx, px, py, d2 of the covered pixel nearest to a place on screen within a radius (a top-1 report).

    Ties go to the first row, then the first pixel in it.
    """
    width, height = config.size
    cx = min(max(int((ndc[0] * 0.5 + 0.5) * width), 0), width - 1)
    cy = min(max(height - 1 - int((ndc[1] * 0.5 + 0.5) * height), 0), height - 1)
    r = math.floor(max(0, radius) * max(1.0, config.render_scale) + 0.5)
    dx, dy = F.col("px") - cx, F.col("py") - cy
    near = winners.withColumn("d2", (dx * dx + dy * dy).cast("bigint")).where(F.col("d2") <= r * r)
    return near.orderBy("d2", "py", "px").limit(1).select("src_idx", "px", "py", "d2")


def render(clouds: list[Cloud], camera: Camera, config: RasterConfig, camera_then: Camera | None = None) -> DataFrame:
    """The image of the visible clouds. Nearest mode shows the first visible cloud alone."""
    if config.render_mode is RenderMode.NEAREST:
        first = next((c for c in clouds if c.is_visible), None)
        if first is None:
            raise ValueError("no visible cloud")
        image = resolve_nearest(raster.nearest_winners(raster.project(first.points, camera, config, first.model), config, camera), camera, config)
    else:
        image = resolve(raster.accumulate(clouds, camera, config, camera_then), camera, config)
    if not config.hole_fill_iterations:
        return image
    filled = hole_filled(bytes_image(image), config)
    return filled.select("px", "py", *((F.col(f"{n}i") / 255.0).alias(n) for n in "rgba"), g.decode_depth(F.col("d")).alias("depth"))


_warned: set[str] = set()


def warn_overflow(name: str, overflow: int, capacity: int) -> bool:
    """Says once for each cloud that its survivors went beyond the capacity."""
    if overflow <= 0 or name in _warned:
        return False
    _warned.add(name)
    LOG.warning("%s: %d selected points are beyond the capacity of %d", name, overflow, capacity)
    return True
