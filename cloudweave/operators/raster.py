"""Rasterisation: project, splat, depth and colour per pixel, and nearest winners.

A footprint makes tens of pixel rows of a point, so points are aggregated by the pixel of their centre before they are
splatted wherever the sums allow it: the largest depth of a pixel is the largest of the centres around it; translucent
sums add up the same way. For depth-tested colour a centre's points are told apart by which pixels of the footprint they
pass in: nearer points pass wherever farther ones do, so a centre has at most one class for each pixel of its footprint
(and one for none), and its points are summed by class before the splat. Edge weights are of few kinds, and a class has
sums for each. So no shuffle moves more than image-sized rows for each task, whatever the number of points. In footprints
of very many pixels, or of sizes that differ from point to point, a class is the highest of the limits around its centre
that a point reaches. Only edge weights of such footprints are splatted point by point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import IDENTITY, Camera, Cloud, Matrix, RasterConfig
from cloudweave.operators.tables import pinned, written

#: Images of at most this many pixels (times the columns of a pixel) are broadcast to the points; larger ones are joined
#: by shuffles, unless Spark finds them small.
BROADCAST_PIXELS = 1 << 18
#: Pixels of a footprint whose points are classed by a mask, and different weights of one.
MASK_PIXELS, MASK_WEIGHTS = 63, 8


def project(points: DataFrame, camera: Camera, config: RasterConfig, model: Matrix = IDENTITY) -> DataFrame:
    """Adds cx, cy (pixel, y down), ndc_z, depth and radius; points behind the camera or out of view go."""
    width, height = config.size
    m = camera.clip(model)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    clip = pinned(points, {f"_{n}": g.transform_row(m, k, x, y, z) for k, n in enumerate("xyzw")}).where("_w > 0")
    ndc = pinned(clip, {"_nx": F.col("_x") / F.col("_w"), "_ny": F.col("_y") / F.col("_w"), "ndc_z": F.col("_z") / F.col("_w")})
    seen = ndc.where("_nx between -1 and 1 and _ny between -1 and 1 and ndc_z between 0 and 1")
    px = F.floor((F.col("_nx") * 0.5 + 0.5) * width).cast("int")
    py = F.floor((F.col("_ny") * 0.5 + 0.5) * height).cast("int")
    placed = seen.withColumns({"cx": px, "_up": py}).where((F.col("cx") < width) & (F.col("_up") < height))
    radius = g.footprint_radius(config, camera, model, x, y, z)
    return placed.withColumns({"cy": F.lit(height - 1) - F.col("_up"), "depth": g.encode_depth(F.col("ndc_z")), "radius": F.lit(radius) if isinstance(radius, int) else radius}).drop(
        "_x", "_y", "_z", "_w", "_nx", "_ny", "_up"
    )


def _fixed_radius(config: RasterConfig, camera: Camera) -> int | None:
    r = g.footprint_radius(config, camera, IDENTITY, F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return r if isinstance(r, int) else None


def splat(centres: DataFrame, config: RasterConfig, camera: Camera, weighted: bool = False) -> DataFrame:
    """Rows of centres (cx, cy, radius, ...) for each pixel of their footprints, with px, py (and cov)."""
    width, height = config.size
    fixed = _fixed_radius(config, camera)
    if fixed is not None:
        spread = centres.withColumn("_o", F.explode(g.offsets(fixed, weighted)))
    else:
        cells = [(r, dx, dy, g.coverage(dx, dy, r)) for r in range(g.MAX_RADIUS + 1) for dx, dy in g.disc(r)]
        table = centres.sparkSession.createDataFrame([c for c in cells if c[3] > 0 or not weighted], "radius int, dx int, dy int, cov double")
        # 17 footprints, about 5,000 rows
        spread = centres.join(F.broadcast(table.select("radius", F.struct("dx", "dy", "cov").alias("_o"))), "radius")
    out = spread.withColumns({"px": F.col("cx") + F.col("_o.dx"), "py": F.col("cy") + F.col("_o.dy")} | ({"cov": F.col("_o.cov")} if weighted else {})).drop("_o")
    return out.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))


def depth_image(projected: DataFrame, config: RasterConfig, camera: Camera) -> DataFrame:
    """px, py, depth: the nearest depth of each covered pixel."""
    centres = projected.groupBy("cx", "cy", "radius").agg(F.max("depth").alias("depth"))
    return splat(centres, config, camera).groupBy("px", "py").agg(F.max("depth").alias("depth"))


def colours(projected: DataFrame, config: RasterConfig) -> DataFrame:
    """cr, cg, cb of points: their own, or that of their chunk or of overdraw, mixed with their tint."""
    if config.colorize_chunks:
        rgba = g._times(F.shiftrightunsigned("src_idx", 13).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), 1234567)
    elif config.colorize_overdraw:
        rgba = F.lit(0x010101).cast("bigint")
    else:
        rgba = F.col("rgba")
    out = projected.withColumns({f"c{n}": g.channel(rgba, k) for k, n in enumerate("rgb")})
    if config.apply_tint:
        out = out.where("tint_a >= 0 or tint_a is null")
        if not config.tint_alpha_is_coverage:
            w = g.saturate(F.coalesce("tint_a", g.num(0.0)))

            def mixed(n: str) -> Column:
                own = F.col(f"c{n}") * g.num(1.0 / 255.0)
                return F.floor(g.saturate(own + (g.saturate(F.coalesce(f"tint_{n}", g.num(0.0))) - own) * w) * 255.0 + 0.5).cast("bigint")

            out = out.withColumns({f"c{n}": mixed(n) for n in "rgb"})
    return out


def _sums() -> list[Column]:
    return [F.sum(f"c{n}").alias(f"sum_{n}") for n in "rgb"] + [F.count("*").alias("cnt")]


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("px", "py").agg(*(F.sum(f"sum_{n}").alias(f"sum_{n}") for n in "rgb"), F.sum("cnt").alias("cnt"))


def _sized(table: DataFrame, config: RasterConfig) -> DataFrame:
    """A table of at most a row a pixel (and radius) as the small side of a join, broadcast if its bound allows."""
    width, height = config.size
    return F.broadcast(table) if width * height <= BROADCAST_PIXELS else table


def near_enough(depth: Column, config: RasterConfig) -> Column:
    """The least ndc z that counts as a pixel's surface; a pixel of depth 0 has none."""
    return F.when(depth > 0, g.decode_depth(depth) * g.num(1.0 - config.depth_tolerance)).otherwise(float("inf"))


def _asked(depths: DataFrame, config: RasterConfig) -> DataFrame:
    return depths.select("px", "py", near_enough(F.col("depth"), config).alias("_least"))


def _cells(radius: int | None, weighted: bool = False) -> list[tuple[int, int, float]] | None:
    """The footprint of one radius, if its points may be classed by a mask of its pixels."""
    if radius is None:
        return None
    cells = [(dx, dy, g.coverage(dx, dy, radius) if weighted else 1.0) for dx, dy in g.disc(radius)]
    cells = [c for c in cells if c[2] > 0]
    return cells if len(cells) <= MASK_PIXELS and len({c[2] for c in cells}) <= MASK_WEIGHTS else None


def _masked(coloured: DataFrame, depths: DataFrame, cells: list[tuple[int, int, float]], config: RasterConfig) -> DataFrame:
    """Adds _mask, in which bit k is set if a point passes in the k-th pixel of its footprint; those that pass nowhere go."""
    at = F.expr("array(" + ", ".join(f"named_struct('dx', {dx}, 'dy', {dy}, 'k', {k})" for k, (dx, dy, _) in enumerate(cells)) + ")")
    around = _asked(depths, config).withColumn("_o", F.explode(at)).select((F.col("px") - F.col("_o.dx")).alias("cx"), (F.col("py") - F.col("_o.dy")).alias("cy"), F.col("_o.k").alias("k"), "_least")
    limits = around.groupBy("cx", "cy").agg(*(F.max(F.when(F.col("k") == k, F.col("_least"))).alias(f"_t{k}") for k in range(len(cells))))
    bits = [F.when(F.col("ndc_z") >= F.col(f"_t{k}"), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(len(cells))]
    judged = coloured.join(_sized(limits, config), ["cx", "cy"])
    return pinned(judged, {"_mask": sum(bits[1:], bits[0])}).where("_mask <> 0").drop(*(f"_t{k}" for k in range(len(cells))))


def _spread(classes: DataFrame, cells: list[tuple[int, int, float]], config: RasterConfig) -> DataFrame:
    """px, py, sum_r, sum_g, sum_b, cnt of classes (cx, cy, and these sums as arrays by weight), where their _mask allows."""
    width, height = config.size
    kinds = sorted({c for *_, c in cells})
    at = F.expr("array(" + ", ".join(f"named_struct('dx', {dx}, 'dy', {dy}, 'k', {k}, 'w', {kinds.index(c)})" for k, (dx, dy, c) in enumerate(cells)) + ")")
    spread = classes.withColumn("_o", F.explode(at))
    if "_mask" in classes.columns:
        spread = spread.where(F.expr("shiftright(_mask, _o.k) & 1 = 1"))
    names = ("sum_r", "sum_g", "sum_b", "cnt")
    placed = spread.select((F.col("cx") + F.col("_o.dx")).alias("px"), (F.col("cy") + F.col("_o.dy")).alias("py"), *(F.get(n, F.col("_o.w")).alias(n) for n in names))
    return _added(placed.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)))


def _radii(config: RasterConfig, camera: Camera) -> list[int]:
    """All radii that points may have where they have their own."""
    s = max(1.0, config.render_scale)
    low = max(min(config.minimum_point_size * s, config.maximum_point_size * s), 1.0)
    return list(range(g.radius_of(low), g.radius_of(max(config.maximum_point_size * s, config.minimum_point_size * s, low)) + 1))


def average_sums(projected: DataFrame, depths: DataFrame, config: RasterConfig, camera: Camera) -> DataFrame:
    """px, py, sum_r, sum_g, sum_b, cnt of all points in the depth band of each pixel."""
    fixed = _fixed_radius(config, camera)
    coloured = colours(projected, config)
    cells = _cells(fixed)
    if cells:
        classes = _masked(coloured, depths, cells, config).groupBy("cx", "cy", "_mask").agg(*_sums())
        return _spread(classes.select("cx", "cy", "_mask", *(F.array(n).alias(n) for n in ("sum_r", "sum_g", "sum_b", "cnt"))), cells, config)
    # What the depths around a centre ask of its points: footprints are symmetric, so pixels splat to centres alike.
    asked = _asked(depths, config)
    radius = F.lit(fixed) if fixed is not None else F.explode(F.lit(_radii(config, camera)))
    around = splat(asked.select(F.col("px").alias("cx"), F.col("py").alias("cy"), radius.alias("radius"), "_least"), config, camera)
    limits = around.groupBy(F.col("px").alias("cx"), F.col("py").alias("cy"), "radius").agg(F.min("_least").alias("_some"), F.max("_least").alias("_all"), F.collect_set("_least").alias("_limits"))
    # For each point: whether it counts in the whole footprint, or in some pixels of it.
    most = len(g.disc(fixed if fixed is not None else max(_radii(config, camera))))
    small = config.size[0] * config.size[1] * most <= BROADCAST_PIXELS * MASK_PIXELS
    judged = coloured.join(F.broadcast(limits) if small else limits, ["cx", "cy", "radius"]).where("ndc_z >= _some")
    # A point between two of the limits around its centre counts where one at the lower of them does.
    partly = F.when(F.col("ndc_z") < F.col("_all"), F.array_max(F.filter("_limits", lambda v: v <= F.col("ndc_z"))))
    # One pass over the points: a centre has a group for those that count everywhere, and one for each limit at most.
    centres = judged.groupBy("cx", "cy", "radius", partly.alias("_z")).agg(*_sums())
    rows = splat(centres, config, camera).join(_sized(asked, config), ["px", "py"]).where("_z is null or _z >= _least")
    return _added(rows)


def _weights(w: Column) -> dict[str, Column]:
    """Colour and weight of a point at a weight, in fixed point."""
    parts = {f"sum_{n}": F.floor(F.col(f"c{n}") * g.num(1.0 / 255.0) * w * g.num(g.WEIGHT) + 0.5).cast("bigint") for n in "rgb"}
    return parts | {"cnt": F.floor(w * g.num(g.WEIGHT) + 0.5).cast("bigint")}


def weighted_sums(projected: DataFrame, depths: DataFrame | None, config: RasterConfig, camera: Camera) -> DataFrame:
    """Edge-antialiased sums in fixed point; depth-tested where depths are given."""
    own = F.coalesce("alpha", g.num(1.0)) / F.coalesce("samples", F.lit(1)) if "alpha" in projected.columns else g.num(1.0)
    rows = colours(projected, config).withColumn("_w1", own)
    cells = _cells(_fixed_radius(config, camera), weighted=True)
    if cells:
        rows = rows if depths is None else _masked(rows, depths, cells, config)
        kinds = sorted({c for *_, c in cells})
        sums = {n: [F.sum(_weights(g.num(c) * F.col("_w1"))[n]) for c in kinds] for n in ("sum_r", "sum_g", "sum_b", "cnt")}
        keys = ["cx", "cy"] + ([] if depths is None else ["_mask"])
        return _spread(rows.groupBy(*keys).agg(*(F.array(*c).alias(n) for n, c in sums.items())), cells, config)
    rows = splat(rows, config, camera, weighted=True)
    if depths is not None:
        rows = rows.join(_sized(_asked(depths, config), config), ["px", "py"]).where("ndc_z >= _least")
    return rows.groupBy("px", "py").agg(*(F.sum(c).alias(n) for n, c in _weights(F.col("cov") * F.col("_w1")).items()))


def translucent_sums(projected: DataFrame, config: RasterConfig, camera: Camera) -> DataFrame:
    """Sums of colour * alpha and alpha in fixed point over all depths; points may be streaks of samples."""
    rows = colours(projected, config)
    alpha = g.saturate(1.0 - F.coalesce("tint_a", g.num(0.0))) if config.apply_tint and config.tint_alpha_is_coverage else g.num(1.0)
    rows = rows.withColumn("_alpha", alpha).where("_alpha > 0")
    samples = F.col("samples") if "samples" in projected.columns else F.lit(1)
    each = F.col("_alpha") / samples
    parts = {f"c{n}": F.floor(F.col(f"c{n}") * g.num(1.0 / 255.0) * each * g.num(g.WEIGHT) + 0.5).cast("bigint") for n in "rgb"}
    rows = rows.withColumns(parts | {"_wn": F.floor(each * g.num(g.WEIGHT) + 0.5).cast("bigint")})
    if "samples" in projected.columns:
        width, height = config.size
        rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)))
        # Footprints that reach into the image from outside it still count, so centres aren't cut off here.
        rows = rows.withColumns({"cx": (F.col("cx") - round_half_away(F.col("step_x") * F.col("_s"))).cast("int"), "cy": (F.col("cy") - round_half_away(F.col("step_y") * F.col("_s"))).cast("int")})
    centres = rows.groupBy("cx", "cy", "radius").agg(*(F.sum(f"c{n}").alias(f"sum_{n}") for n in "rgb"), F.sum("_wn").alias("cnt"))
    return _added(splat(centres, config, camera))


def round_half_away(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def motion(projected: DataFrame, camera_then: Camera, config: RasterConfig, model_then: Matrix = IDENTITY) -> DataFrame:
    """samples, step_x, step_y of points between their pixel and the one that the former camera had them at."""
    width, height = config.size
    m = camera_then.clip(model_then)
    names = projected.columns
    at = [F.col("base_" + a) if "base_" + a in names else F.col(a) for a in "xyz"]
    at = [a + F.coalesce(F.col("prev_d" + n), g.num(0.0)) if "prev_d" + n in names else a for a, n in zip(at, "xyz", strict=True)]
    clip = projected.withColumns({f"_{n}": g.transform_row(m, k, *at) for k, n in enumerate("xyzw")})
    seen = F.col("_w") > 0
    safe = F.when(seen, F.col("_w")).otherwise(1.0)
    trunc = lambda c: (F.signum(c) * F.floor(F.abs(c))).cast("bigint")
    px, py = trunc((F.col("_x") / safe * 0.5 + 0.5) * width), trunc((F.col("_y") / safe * 0.5 + 0.5) * height)
    moved = clip.withColumns({"_vx": (F.col("cx") - px) * g.num(config.motion_blur), "_vy": (F.col("cy") - (F.lit(height - 1) - py)) * g.num(config.motion_blur)})
    length = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))
    moved = moved.withColumn("_len", length)
    over = F.col("_len") > config.motion_blur_max_spread
    cut = F.when(over, g.num(config.motion_blur_max_spread) / F.col("_len")).otherwise(1.0)
    bounded = moved.withColumns({"_vx": F.col("_vx") * cut, "_vy": F.col("_vy") * cut, "_len": F.least("_len", g.num(config.motion_blur_max_spread))})
    streak = seen & (F.col("_len") > 0.75)
    samples = F.when(streak, g.clamp(F.ceil("_len").cast("int"), 1, config.motion_blur_samples)).otherwise(1)
    between = F.greatest(F.col("samples") - 1, F.lit(1))
    return bounded.withColumn("samples", samples).withColumns({"step_x": F.when(streak, F.col("_vx") / between).otherwise(0.0), "step_y": F.when(streak, F.col("_vy") / between).otherwise(0.0)}).drop("_x", "_y", "_z", "_w", "_vx", "_vy", "_len")


#: Indices below this go into one number with a depth.
NARROW = 1 << 31


def nearest_winners(projected: DataFrame, config: RasterConfig, camera: Camera, prefer: str = "min", wide: bool | None = None) -> DataFrame:
    """px, py, depth, src_idx, rgba of the nearest point of each pixel; ties by the least (or greatest) src_idx.

    Depth and index make one number whose order is theirs, so winners are found by hashed sums without a sort. Where
    indices are too wide for that, the nearest depth is found first, then the index among the points at that depth. wide:
    whether they are; looked up if it isn't known.
    """
    seen = projected.where("depth > 0")
    if wide is None:
        ends = seen.agg(F.min("src_idx").alias("low"), F.max("src_idx").alias("high")).first()
        wide = (ends["low"] or 0) < 0 or (ends["high"] or 0) >= NARROW
    if wide:
        return _winners_by_depth(seen, config, camera, prefer)
    place = F.lit(NARROW - 1) - F.col("src_idx") if prefer == "min" else F.col("src_idx")
    keyed = seen.select("cx", "cy", "radius", "rgba", F.shiftleft(F.col("depth").cast("bigint"), 31).bitwiseOR(place.cast("bigint")).alias("_key"))
    best = [F.max_by("rgba", "_key").alias("rgba"), F.max("_key").alias("_key")]
    pixels = splat(keyed.groupBy("cx", "cy", "radius").agg(*best), config, camera).groupBy("px", "py").agg(*best)
    index = F.col("_key").bitwiseAND(F.lit(NARROW - 1).cast("bigint"))
    return pixels.select("px", "py", F.shiftright("_key", 31).alias("depth"), (F.lit(NARROW - 1) - index if prefer == "min" else index).alias("src_idx"), "rgba")


def _winners_by_depth(seen: DataFrame, config: RasterConfig, camera: Camera, prefer: str) -> DataFrame:
    best = [F.min_by("rgba", "src_idx").alias("rgba"), F.min("src_idx").alias("src_idx")] if prefer == "min" else [F.max_by("rgba", "src_idx").alias("rgba"), F.max("src_idx").alias("src_idx")]

    def nearest(rows: DataFrame, at: list[str]) -> DataFrame:
        depths = rows.groupBy(*at).agg(F.max("depth").alias("depth"))
        return rows.join(_sized(depths, config), [*at, "depth"]).groupBy(*at, "depth").agg(*best)

    centres = written(nearest(seen.select("cx", "cy", "radius", "depth", "src_idx", "rgba"), ["cx", "cy", "radius"]), "centres")
    return nearest(splat(centres, config, camera), ["px", "py"]).select("px", "py", "depth", "src_idx", "rgba")


def accumulate(clouds: list[Cloud], camera: Camera, config: RasterConfig, camera_then: Camera | None = None) -> DataFrame:
    """px, py, depth, sum_r, sum_g, sum_b, cnt over all visible clouds: depth of all of them first, then colour."""
    from cloudweave.operators.features import displaced

    parts = None
    for cloud in clouds:
        if not cloud.is_visible:
            continue
        points = displaced(cloud.points) if config.apply_displacement else cloud.points
        rows = project(points, camera, config, cloud.model)
        if config.motion_blur > 0:
            rows = motion(rows, camera_then or camera, config, cloud.previous_model or cloud.model)
        parts = rows if parts is None else parts.unionByName(rows, allowMissingColumns=True)
    if parts is None:
        raise ValueError("no visible cloud")
    deep = parts.where("tint_a >= 0 or tint_a is null") if config.apply_tint and config.tint_alpha_is_coverage else parts
    # At most a row for each pixel; colour asks for it several times.
    depths = written(depth_image(deep, config, camera), "depths")
    if config.point_edge_antialiasing:
        sums = weighted_sums(parts, None if config.oit else depths, config, camera)
    elif config.oit:
        sums = translucent_sums(parts, config, camera)
    else:
        sums = average_sums(parts, depths, config, camera)
    return sums.join(depths, ["px", "py"], "left").select("px", "py", F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"), "sum_r", "sum_g", "sum_b", "cnt")
