"""Column functions of points, boxes and pixels. Everything is double or bigint arithmetic inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudweave.model import Camera, Matrix, PointSize, RasterConfig

TINY = 1e-6
#: Depth 1.0 in fixed point.
DEPTH_STEPS = 4294967294.0
MAX_RADIUS = 16
STEPS_30 = float(1 << 30)
ALMOST_ONE = 0.99999994
#: Fixed point of weights.
WEIGHT = 4096.0


def num(v: float) -> Column:
    return F.lit(float(v))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def saturate(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def transform_row(m: Matrix, row: int, x: Column, y: Column, z: Column) -> Column:
    """One row of a column-major matrix times (x, y, z, 1), summed from left to right."""
    return num(m[row]) * x + num(m[4 + row]) * y + num(m[8 + row]) * z + num(m[12 + row])


# --- pack keys ---


def grid10(p: Column, low: float, extent: float) -> Column:
    """A coordinate on a grid of 1024 cells over the bounds."""
    return clamp((p - num(low)) * num(1023.0 / max(extent, TINY)), 0.0, 1023.0).cast("bigint")


def spread10(v: Column) -> Column:
    """10 bits spread to every third of 30 (fixed masks of the Z-order interleave)."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(spread10(x), 2).bitwiseOR(F.shiftleft(spread10(y), 1)).bitwiseOR(spread10(z))


def voxel(p: Column, low: float, edge: float) -> Column:
    return F.floor((p - num(low)) / num(edge)).cast("bigint")


def quantise30(p: Column, low: Column, high: Column) -> Column:
    unit = (p - low) / F.greatest(high - low, num(TINY))
    return F.floor(clamp(unit, 0.0, ALMOST_ONE) * num(STEPS_30)).cast("bigint")


def word(qx: Column, qy: Column, qz: Column, which: str) -> Column:
    """10 bits of each axis in one word: low holds the most significant ones."""
    shift = {"low": 20, "med": 10, "high": 0}[which]
    part = [F.shiftright(q, shift).bitwiseAND(F.lit(1023).cast("bigint")) for q in (qx, qy, qz)]
    return part[0] + F.shiftleft(part[1], 10) + F.shiftleft(part[2], 20)


def unword(w: Column, axis: int) -> Column:
    return F.shiftright(w, 10 * axis).bitwiseAND(F.lit(1023).cast("bigint"))


def decode_step(low: Column, high: Column, precision: Column) -> Column:
    """The size of a cell that decode() counts in: of 30 bits at precision 0, 20 at 1, else 10."""
    size = F.greatest(high - low, num(TINY))
    return size / F.when(precision == 0, num(1 << 30)).when(precision == 1, num(1 << 20)).otherwise(num(1 << 10))


def decode_cells(axis: int, words: tuple[Column, Column, Column], precision: Column) -> Column:
    """How many cells a coordinate is from the low side of its box."""
    a, b, c = (unword(w, axis) for w in words)
    fine = F.shiftleft(a, 20).bitwiseOR(F.shiftleft(b, 10)).bitwiseOR(c)
    return F.when(precision == 0, fine).when(precision == 1, F.shiftleft(a, 10).bitwiseOR(b)).otherwise(a)


def decode(axis: int, low: Column, high: Column, words: tuple[Column, Column, Column], precision: Column) -> Column:
    """A coordinate from its words."""
    return decode_cells(axis, words, precision) * decode_step(low, high, precision) + low


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """RGBA8 of colours in 0 to 1, cut off."""
    byte = [saturate(c * 1.0) * num(255.0) for c in (r, g, b, a)]
    whole = [F.floor(v).cast("bigint") for v in byte]
    return whole[0] + F.shiftleft(whole[1], 8) + F.shiftleft(whole[2], 16) + F.shiftleft(whole[3], 24)


def channel(rgba: Column, k: int) -> Column:
    return F.shiftright(rgba, 8 * k).bitwiseAND(F.lit(255).cast("bigint"))


def _times(x: Column, c: int) -> Column:
    """x * c mod 2**32 of x below 2**32, without overflow of a bigint: a c of over 31 bits counts as c - 2**32."""
    return (x * F.lit(c - (1 << 32) if c >> 31 else c).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def hash_unit(x: Column) -> Column:
    """A hash of a 32-bit number to [0, 1) (fixed multipliers of a public integer hash)."""
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    x = _times(x, 0x7FEB352D)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
    x = _times(x, 0x846CA68B)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    return x * num(1.0 / 4294967296.0)


# --- frustum and levels of detail ---


def frustum_planes(m: Matrix) -> list[tuple[float, float, float, float]]:
    """Inward planes of a clip matrix, of unit normals: the sides, then far (depth 0 end) and near by 0 <= z <= w."""
    row = [[m[4 * c + r] for c in range(4)] for r in range(4)]
    sides = [(1, 0, -1), (1, 0, 1), (1, 1, 1), (1, 1, -1), (1, 2, -1), (0, 2, 1)]
    out = []
    for w, r, sign in sides:
        p = [w * row[3][c] + sign * row[r][c] for c in range(4)]
        n = max(math.sqrt(p[0] ** 2 + p[1] ** 2 + p[2] ** 2), TINY)
        out.append(tuple(v / n for v in p))
    return out


def in_frustum(m: Matrix) -> Column:
    """Whether a box (min_x .. max_z) is not wholly outside one plane."""
    keep = F.lit(True)
    for nx, ny, nz, d in frustum_planes(m):
        corner = [F.col(f"{'max' if n > 0 else 'min'}_{axis}") for n, axis in ((nx, "x"), (ny, "y"), (nz, "z"))]
        keep = keep & (num(nx) * corner[0] + num(ny) * corner[1] + num(nz) * corner[2] + num(d) >= 0.0)
    return keep


def view_centre(camera: Camera, model: Matrix) -> dict[str, Column]:
    """_vx, _vy, _vz of a box's centre as the camera sees it, and the length _diagonal of the box."""
    from cloudweave.model import multiply

    low, high = [F.col(f"min_{a}") for a in "xyz"], [F.col(f"max_{a}") for a in "xyz"]
    centre = [(a + b) * num(0.5) for a, b in zip(low, high, strict=True)]
    d = [b - a for a, b in zip(low, high, strict=True)]
    to_view = multiply(camera.view, model)
    return {f"_v{a}": transform_row(to_view, k, *centre) for k, a in enumerate("xyz")} | {"_diagonal": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])}


def diagonal_ends(camera: Camera, width: int, height: int) -> dict[str, Column]:
    """_ax, _ay, _bx, _by: the pixels of a centre (of view_centre), and of the point a diagonal to its right."""
    p = camera.projection
    out = {}
    for name, x in (("a", F.col("_vx")), ("b", F.col("_vx") + F.col("_diagonal"))):
        at = [transform_row(p, k, x, F.col("_vy"), F.col("_vz")) for k in (0, 1, 3)]
        w = F.greatest(F.abs(at[2]), num(TINY))
        out |= {f"_{name}x": num(width) * (at[0] / w + 1.0) * 0.5, f"_{name}y": num(height) * (at[1] / w + 1.0) * 0.5}
    return out


def pixel_size() -> Column:
    """Pixels that a box's diagonal spans at its centre, from diagonal_ends."""
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    return F.sqrt(dx * dx + dy * dy)


def precision_level(pixels: Column) -> Column:
    return F.when(pixels < 100.0, 4).when(pixels < 200.0, 3).when(pixels < 500.0, 2).when(pixels < 10000.0, 1).otherwise(0)


def lod_threshold(pixels: Column, config: RasterConfig) -> Column:
    if not config.enable_clod:
        return num(99.0)
    return F.greatest(F.log2(F.greatest(pixels, num(1.0)) / num(25.0)) + num(3.0) + num(config.lod_bias), num(0.0))


# --- pixels ---


def encode_depth(ndc_z: Column) -> Column:
    return F.least(F.floor(saturate(ndc_z) * num(DEPTH_STEPS)).cast("bigint"), F.lit(4294967295))


def decode_depth(depth: Column) -> Column:
    return depth.cast("double") / num(DEPTH_STEPS)


def radius_of(size: float) -> int:
    return min(max(math.ceil(max(size - 1.0, 0.0) * 0.5), 0), MAX_RADIUS)


def footprint_radius(config: RasterConfig, camera: Camera, model: Matrix, x: Column, y: Column, z: Column) -> Column | int:
    """Radius of a point's disc in pixels: one number in screen mode, a column in world mode."""
    from cloudweave.model import multiply

    s = max(1.0, config.render_scale)
    if config.point_size_mode is PointSize.SCREEN:
        return radius_of(config.point_size_scale * s)
    low = max(min(config.minimum_point_size * s, config.maximum_point_size * s), 1.0)
    high = max(max(config.minimum_point_size * s, config.maximum_point_size * s), low)
    focal = config.size[1] * 0.5 * camera.projection[5]
    if camera.is_orthographic:
        size = 2.0 * config.point_size_scale * focal
        return radius_of(min(max(size if math.isfinite(size) else low, low), high))
    view_z = F.greatest(-transform_row(multiply(camera.view, model), 2, x, y, z), num(TINY))
    size = num(2.0 * config.point_size_scale * focal) / view_z
    bounded = F.when(F.isnan(size) | (F.abs(size) == float("inf")), num(low)).otherwise(clamp(size, low, high))
    return clamp(F.ceil(F.greatest(bounded - 1.0, num(0.0)) * 0.5).cast("int"), 0, MAX_RADIUS)


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of a footprint, row by row."""
    if radius <= 0:
        return [(0, 0)]
    r = radius + 0.5
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= r * r]


def coverage(dx: int, dy: int, radius: int) -> float:
    if radius <= 0:
        return 1.0 if dx == dy == 0 else 0.0
    return min(max(radius + 0.5 - math.sqrt(dx * dx + dy * dy), 0.0), 1.0)


def offsets(radius: int, weighted: bool = False) -> Column:
    """The footprint of one radius as a literal array of structs (dx, dy) or (dx, dy, cov)."""
    cells = [(dx, dy, coverage(dx, dy, radius)) for dx, dy in disc(radius)]
    if weighted:
        return F.expr("array(" + ", ".join(f"named_struct('dx', {dx}, 'dy', {dy}, 'cov', {c!r}D)" for dx, dy, c in cells if c > 0) + ")")
    return F.expr("array(" + ", ".join(f"named_struct('dx', {dx}, 'dy', {dy})" for dx, dy, _ in cells) + ")")
