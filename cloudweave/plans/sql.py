"""Fragments of DuckDB SQL, from which the catalog's SQL is put together."""

from __future__ import annotations

from cloudweave.functions import geometry as g
from cloudweave.model import IDENTITY, Camera, Matrix, RasterConfig, multiply


def d(v: float) -> str:
    """A double, exactly."""
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def row(m: Matrix, k: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    return f"({d(m[k])} * ({x}) + {d(m[4 + k])} * ({y}) + {d(m[8 + k])} * ({z}) + {d(m[12 + k])})"


def clamp(e: str, low: str, high: str) -> str:
    return f"least(greatest({e}, {low}), {high})"


LINE = "l_quantity / CAST(50 AS DOUBLE) - CAST('0.51' AS DOUBLE) AS x, l_extendedprice / CAST(105000 AS DOUBLE) - CAST('0.504' AS DOUBLE) AS y, l_discount * CAST(10 AS DOUBLE) - CAST('0.5' AS DOUBLE) AS z, (l_partkey & 255) + ((l_suppkey & 255) << 8) + ((l_orderkey & 255) << 16) + 4278190080 AS rgba"
ALL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
PTS = f"pts AS (SELECT {LINE} FROM lineitem)"
NUM = f"pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {ALL}) - 1 AS point_id, row_number() OVER (ORDER BY {ALL}) - 1 AS src_idx, {LINE} FROM lineitem)"
ORD = "pts2 AS (SELECT o_custkey / CAST(1500 AS DOUBLE) - CAST('0.5' AS DOUBLE) AS x, o_totalprice / CAST(500000 AS DOUBLE) - CAST('0.5' AS DOUBLE) AS y, (o_orderkey % 1000) / CAST(1000 AS DOUBLE) - CAST('0.3' AS DOUBLE) AS z, (o_custkey & 255) + ((o_orderkey & 255) << 8) + ((o_custkey & 255) << 16) + 4278190080 AS rgba FROM orders)"


def channel(k: int, e: str = "rgba") -> str:
    return f"((({e}) >> {8 * k}) & 255)"


def times(x: str, c: int) -> str:
    return f"((({x}) * {c}::HUGEINT) % 4294967296)::BIGINT"


def hashed(x: str) -> str:
    a = f"xor({x}, ({x}) >> 16)"
    b = times(a, 0x7FEB352D)
    c = f"xor({b}, ({b}) >> 15)"
    e = times(c, 0x846CA68B)
    return f"(xor({e}, ({e}) >> 16) * {d(1.0 / 4294967296.0)})"


def projected(source: str, camera: Camera, config: RasterConfig, model: Matrix = IDENTITY, name: str = "proj", extra: str = "") -> str:
    """CTEs that add cx, cy, ndc_z, depth to source."""
    w, h = config.size
    m = camera.clip(model)
    return f"""{name}_c AS (SELECT *, {row(m, 0)} AS qx, {row(m, 1)} AS qy, {row(m, 2)} AS qz, {row(m, 3)} AS qw{extra} FROM {source}),
{name}_n AS (SELECT *, qx / qw AS nx, qy / qw AS ny, qz / qw AS ndc_z FROM {name}_c WHERE qw > 0),
{name}_p AS (SELECT *, floor((nx * 0.5 + 0.5) * {w})::BIGINT AS cx, floor((ny * 0.5 + 0.5) * {h})::BIGINT AS up,
  least(floor({clamp('ndc_z', '0', '1')} * {d(g.DEPTH_STEPS)})::BIGINT, 4294967295) AS depth
  FROM {name}_n WHERE nx BETWEEN -1 AND 1 AND ny BETWEEN -1 AND 1 AND ndc_z BETWEEN 0 AND 1),
{name} AS (SELECT *, {h} - 1 - up AS cy FROM {name}_p WHERE cx < {w} AND up < {h})"""


def offsets(radius: int, name: str = "off") -> str:
    values = ", ".join(f"({dx}, {dy}, {d(g.coverage(dx, dy, radius))})" for dx, dy in g.disc(radius))
    return f"{name} AS (SELECT * FROM (VALUES {values}) AS t(dx, dy, cov))"


def splats(config: RasterConfig, source: str = "proj", name: str = "spl") -> str:
    w, h = config.size
    return f"{name} AS (SELECT {source}.*, cx + dx AS px, cy + dy AS py, cov FROM {source}, off WHERE cx + dx BETWEEN 0 AND {w - 1} AND cy + dy BETWEEN 0 AND {h - 1})"


def depths(source: str = "spl", name: str = "dep") -> str:
    return f"{name} AS MATERIALIZED (SELECT px, py, max(depth) AS depth FROM {source} GROUP BY px, py)"


def banded(config: RasterConfig, source: str = "spl", dep: str = "dep", name: str = "band") -> str:
    return f"{name} AS (SELECT s.*, {dep}.depth AS pixel_depth FROM {source} s JOIN {dep} USING (px, py) WHERE {dep}.depth > 0 AND ndc_z >= {dep}.depth / {d(g.DEPTH_STEPS)} * {d(1.0 - config.depth_tolerance)})"


def averages(source: str = "band", dep: str = "dep", name: str = "pix", rgba: str = "rgba") -> str:
    return f"{name} AS MATERIALIZED (SELECT px, py, max(pixel_depth)::BIGINT AS depth, sum({channel(0, rgba)})::BIGINT AS sum_r, sum({channel(1, rgba)})::BIGINT AS sum_g, sum({channel(2, rgba)})::BIGINT AS sum_b, count(*)::BIGINT AS cnt FROM {source} GROUP BY px, py)"


def average_pixels(camera: Camera, config: RasterConfig, radius: int, source: str = "pts", rgba: str = "rgba", model: Matrix = IDENTITY) -> str:
    return ",\n".join([projected(source, camera, config, model), offsets(radius), splats(config), depths(), banded(config), averages(rgba=rgba)])


PIXELS = "SELECT px, py, depth, sum_r, sum_g, sum_b, cnt FROM pix"


def view(px: str, py: str, depth: str, camera: Camera, config: RasterConfig, k: int) -> str:
    w, h = config.size
    nx, ny, nz = f"(({px} + 0.5) / {d(w)} * 2.0 - 1.0)", f"(({h} - 1 - {py} + 0.5) / {d(h)} * 2.0 - 1.0)", f"({depth} / {d(g.DEPTH_STEPS)})"
    return f"({row(camera.inverse_projection, k, nx, ny, nz)} / {row(camera.inverse_projection, 3, nx, ny, nz)})"


# --- packing ---

BOUNDS = "bnd AS MATERIALIZED (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM pts)"


def spread(e: str) -> str:
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        e = f"((({e}) | (({e}) << {shift})) & {mask})"
    return e


def morton() -> str:
    cell = lambda a: f"trunc({clamp(f'({a} - {a}0) * ({d(1023)} / greatest({a}1 - {a}0, {d(1e-6)}))', '0', '1023')})::BIGINT"
    return f"""mor_c AS (SELECT pts.*, {cell('x')} AS gx, {cell('y')} AS gy, {cell('z')} AS gz FROM pts, bnd),
mor AS (SELECT *, ({spread('gx')} << 2) | ({spread('gy')} << 1) | {spread('gz')} AS mk FROM mor_c),
rnk AS MATERIALIZED (SELECT * EXCLUDE (gx, gy, gz), row_number() OVER (ORDER BY mk, point_id) - 1 AS pk FROM mor)"""


def lods(levels: int, divisions: int) -> str:
    out, source = [], "rnk0"
    out.append("rnk0 AS (SELECT *, NULL::INTEGER AS lod_level FROM rnk)")
    for k in range(levels - 1):
        edge = f"(greatest(x1 - x0, y1 - y0, z1 - z0, {d(1e-6)}) / {d(divisions)} * {d(0.5**k)})"
        cell = ", ".join(f"floor(({a} - {a}0) / {edge})" for a in "xyz")
        won = f"CASE WHEN lod_level IS NULL AND pk = min(CASE WHEN lod_level IS NULL THEN pk END) OVER (PARTITION BY {cell}) THEN {k} END"
        out.append(f"rnk{k + 1} AS MATERIALIZED (SELECT {source}.* EXCLUDE (lod_level), coalesce(lod_level, {won}) AS lod_level FROM {source}, bnd)")
        source = f"rnk{k + 1}"
    out.append(f"lod AS MATERIALIZED (SELECT * EXCLUDE (lod_level), coalesce(lod_level, {levels - 1}) AS lod_level FROM {source})")
    return ",\n".join(out)


def batches(per_batch: int) -> str:
    cum = ", ".join(f"count(*) FILTER (lod_level <= {k})" for k in range(8))
    return f"""bat AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY lod_level, pk) - 1 AS local_idx FROM (SELECT *, pk // {per_batch} AS batch_id FROM lod)),
zon0 AS (SELECT batch_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, count(*) AS num_points, [{cum}] AS lod_cum FROM bat GROUP BY batch_id),
lst AS (SELECT max(batch_id) AS l FROM zon0),
zon1 AS (SELECT zon0.*, CASE WHEN (batch_id % 2 = 1 AND batch_id < l - batch_id) OR ((l - batch_id) % 2 = 1 AND l - batch_id < batch_id) THEN l - batch_id ELSE batch_id END AS new_id FROM zon0, lst),
zon AS MATERIALIZED (SELECT *, coalesce(sum(num_points) OVER (ORDER BY new_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_point FROM zon1)"""


def packed(levels: int, divisions: int, per_batch: int) -> str:
    return ",\n".join([NUM, BOUNDS, morton(), lods(levels, divisions), batches(per_batch)])


def quantised() -> str:
    q = lambda a: f"floor({clamp(f'({a} - min_{a}) / greatest(max_{a} - min_{a}, {d(1e-6)})', '0', d(g.ALMOST_ONE))} * {d(1 << 30)})::BIGINT AS q{a}"
    word = lambda s: " + ".join(f"(((q{a} >> {s}) & 1023) << {10 * k})" for k, a in enumerate("xyz"))
    return f"""qnt AS (SELECT bat.*, min_x, min_y, min_z, max_x, max_y, max_z, {q('x')}, {q('y')}, {q('z')} FROM bat JOIN zon USING (batch_id)),
wrd AS (SELECT *, {word(20)} AS xyz_low, {word(10)} AS xyz_med, {word(0)} AS xyz_high FROM qnt)"""


def decoded(precision: str) -> str:
    """x, y, z of words at a precision, as select items."""
    out = []
    for k, a in enumerate("xyz"):
        p = [f"(({w} >> {10 * k}) & 1023)" for w in ("xyz_low", "xyz_med", "xyz_high")]
        size = f"greatest(max_{a} - min_{a}, {d(1e-6)})"
        fine, mid = f"(({p[0]} << 20) | ({p[1]} << 10) | {p[2]})", f"(({p[0]} << 10) | {p[1]})"
        out.append(f"CASE WHEN {precision} = 0 THEN {fine} * ({size} / {d(1 << 30)}) WHEN {precision} = 1 THEN {mid} * ({size} / {d(1 << 20)}) ELSE {p[0]} * ({size} / {d(1 << 10)}) END + min_{a} AS {a}")
    return ", ".join(out)


def frustum(m: Matrix) -> str:
    parts = []
    for nx, ny, nz, off in g.frustum_planes(m):
        c = [f"{'max' if n > 0 else 'min'}_{a}" for n, a in ((nx, "x"), (ny, "y"), (nz, "z"))]
        parts.append(f"{d(nx)} * {c[0]} + {d(ny)} * {c[1]} + {d(nz)} * {c[2]} + {d(off)} >= 0")
    return " AND ".join(parts)


def visible(camera: Camera, config: RasterConfig, cull: bool = True, source: str = "zon", name: str = "vis") -> str:
    w, h = config.size
    v, p = multiply(camera.view, IDENTITY), camera.projection
    centre = [f"((min_{a} + max_{a}) * 0.5)" for a in "xyz"]
    vx, vy, vz = (row(v, k, *centre) for k in range(3))
    at = lambda x, k: row(p, k, x, "vy", "vz")
    ww = lambda x: f"greatest(abs({at(x, 3)}), {d(1e-6)})"
    sx, sy = lambda x: f"({d(w)} * ({at(x, 0)} / {ww(x)} + 1.0) * 0.5)", lambda x: f"({d(h)} * ({at(x, 1)} / {ww(x)} + 1.0) * 0.5)"
    level = f"greatest(log2(greatest(pixel_size, 1) / 25) + 3 + {config.lod_bias}, 0)" if config.enable_clod else "99.0::DOUBLE"
    return f"""{name}_v AS (SELECT *, {vx} AS vx, {vy} AS vy, {vz} AS vz, sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y) + (max_z - min_z) * (max_z - min_z)) AS diag FROM {source} WHERE {frustum(camera.clip()) if cull else 'true'}),
{name}_s AS (SELECT *, {sx('vx')} AS ax, {sy('vx')} AS ay, {sx('vx + diag')} AS bx, {sy('vx + diag')} AS by_ FROM {name}_v),
{name}_p AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS pixel_size FROM {name}_s),
{name}_l AS (SELECT *, CASE WHEN pixel_size < 100 THEN 4 WHEN pixel_size < 200 THEN 3 WHEN pixel_size < 500 THEN 2 WHEN pixel_size < 10000 THEN 1 ELSE 0 END AS precision, {level} AS lod_threshold FROM {name}_p),
{name} AS (SELECT *, lod_cum[least(greatest(floor(lod_threshold + 0.5)::INTEGER, 0), 7) + 1] AS active_points FROM {name}_l)"""


def selected(config: RasterConfig) -> str:
    by = hashed("src_idx") if config.enable_lod_dither else "0.5"
    return f"""sel0 AS (SELECT wrd.* EXCLUDE (min_x, min_y, min_z, max_x, max_y, max_z, x, y, z, src_idx), vis.* EXCLUDE (batch_id, vx, vy, vz), first_point + local_idx AS src_idx FROM wrd JOIN vis USING (batch_id) WHERE active_points > 0 AND local_idx < active_points),
sel AS MATERIALIZED (SELECT src_idx, point_id, batch_id, lod_level, rgba, {decoded('precision')} FROM sel0 WHERE {by} < lod_threshold - lod_level + 0.5)"""
