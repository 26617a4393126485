"""Named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import IDENTITY, Camera, Cloud, PackConfig, PointSize, RasterConfig, look_at, multiply, perspective, scale_translate, standard_camera
from cloudweave.operators import features, pack, raster, resolve, select
from cloudweave.operators.history import DisplacementHistory
from cloudweave.plans import sql as q
from cloudweave.plans import streams
from cloudweave.sources import points as src

CAMERA = standard_camera()
TILTED = standard_camera((1.4, 1.1, 1.9))
THEN = standard_camera((0.1, 0.05, 2.4))
IMAGE = RasterConfig(width=192, height=192)
RADIUS = g.radius_of(IMAGE.point_size_scale)
SMALL = RasterConfig(width=96, height=96, point_size_scale=3.0)
SMALL_RADIUS = g.radius_of(SMALL.point_size_scale)
FINE = RasterConfig(width=192, height=192, point_size_scale=1.0)
PACK = PackConfig(points_per_batch=512, lod_levels=4, coarse_divisions=16)
CLOSE = Camera(look_at((0.35, 0.2, 0.75), (0.2, 0.0, 0.0)), perspective(45.0, 1.0, 0.01, 100.0))
CAPACITY = 5000
MOVED = scale_translate((0.5, 0.5, 0.5), (0.4, -0.1, 0.2))
BLUR = IMAGE.but(motion_blur=0.8, motion_blur_samples=6, motion_blur_max_spread=12.0)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def longs(df: DataFrame) -> DataFrame:
    """All whole numbers as bigint, so that types don't hang on how a number came about."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return add


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.lineitem_points(spark, sf_dir)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.numbered_lineitem_points(spark, sf_dir).withColumn("src_idx", F.col("point_id"))


# --- packing ---


@query("bounds", with_(q.PTS, select="SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM pts"))
def _(spark, sf_dir):
    return pack.bounds_frame(line(spark, sf_dir))


@query("union_bounds", with_(q.PTS, q.ORD, select="SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM (SELECT x, y, z FROM pts UNION ALL SELECT x, y, z FROM pts2)"))
def _(spark, sf_dir):
    return pack.union_bounds([line(spark, sf_dir), src.orders_points(spark, sf_dir)])


@query("morton_key", with_(q.NUM, q.BOUNDS, q.morton(), select="SELECT point_id, mk FROM rnk"))
def _(spark, sf_dir):
    return pack.morton_keys(numbered(spark, sf_dir), pack.bounds(line(spark, sf_dir))).select("point_id", "mk")


@query("morton_rank", with_(q.NUM, q.BOUNDS, q.morton(), select="SELECT point_id, mk, pk FROM rnk"))
def _(spark, sf_dir):
    return pack.morton_ranks(numbered(spark, sf_dir), pack.bounds(line(spark, sf_dir))).select("point_id", "mk", "pk")


_PACKED = q.packed(PACK.lod_levels, PACK.coarse_divisions, PACK.points_per_batch)


def packed(spark, sf_dir) -> pack.PackedCloud:
    return pack.pack(src.numbered_lineitem_points(spark, sf_dir), PACK, pack.bounds(line(spark, sf_dir)))


@query("lod_levels", with_(_PACKED, select="SELECT point_id, pk, lod_level::BIGINT AS lod_level FROM lod"))
def _(spark, sf_dir):
    return packed(spark, sf_dir).points.select("point_id", "pk", "lod_level")


@query("level_bucketed_order", with_(_PACKED, select="SELECT point_id, batch_id::BIGINT AS batch_id, local_idx FROM bat"))
def _(spark, sf_dir):
    return packed(spark, sf_dir).points.select("point_id", "batch_id", "local_idx")


@query("batch_zone_map", with_(_PACKED, select="SELECT batch_id::BIGINT AS batch_id, min_x, min_y, min_z, max_x, max_y, max_z, num_points FROM zon"))
def _(spark, sf_dir):
    return packed(spark, sf_dir).batches.select("batch_id", *(f"{n}_{a}" for n in ("min", "max") for a in "xyz"), "num_points")


@query("batch_lod_counts", with_(_PACKED, select="SELECT batch_id::BIGINT AS batch_id, " + ", ".join(f"lod_cum[{k + 1}] AS upto_{k}" for k in range(8)) + " FROM zon"))
def _(spark, sf_dir):
    return packed(spark, sf_dir).batches.select("batch_id", *(F.get("lod_cum", F.lit(k)).alias(f"upto_{k}") for k in range(8)))


@query("batch_shuffle", with_(_PACKED, select="SELECT batch_id::BIGINT AS batch_id, new_id::BIGINT AS new_id, first_point, num_points FROM zon"))
def _(spark, sf_dir):
    return packed(spark, sf_dir).batches.select("batch_id", "new_id", "first_point", "num_points")


@query("quantize30", with_(_PACKED, q.quantised(), select="SELECT point_id, xyz_low, xyz_med, xyz_high FROM wrd"))
def _(spark, sf_dir):
    return packed(spark, sf_dir).points.select("point_id", "xyz_low", "xyz_med", "xyz_high")


def _decode(precision: int) -> Query:
    def run(spark, sf_dir):
        c = packed(spark, sf_dir)
        words = (F.col("xyz_low"), F.col("xyz_med"), F.col("xyz_high"))
        rows = c.points.drop("x", "y", "z").join(c.batches.drop("block"), "batch_id")
        return rows.select("point_id", *(g.decode(k, F.col(f"min_{a}"), F.col(f"max_{a}"), words, F.lit(precision)).alias(a) for k, a in enumerate("xyz")))

    return run


for _bits, _precision in ((30, 0), (20, 1), (10, 2)):
    query(f"decode{_bits}", with_(_PACKED, q.quantised(), select=f"SELECT point_id, {q.decoded(str(_precision))} FROM wrd"))(_decode(_precision))


@query("udf_decode_by_level", with_(_PACKED, q.quantised(), select=f"SELECT point_id, {q.decoded('lod_level')} FROM wrd"))
def _(spark, sf_dir):
    c = packed(spark, sf_dir)
    return features.decode_for_udf(c.points.drop("x", "y", "z").join(c.batches.drop("block"), "batch_id")).select("point_id", "x", "y", "z")


_UNIT = {"r": "l_quantity / 50.0", "g": "l_tax * 10.0", "b": "l_discount * 12.0"}
_BYTE = lambda e: f"floor(least(greatest({e}, 0), 1) * CAST(255 AS DOUBLE))::BIGINT"


@query("pack_color", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, " + " + ".join(f"({_BYTE(e)} << {8 * k})" for k, e in enumerate((*_UNIT.values(), "1.0"))) + " AS rgba FROM (SELECT * REPLACE (l_quantity::DOUBLE AS l_quantity) FROM lineitem)")
def _(spark, sf_dir):
    rows = src.load(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", g.pack_rgba(*(F.expr(e).cast("double") for e in _UNIT.values()), F.lit(1.0)).alias("rgba"))


@query("unpack_color", with_(q.PTS, select="SELECT x, y, z, " + ", ".join(f"{q.channel(k)} / CAST(255 AS DOUBLE) AS {n}" for k, n in enumerate("rgb")) + " FROM pts"))
def _(spark, sf_dir):
    return line(spark, sf_dir).select("x", "y", "z", *((g.channel(F.col("rgba"), k) / 255.0).alias(n) for k, n in enumerate("rgb")))


@query("hash_dither", with_(q.NUM, select=f"SELECT point_id, {q.hashed('point_id')} AS h FROM pts"))
def _(spark, sf_dir):
    return numbered(spark, sf_dir).select("point_id", g.hash_unit(F.col("point_id")).alias("h"))


_AXIS = "greatest(2, floor(cbrt(n))::BIGINT)"
_GRID = {"x": "i % k", "y": "i // k % k", "z": "i // (k * k)"}


@query("cube_grid", f"WITH siz AS (SELECT {_AXIS} AS k FROM (SELECT count(*) AS n FROM part)), grd AS (SELECT i, k FROM siz, range((SELECT k * k * k FROM siz)) t(i)) SELECT i AS point_id, " + ", ".join(f"({e}) / (k - 1)::DOUBLE - 0.5 AS {a}" for a, e in _GRID.items()) + ", " + " + ".join(f"(floor(({e}) / (k - 1)::DOUBLE * 255.0::DOUBLE)::BIGINT << {8 * s})" for s, e in enumerate(_GRID.values())) + " + 4278190080 AS rgba FROM grd")
def _(spark, sf_dir):
    """A grid of as many points as there are parts, or somewhat fewer."""
    return src.cube_grid(spark, max(2, math.floor(round(src.load(spark, sf_dir, "part").count() ** (1 / 3), 9))))


_LOOKED_UP = with_(_PACKED, select="SELECT i, batch_id::BIGINT AS batch_id, (i - first_point)::BIGINT AS local_idx FROM range((SELECT count(*) FROM pts)) t(i) JOIN zon ON first_point <= i AND i < first_point + num_points")


@query("point_to_batch_range_join", _LOOKED_UP)
@query("point_to_batch_all", _LOOKED_UP)
def _(spark, sf_dir):
    """Every pack index."""
    c = packed(spark, sf_dir)
    return pack.point_to_batch(spark.range(c.points.count()).withColumnRenamed("id", "i"), c.batches)


# --- selection ---

_VISIBLE = q.visible(CLOSE, IMAGE)


@query("frustum_prune", with_(_PACKED, select=f"SELECT batch_id::BIGINT AS batch_id, num_points FROM zon WHERE {q.frustum(CLOSE.clip())}"))
def _(spark, sf_dir):
    return packed(spark, sf_dir).batches.where("state <> 0").where(g.in_frustum(CLOSE.clip())).select("batch_id", "num_points")


@query("batch_file_transform", with_(_PACKED, select=f"SELECT batch_id::BIGINT AS batch_id, file_index::BIGINT AS file_index, {q.row(MOVED, 0, 'min_x', 'min_y', 'min_z')} AS world_x FROM (SELECT *, 0 AS file_index FROM zon)"))
def _(spark, sf_dir):
    files = spark.createDataFrame([(0, list(MOVED))], "file_index int, world array<double>")
    b = packed(spark, sf_dir).batches.join(F.broadcast(files), "file_index")  # one row a file of a cloud
    m = [F.get("world", F.lit(k)) for k in (0, 4, 8, 12)]
    return b.select("batch_id", "file_index", (m[0] * F.col("min_x") + m[1] * F.col("min_y") + m[2] * F.col("min_z") + m[3]).alias("world_x"))


_IN_FILES = "fil AS (SELECT *, batch_id % 3 AS file_no FROM zon), fil0 AS (SELECT * FROM fil WHERE file_no <> 1), fil1 AS (SELECT * FROM fil WHERE file_no = 1)"
_CLOSE_MOVED = Camera(multiply(CLOSE.view, MOVED), CLOSE.projection)
_FILE_COLUMNS = "batch_id::BIGINT AS batch_id, file_no::BIGINT AS file_index, precision::BIGINT AS precision, active_points::BIGINT AS active_points"


@query("file_visible_batches", with_(_PACKED, _IN_FILES, q.visible(CLOSE, IMAGE, source="fil0", name="vis"), q.visible(_CLOSE_MOVED, IMAGE, source="fil1", name="vim"), select=f"SELECT {_FILE_COLUMNS} FROM vis WHERE active_points > 0 UNION ALL SELECT {_FILE_COLUMNS} FROM vim WHERE active_points > 0"))
def _(spark, sf_dir):
    """Batches of three files, of which the second stands elsewhere."""
    b = packed(spark, sf_dir).batches.withColumn("file_index", (F.col("batch_id") % 3).cast("int"))
    return select.visible_batches_of_files(b, CLOSE, IMAGE, {1: MOVED}).select("batch_id", "file_index", "precision", "active_points")


@query("precision_level", with_(_PACKED, _VISIBLE, select="SELECT batch_id::BIGINT AS batch_id, precision::BIGINT AS precision, pixel_size FROM vis"))
def _(spark, sf_dir):
    """Of every batch in the frustum, also of those whose points are all of levels too fine to be drawn."""
    return select.sized_batches(packed(spark, sf_dir).batches, CLOSE, IMAGE).select("batch_id", "precision", "pixel_size")


@query("prefix_select", with_(_PACKED, _VISIBLE, select="SELECT batch_id::BIGINT AS batch_id, active_points::BIGINT AS active_points FROM vis WHERE active_points > 0"))
def _(spark, sf_dir):
    return select.visible_batches(packed(spark, sf_dir).batches, CLOSE, IMAGE).select("batch_id", "active_points")


_SELECTED = [_PACKED, q.quantised(), _VISIBLE, q.selected(IMAGE)]


@query("clod_select", with_(*_SELECTED, select="SELECT src_idx::BIGINT AS src_idx, point_id, lod_level::BIGINT AS lod_level, x, y, z FROM sel"))
def _(spark, sf_dir):
    return select.selected_points(packed(spark, sf_dir), CLOSE, IMAGE).select("src_idx", "point_id", "lod_level", "x", "y", "z")


_PLAIN = IMAGE.but(enable_clod=False, enable_lod_dither=False, enable_frustum_culling=False)


@query("clod_off_select", with_(_PACKED, q.quantised(), q.visible(CLOSE, _PLAIN, cull=False), q.selected(_PLAIN), select="SELECT src_idx::BIGINT AS src_idx, point_id FROM sel"))
def _(spark, sf_dir):
    return select.selected_points(packed(spark, sf_dir), CLOSE, _PLAIN).select("src_idx", "point_id")


@query("capacity_overflow", with_(*_SELECTED, select=f"SELECT count(*) AS appended, greatest(count(*) - {CAPACITY}, 0) AS overflow, least(count(*), {CAPACITY}) AS kept FROM sel"))
def _(spark, sf_dir):
    return select.selection_stats(select.selected_points(packed(spark, sf_dir), CLOSE, IMAGE), CAPACITY)


@query("capacity_limit", with_(*_SELECTED, select=f"SELECT src_idx::BIGINT AS src_idx, point_id FROM sel ORDER BY src_idx LIMIT {CAPACITY}"))
def _(spark, sf_dir):
    return select.capped(select.select_points(packed(spark, sf_dir), CLOSE, IMAGE), CAPACITY).select("src_idx", "point_id")


@query("packed_cloud_image", with_(*_SELECTED, q.average_pixels(CLOSE, IMAGE, RADIUS, "sel"), select=q.PIXELS))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(select.select_points(packed(spark, sf_dir), CLOSE, IMAGE))], CLOSE, IMAGE)


# --- images ---


@query("project_points", with_(q.NUM, q.projected("pts", CAMERA, IMAGE), select="SELECT point_id, cx, cy, depth FROM proj"))
def _(spark, sf_dir):
    return raster.project(numbered(spark, sf_dir), CAMERA, IMAGE).select("point_id", "cx", "cy", "depth")


@query("splat", with_(q.PTS, q.projected("pts", CAMERA, SMALL), q.offsets(SMALL_RADIUS), q.splats(SMALL), select="SELECT px, py, depth, rgba FROM spl"))
def _(spark, sf_dir):
    return raster.splat(raster.project(line(spark, sf_dir), CAMERA, SMALL), SMALL, CAMERA).select("px", "py", "depth", "rgba")


_SPLATS = [q.PTS, q.projected("pts", CAMERA, IMAGE), q.offsets(RADIUS), q.splats(IMAGE)]


@query("nearest_depth_image", with_(*_SPLATS, q.depths(), select="SELECT px, py, depth FROM dep"))
def _(spark, sf_dir):
    return raster.depth_image(raster.project(line(spark, sf_dir), CAMERA, IMAGE), IMAGE, CAMERA)


_AVERAGE = [q.PTS, q.average_pixels(CAMERA, IMAGE, RADIUS)]


@query("color_average_image", with_(*_AVERAGE, select=q.PIXELS))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(line(spark, sf_dir))], CAMERA, IMAGE)


_IMG = "img AS MATERIALIZED (SELECT px, py, sum_r / cnt::DOUBLE / 255 AS r, sum_g / cnt::DOUBLE / 255 AS g, sum_b / cnt::DOUBLE / 255 AS b, CAST(1 AS DOUBLE) AS a, depth / " + q.d(g.DEPTH_STEPS) + " AS depth FROM pix)"


@query("resolved_image", with_(*_AVERAGE, _IMG, select="SELECT px, py, r, g, b, a, depth FROM img"))
def _(spark, sf_dir):
    return resolve.render([Cloud(line(spark, sf_dir))], CAMERA, IMAGE)


_WINNERS = [q.NUM, q.projected("pts", CAMERA, IMAGE), q.offsets(RADIUS), q.splats(IMAGE), "win AS (SELECT px, py, depth, src_idx, rgba FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY depth DESC, src_idx) AS k FROM spl WHERE depth > 0) WHERE k = 1)"]


@query("nearest_winner_image", with_(*_WINNERS, select="SELECT px, py, depth, src_idx, rgba FROM win"))
def _(spark, sf_dir):
    return raster.nearest_winners(raster.project(numbered(spark, sf_dir), CAMERA, IMAGE), IMAGE, CAMERA)


@query("pick_point", with_(*_WINNERS, select="SELECT src_idx, px, py, (px - 105) * (px - 105) + (py - 82) * (py - 82) AS d2 FROM win WHERE (px - 105) * (px - 105) + (py - 82) * (py - 82) <= 100 ORDER BY d2, py, px LIMIT 1"))
def _(spark, sf_dir):
    winners = raster.nearest_winners(raster.project(numbered(spark, sf_dir), CAMERA, IMAGE), IMAGE, CAMERA)
    return resolve.pick(winners, (0.1, 0.14), IMAGE, 10)


@query("overdraw_heatmap", with_(q.PTS, q.average_pixels(CAMERA, IMAGE, RADIUS, rgba="65793"), select="SELECT px, py, sum_r, cnt FROM pix"))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(line(spark, sf_dir))], CAMERA, IMAGE.but(colorize_overdraw=True)).select("px", "py", "sum_r", "cnt")


@query("chunk_colors", with_(q.NUM, q.average_pixels(CAMERA, IMAGE, RADIUS, rgba="((src_idx >> 13) * 1234567) & 4294967295"), select=q.PIXELS))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(numbered(spark, sf_dir))], CAMERA, IMAGE.but(colorize_chunks=True))


_AA = "aa AS (SELECT px, py, max(pixel_depth)::BIGINT AS depth, " + ", ".join(f"sum(floor({q.channel(k)} * {q.d(1 / 255)} * cov * 4096 + 0.5)::BIGINT)::BIGINT AS sum_{n}" for k, n in enumerate("rgb")) + ", sum(floor(cov * 4096 + 0.5)::BIGINT)::BIGINT AS cnt FROM band WHERE cov > 0 GROUP BY px, py)"


@query("edge_aa_image", with_(*_SPLATS, q.depths(), q.banded(IMAGE), _AA, select="SELECT px, py, depth, sum_r, sum_g, sum_b, cnt, least(cnt / CAST(4096 AS DOUBLE), 1) AS a FROM aa"))
def _(spark, sf_dir):
    sums = raster.accumulate([Cloud(line(spark, sf_dir))], CAMERA, IMAGE.but(point_edge_antialiasing=True))
    return sums.withColumn("a", g.saturate(F.col("cnt") / 4096.0))


_ALPHA = "greatest(least(1 - (l_q::DOUBLE), 1), 0)"
_TINTED = f"pts AS (SELECT {q.LINE}, l_tax * 5.0::DOUBLE AS tint_a, l_discount * 8.0::DOUBLE AS tint_r, l_quantity / 50.0::DOUBLE AS tint_g FROM lineitem)"


def tinted(spark, sf_dir, discard: bool = False) -> DataFrame:
    rows = src.load(spark, sf_dir, "lineitem").select(*src._lineitem_place(), "l_tax", "l_discount", "l_quantity")
    a = F.col("l_tax") * 5.0
    tint = F.struct((F.col("l_discount") * 8.0).alias("r"), (F.col("l_quantity") / 50.0).alias("g"), F.lit(0.25).alias("b"), (F.when(a > 0.3, -1.0).otherwise(a) if discard else a).alias("a"))
    return features.with_tint(rows, tint).drop("l_tax", "l_discount", "l_quantity")


def _oit(source: str, alpha: str, samples: str = "1") -> str:
    each = f"(({alpha}) / {samples})"
    return f"oit AS (SELECT px, py, " + ", ".join(f"sum(floor({q.channel(k)} * {q.d(1 / 255)} * {each} * 4096 + 0.5)::BIGINT)::BIGINT AS sum_{n}" for k, n in enumerate("rgb")) + f", sum(floor({each} * 4096 + 0.5)::BIGINT)::BIGINT AS cnt FROM {source} WHERE ({alpha}) > 0 GROUP BY px, py)"


_COVER = IMAGE.but(apply_tint=True, tint_alpha_is_coverage=True)


@query("oit_image", with_(_TINTED, *_SPLATS[1:], q.depths(), _oit("spl", "least(greatest(1 - tint_a, 0), 1)"), select="SELECT oit.px, oit.py, depth, sum_r, sum_g, sum_b, cnt, sum_r / cnt::DOUBLE AS r FROM oit JOIN dep USING (px, py)"))
def _(spark, sf_dir):
    sums = raster.accumulate([Cloud(tinted(spark, sf_dir))], CAMERA, _COVER)
    return sums.withColumn("r", F.col("sum_r") / F.col("cnt").cast("double"))


_MIX = ", ".join(f"floor(least(greatest({q.channel(k)} * {q.d(1 / 255)} + (least(greatest({t}, 0), 1) - {q.channel(k)} * {q.d(1 / 255)}) * least(greatest(tint_a, 0), 1), 0), 1) * 255.0::DOUBLE + 0.5)::BIGINT AS m{n}" for k, n, t in ((0, "r", "tint_r"), (1, "g", "tint_g"), (2, "b", "0.25::DOUBLE")))
_TINT_SUMS = "SELECT px, py, max(pixel_depth)::BIGINT AS depth, sum(mr)::BIGINT AS sum_r, sum(mg)::BIGINT AS sum_g, sum(mb)::BIGINT AS sum_b, count(*) AS cnt FROM (SELECT px, py, pixel_depth, tint_a, " + _MIX + " FROM band) "


@query("tint_mix", with_(_TINTED, *_SPLATS[1:], q.depths(), q.banded(IMAGE), select=_TINT_SUMS + "GROUP BY px, py"))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(tinted(spark, sf_dir))], CAMERA, IMAGE.but(apply_tint=True))


_DISCARD = _TINTED.replace("l_tax * 5.0::DOUBLE AS tint_a", "CASE WHEN l_tax * 5.0::DOUBLE > 0.3 THEN -1.0::DOUBLE ELSE l_tax * 5.0::DOUBLE END AS tint_a")


@query("tint_discard", with_(_DISCARD, *_SPLATS[1:], q.depths(), q.banded(IMAGE), select=_TINT_SUMS + "WHERE tint_a >= 0 GROUP BY px, py"))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(tinted(spark, sf_dir, discard=True))], CAMERA, IMAGE.but(apply_tint=True))


def _motion_sql(then: Camera = THEN, x: str = "x", y: str = "y", z: str = "z") -> str:
    m, (w, h) = then.clip(), BLUR.size
    trunc = lambda e: f"trunc({e})::BIGINT"
    half = lambda e: f"(sign({e}) * floor(abs({e}) + 0.5))::BIGINT"
    return f"""mot_c AS (SELECT *, {q.row(m, 0, x, y, z)} AS ox, {q.row(m, 1, x, y, z)} AS oy, {q.row(m, 3, x, y, z)} AS ow FROM proj),
mot_p AS (SELECT *, CASE WHEN ow > 0 THEN ow ELSE 1 END AS sw FROM mot_c),
mot_v AS (SELECT *, (cx - {trunc(f"(ox / sw * 0.5 + 0.5) * {w}")}) * {q.d(BLUR.motion_blur)} AS vx, (cy - ({h} - 1 - {trunc(f"(oy / sw * 0.5 + 0.5) * {h}")})) * {q.d(BLUR.motion_blur)} AS vy FROM mot_p),
mot_l AS (SELECT *, sqrt(vx * vx + vy * vy) AS len0 FROM mot_v),
mot_b AS (SELECT *, CASE WHEN len0 > {BLUR.motion_blur_max_spread} THEN {q.d(BLUR.motion_blur_max_spread)} / len0 ELSE 1 END AS cut, least(len0, {BLUR.motion_blur_max_spread}) AS len FROM mot_l),
mot_n AS (SELECT *, CASE WHEN ow > 0 AND len > 0.75 THEN least(greatest(ceil(len)::BIGINT, 1), {BLUR.motion_blur_samples}) ELSE 1 END AS samples, ow > 0 AND len > 0.75 AS streak FROM mot_b),
mot AS (SELECT * EXCLUDE (cx, cy), cx - {half("CASE WHEN streak THEN vx * cut / greatest(samples - 1, 1) ELSE 0 END * s")} AS cx, cy - {half("CASE WHEN streak THEN vy * cut / greatest(samples - 1, 1) ELSE 0 END * s")} AS cy FROM (SELECT *, unnest(range(samples)) AS s FROM mot_n))"""


@query("motion_blur_image", with_(q.PTS, q.projected("pts", CAMERA, BLUR), q.offsets(RADIUS), _motion_sql(), q.splats(BLUR, "mot"), _oit("spl", "1.0::DOUBLE", "samples"), select="SELECT px, py, sum_r, sum_g, sum_b, cnt FROM oit"))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(line(spark, sf_dir))], CAMERA, BLUR, THEN).drop("depth")


def _swing(t: float):
    """Points that move by where they are, more and more."""
    return F.struct((F.col("z") * (0.02 * t)).alias("dx"), (F.col("x") * (0.03 * t)).alias("dy"), F.lit(0.0).alias("dz"))


def _swung(t: float, x: str, y: str, z: str) -> str:
    return f"x + z * {q.d(0.02 * t)} AS {x}, y + x * {q.d(0.03 * t)} AS {y}, z + {q.d(0.0)} AS {z}"


@query("displaced_motion_image", with_(q.NUM.replace("pts AS", "raw AS", 1), f"pts AS (SELECT {_swung(2.0, 'x', 'y', 'z')}, {_swung(1.0, 'bx', 'by_', 'bz')}, rgba FROM raw)", q.projected("pts", CAMERA, BLUR), q.offsets(RADIUS), _motion_sql(CAMERA, "bx", "by_", "bz"), q.splats(BLUR, "mot"), _oit("spl", "1.0::DOUBLE", "samples"), select="SELECT px, py, sum_r, sum_g, sum_b, cnt FROM oit"))
def _(spark, sf_dir):
    """The second frame of one camera, of points that have moved since the first."""
    memory = DisplacementHistory(spark)
    points = memory.bucketed("line", numbered(spark, sf_dir))
    memory.snapshot("main", "line", features.with_displacement(points, _swing(1.0)))
    moved = memory.with_former("main", "line", features.with_displacement(points, _swing(2.0)))
    return raster.accumulate([Cloud(moved)], CAMERA, BLUR.but(apply_displacement=True), CAMERA).drop("depth")


_REJECT = FINE.but(enable_point_rejection=True)


def _reject_sql(config: RasterConfig) -> str:
    import math

    v = ", ".join(f"{q.view('px', 'py', 'depth', CAMERA, config, k)} AS v{a}" for k, a in enumerate("xyz"))
    return f"""cov AS MATERIALIZED (SELECT px, py, depth, {v} FROM pix WHERE depth > 0),
nei AS (SELECT dx, dy FROM range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE dx <> 0 OR dy <> 0),
par AS (SELECT c.*, n.vx - c.vx AS wx, n.vy - c.vy AS wy, n.vz - c.vz AS wz FROM cov c, nei JOIN cov n ON n.px = c.px - dx AND n.py = c.py - dy
  WHERE n.depth > c.depth AND n.depth / {q.d(g.DEPTH_STEPS)} > c.depth / {q.d(g.DEPTH_STEPS)} * {q.d(1 + config.depth_tolerance)}),
con AS (SELECT px, py, max(least(greatest((-vx * wx - vy * wy - vz * wz) / (sqrt(vx * vx + vy * vy + vz * vz) * sqrt(wx * wx + wy * wy + wz * wz)), -1), 1)) AS c FROM par WHERE sqrt(wx * wx + wy * wy + wz * wz) >= 1e-6 GROUP BY px, py),
rej AS (SELECT px, py FROM con WHERE c > {q.d(math.cos(config.rejection_cone_threshold))})"""


_REJECTED = [q.PTS, q.average_pixels(CAMERA, FINE, 0), _reject_sql(_REJECT)]


@query("reject_image", with_(*_REJECTED, select="SELECT px, py, depth, sum_r, cnt FROM pix WHERE NOT EXISTS (SELECT 1 FROM rej WHERE rej.px = pix.px AND rej.py = pix.py)"))
def _(spark, sf_dir):
    pixels = raster.written(raster.accumulate([Cloud(line(spark, sf_dir))], CAMERA, FINE), "pixels")
    return pixels.join(resolve.rejected(pixels, CAMERA, _REJECT), ["px", "py"], "left_anti").select("px", "py", "depth", "sum_r", "cnt")


def _fill_sql(rounds: int, config: RasterConfig) -> list[str]:
    w, h = config.size
    out = ["i0 AS MATERIALIZED (SELECT px, py, " + ", ".join(f"floor(sum_{n} / cnt::DOUBLE / 255 * 255.0 + 0.5)::BIGINT AS {n}i" for n in "rgb") + f", 255::BIGINT AS ai, least(floor(depth / {q.d(g.DEPTH_STEPS)} * {q.d(g.DEPTH_STEPS)})::BIGINT, 4294967295) AS d FROM pix)", "n8 AS (SELECT dx, dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0)"]
    for k in range(rounds):
        mean = lambda c: f"floor(sum({c})::DOUBLE / count(*) + 0.5)::BIGINT AS {c}"
        out.append(f"g{k} AS (SELECT px + dx AS px, py + dy AS py, {mean('ri')}, {mean('gi')}, {mean('bi')}, {mean('d')} FROM i{k}, n8 WHERE ai * 2 >= 255 AND px + dx BETWEEN 0 AND {w - 1} AND py + dy BETWEEN 0 AND {h - 1} GROUP BY 1, 2)")
        out.append(f"i{k + 1} AS MATERIALIZED (SELECT px, py, ri, gi, bi, ai, d FROM i{k} UNION ALL SELECT px, py, ri, gi, bi, 255, d FROM g{k} WHERE NOT EXISTS (SELECT 1 FROM i{k} o WHERE o.px = g{k}.px AND o.py = g{k}.py))")
    return out


def _fill(rounds: int) -> Query:
    def run(spark, sf_dir):
        image = resolve.resolve(raster.accumulate([Cloud(line(spark, sf_dir))], CAMERA, FINE), CAMERA, FINE)
        return resolve.hole_filled(resolve.bytes_image(image), FINE, rounds)

    return run


for _rounds in (1, 3):
    query(f"hole_fill_{_rounds}", with_(q.PTS, q.average_pixels(CAMERA, FINE, 0), *_fill_sql(_rounds, FINE), select=f"SELECT px, py, ri, gi, bi, ai, d FROM i{_rounds}"))(_fill(_rounds))


def scene(spark, sf_dir) -> DataFrame:
    return resolve.render([Cloud(src.orders_points(spark, sf_dir))], CAMERA, IMAGE)


_SCENE_PIX = q.average_pixels(CAMERA, IMAGE, RADIUS, "pts2")
for _n in ("proj_c", "proj_n", "proj_p", "proj", "spl", "dep", "band", "pix"):
    import re as _re

    _SCENE_PIX = _re.sub(rf"\b{_n}\b", f"s_{_n}", _SCENE_PIX)
_SCENE_PIX = _SCENE_PIX.replace(q.offsets(RADIUS) + ",\n", "")
_SCENE = [*_AVERAGE, _IMG, q.ORD, _SCENE_PIX, _IMG.replace("img AS", "scn AS").replace("FROM pix)", "FROM s_pix)")]
_FULL = "FROM img c FULL JOIN scn s ON c.px = s.px AND c.py = s.py"


@query("composite_over", with_(*_SCENE, select="SELECT coalesce(c.px, s.px) AS px, coalesce(c.py, s.py) AS py, " + ", ".join(f"CASE WHEN s.a IS NULL THEN c.{n} ELSE coalesce(c.{n}, 0) * coalesce(c.a, 0) + s.{n} * (1 - coalesce(c.a, 0)) END AS {n}" for n in "rgb") + f", coalesce(c.a, 0) + coalesce(s.a, 0) * (1 - coalesce(c.a, 0)) AS a, coalesce(s.depth, 0) AS depth {_FULL}"))
def _(spark, sf_dir):
    return resolve.composite_over(resolve.render([Cloud(line(spark, sf_dir))], CAMERA, IMAGE), scene(spark, sf_dir))


_FRONT = "(c.depth IS NOT NULL AND c.depth >= coalesce(s.depth, 0))"


@query("composite_depth", with_(*_SCENE, select="SELECT coalesce(c.px, s.px) AS px, coalesce(c.py, s.py) AS py, " + ", ".join(f"CASE WHEN {_FRONT} THEN c.{n} ELSE s.{n} END AS {n}" for n in ("r", "g", "b", "a", "depth")) + f", {_FRONT} AS from_cloud {_FULL}"))
def _(spark, sf_dir):
    return resolve.composite_depth(resolve.render([Cloud(line(spark, sf_dir))], CAMERA, IMAGE), scene(spark, sf_dir))


@query("composite_viewport", with_(*_SCENE, "big AS (SELECT px * 2 + dx + 30 AS px, py * 2 + dy + 12 AS py, r, g, b, a, depth FROM img, range(2) u(dx), range(2) v(dy))", select="SELECT coalesce(c.px, s.px) AS px, coalesce(c.py, s.py) AS py, " + ", ".join(f"CASE WHEN {_FRONT} THEN c.{n} ELSE s.{n} END AS {n}" for n in ("r", "g", "b", "depth")) + f", {_FRONT} AS from_cloud FROM big c FULL JOIN scn s ON c.px = s.px AND c.py = s.py"))
def _(spark, sf_dir):
    part = resolve.in_viewport(resolve.render([Cloud(line(spark, sf_dir))], CAMERA, IMAGE), (30, 12), 2)
    return resolve.composite_depth(part, scene(spark, sf_dir)).select("px", "py", "r", "g", "b", "depth", "from_cloud")


_BOTH = "both_ AS (SELECT x, y, z, rgba FROM pts UNION ALL SELECT " + ", ".join(f"{q.row(MOVED, k)} AS {a}" for k, a in enumerate("xyz")) + ", rgba FROM pts2)"


@query("multi_cloud_union", with_(q.PTS, q.ORD, _BOTH, q.average_pixels(CAMERA, IMAGE, RADIUS, "both_"), select=q.PIXELS))
def _(spark, sf_dir):
    parent = Cloud(None, visible=False)
    moved = src.orders_points(spark, sf_dir)
    world = moved.withColumns({a: g.transform_row(MOVED, k, F.col("x"), F.col("y"), F.col("z")) for k, a in enumerate("xyz")})
    clouds = [Cloud(line(spark, sf_dir)), Cloud(world.select("x", "y", "z", "rgba")), Cloud(line(spark, sf_dir), visible=False), Cloud(world, parents=(parent,))]
    return raster.accumulate(clouds, CAMERA, IMAGE)


_WORLD = IMAGE.but(point_size_mode=PointSize.WORLD, point_size_scale=0.01, maximum_point_size=9.0)


def _world_sql() -> str:
    focal = 2.0 * _WORLD.point_size_scale * (_WORLD.size[1] * 0.5 * CAMERA.projection[5])
    cells = ", ".join(f"({r}, {dx}, {dy})" for r in range(6) for dx, dy in g.disc(r))
    w, h = _WORLD.size
    return f"""siz AS (SELECT *, least(greatest({q.d(focal)} / greatest(-{q.row(CAMERA.view, 2)}, {q.d(1e-6)}), 1), 9) AS size FROM proj),
rad AS (SELECT *, least(greatest(ceil(greatest(size - 1, 0) * 0.5)::BIGINT, 0), 16) AS radius FROM siz),
off AS (SELECT * FROM (VALUES {cells}) AS t(radius, dx, dy)),
spl AS (SELECT rad.*, cx + dx AS px, cy + dy AS py FROM rad JOIN off USING (radius) WHERE cx + dx BETWEEN 0 AND {w - 1} AND cy + dy BETWEEN 0 AND {h - 1})"""


@query("world_size_image", with_(q.PTS, q.projected("pts", CAMERA, _WORLD), _world_sql(), q.depths(), q.banded(_WORLD), q.averages(), select=q.PIXELS))
def _(spark, sf_dir):
    return raster.accumulate([Cloud(line(spark, sf_dir))], CAMERA, _WORLD)


_SUPER = SMALL.but(render_scale=2.0)


@query("supersampled_image", with_(q.PTS, q.average_pixels(CAMERA, _SUPER, g.radius_of(6.0)), _IMG, select="SELECT px // 2 AS px, py // 2 AS py, " + ", ".join(f"round(avg({n}), 9) AS {n}" for n in "rgb") + ", count(*) / 4.0::DOUBLE AS a, max(depth) AS depth FROM img GROUP BY 1, 2"))
def _(spark, sf_dir):
    image = resolve.downsampled(resolve.render([Cloud(line(spark, sf_dir))], CAMERA, _SUPER), 2)
    return image.select("px", "py", *(F.round(n, 9).alias(n) for n in "rgb"), "a", "depth")


# --- displacement ---

_SINE = "pts AS (SELECT x, y + 0.05::DOUBLE * ((x * 4.0::DOUBLE) - (x * 4.0::DOUBLE) * (x * 4.0::DOUBLE) * (x * 4.0::DOUBLE) / 6.0::DOUBLE) AS y, z, rgba FROM raw)"
_RAW = f"raw AS (SELECT {q.LINE} FROM lineitem)"
_MOVE = IMAGE.but(apply_displacement=True)


@query("displace_sine", with_(_RAW, _SINE, q.average_pixels(CAMERA, IMAGE, RADIUS), select=q.PIXELS))
def _(spark, sf_dir):
    t = F.col("x") * 4.0
    wave = F.struct(F.lit(0.0).alias("dx"), (F.lit(0.05) * (t - t * t * t / 6.0)).alias("dy"), F.lit(0.0).alias("dz"))
    return raster.accumulate([Cloud(features.with_displacement(line(spark, sf_dir), wave))], CAMERA, _MOVE)


_WAVE = f"pts AS (SELECT x, y + sin(x * {q.d(4.0)} + {q.d(3.0 * 0.5)}) * {q.d(0.05)} AS y, z, rgba FROM raw)"


@query("displace_wave", with_(_RAW, _WAVE, q.average_pixels(CAMERA, IMAGE, RADIUS), select=q.PIXELS))
def _(spark, sf_dir):
    """The sine itself; displace_sine has its polynomial."""
    return raster.accumulate([Cloud(features.with_displacement(line(spark, sf_dir), features.sine_wave(4.0, 0.05, 0.5)))], CAMERA, _MOVE)


@query("displace_nan_cull", with_(_RAW, "pts AS (SELECT x + 0.1::DOUBLE AS x, y, z, rgba FROM raw WHERE z < 0.2::DOUBLE)", q.average_pixels(CAMERA, IMAGE, RADIUS), select=q.PIXELS))
def _(spark, sf_dir):
    gone = F.when(F.col("z") < 0.2, 0.1).otherwise(F.lit(float("nan")))
    move = F.struct(gone.alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return raster.accumulate([Cloud(features.with_displacement(line(spark, sf_dir), move))], CAMERA, _MOVE)


@query("displacement_table_join", with_(q.NUM, "fea AS (SELECT point_id AS i, CASE WHEN point_id % 5 = 0 THEN NULL ELSE 0.05::DOUBLE END AS dx FROM pts WHERE point_id % 2 = 0)", "mov AS (SELECT x + CASE WHEN i IS NULL THEN 0 ELSE dx END AS x, y + 0.0 AS y, z + 0.0 AS z, rgba FROM pts LEFT JOIN fea ON i = point_id WHERE i IS NULL OR dx IS NOT NULL)", q.average_pixels(CAMERA, IMAGE, RADIUS, "mov"), select=q.PIXELS))
def _(spark, sf_dir):
    p = numbered(spark, sf_dir)
    side = p.where("src_idx % 2 = 0").select("src_idx", F.when(F.col("src_idx") % 5 != 0, 0.05).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return raster.accumulate([Cloud(features.join_features(p, side).select("x", "y", "z", "rgba", "dx", "dy", "dz"))], CAMERA, _MOVE)


def _dof_sql() -> str:
    coc = f"least(greatest((abs(-{q.row(CAMERA.view, 2)} - {q.d(2.4)}) - {q.d(0.1)}) / {q.d(0.4)}, 0), 1)"
    move = lambda k: f"({q.hashed(f'((src_idx * 3 + {k}) & 4294967295)')} * 2.0 - 1.0) * (coc * coc * {q.d(2.4 * 0.02)})"
    return f"dof_c AS (SELECT *, {coc} AS coc FROM pts), dof AS (SELECT point_id, src_idx, x + {move(0)} AS x, y + {move(1)} AS y, z + {move(2)} AS z, coc * {q.d(0.9)} AS tint_a, rgba FROM dof_c)"


_DOF = _COVER.but(apply_displacement=True)


@query("depth_of_field_image", with_(q.NUM, _dof_sql(), q.projected("dof", CAMERA, IMAGE), q.offsets(RADIUS), q.splats(IMAGE), q.depths(), _oit("spl", "least(greatest(1 - tint_a, 0), 1)"), select="SELECT oit.px, oit.py, depth, sum_r, sum_g, sum_b, cnt FROM oit JOIN dep USING (px, py)"))
def _(spark, sf_dir):
    coc = features.circle_of_confusion(CAMERA, IDENTITY, 2.4, 0.1, 0.4)
    p = numbered(spark, sf_dir)
    p = features.with_tint(features.with_displacement(p, features.defocus_scatter(coc, F.col("src_idx"), 2.4, 0.02)), features.defocus_tint(coc, 0.9))
    return raster.accumulate([Cloud(p)], CAMERA, _DOF)


for _name, (_f, _text) in streams.queries().items():
    query(_name, _text)(_f)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
