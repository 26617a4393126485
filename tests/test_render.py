import math
import random

import pytest
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import Camera, Cloud, PackConfig, PointSize, RasterConfig, RenderMode, inverse, look_at, multiply, orthographic, standard_camera
from cloudweave.operators import features, pack, raster, resolve, select
from cloudweave.sources import points as src

CAMERA = standard_camera()
CONFIG = RasterConfig(width=64, height=64, point_size_scale=3.0)


def cloud_of(spark, rows):
    return src.from_rows(spark, rows).withColumn("src_idx", F.col("point_id"))


def grid(n, z, colour, span=0.5):
    return [((i / (n - 1) - 0.5) * 2 * span, (j / (n - 1) - 0.5) * 2 * span, z(i, j) if callable(z) else z, *colour, 1.0) for i in range(n) for j in range(n)]


@pytest.fixture(scope="module")
def cube(spark):
    return src.cube_grid(spark, 10).withColumn("src_idx", F.col("point_id")).cache()


def image(points, config=CONFIG, camera=CAMERA, then=None):
    return {(r.px, r.py): r for r in resolve.render([Cloud(points)], camera, config, then).collect()}


def test_reverse_depth_and_matrices():
    m = CAMERA.clip()
    z = lambda d: (m[10] * (2.4 - d) + m[14]) / (m[11] * (2.4 - d) + m[15])
    assert z(0.01) == pytest.approx(1) and z(100) == pytest.approx(0, abs=1e-9) and z(1) > z(2) > z(50)
    assert multiply(m, inverse(m)) == pytest.approx((1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1), abs=1e-6)


def test_cube_covers_the_centre_and_facing_away_nothing(cube):
    seen = image(cube)
    assert len(seen) > 0.01 * 64 * 64 and (32, 32) in seen and all(r.depth > 0 and r.a == 1 for r in seen.values())
    away = Camera(look_at((0.0, 0.0, 2.4), (0.0, 0.0, 100.0)), CAMERA.projection)
    assert not image(cube, camera=away)


def test_the_mean_is_of_all_points_in_the_band(spark):
    p = cloud_of(spark, [(0, 0, 0, 1, 0, 0, 1), (0, 0, 1e-4, 0, 0, 1, 1), (0, 0, -1, 0, 1, 0, 1)])
    r = image(p, CONFIG.but(point_size_scale=1.0))
    assert len(r) == 1 and [(v.r, v.g, v.b) for v in r.values()] == [(0.5, 0, 0.5)]
    near = image(p, CONFIG.but(point_size_scale=1.0, depth_tolerance=0.0))
    assert [(v.r, v.g, v.b) for v in near.values()] == [(0, 0, 1)]


def test_splats_are_discs_and_are_cut_at_the_border(spark):
    for scale, count in ((1.0, 1), (3.0, 9), (5.0, 21)):
        assert len(image(cloud_of(spark, [(0, 0, 0, 1, 1, 1, 1)]), CONFIG.but(point_size_scale=scale))) == count
    assert g.radius_of(100) == 16 and g.radius_of(0) == 0 and len(g.disc(16)) < 33 * 33


def test_selection_of_a_packed_cloud(spark, cube):
    packed = pack.pack(cube, PackConfig(points_per_batch=64, coarse_divisions=4))
    full = select.select_points(packed, CAMERA, CONFIG.but(enable_clod=False))
    assert full.count() == 1000
    far = standard_camera((0.0, 0.0, 40.0))
    few = select.select_points(packed, far, CONFIG.but(lod_bias=-2))
    assert 0 < few.count() < 1000 and select.select_points(packed, Camera(look_at((0.0, 0.0, 2.4), (0.0, 0.0, 9.0)), CAMERA.projection), CONFIG).count() == 0
    legacy = packed.batches.withColumn("lod_cum", F.lit(None).cast("array<bigint>"))
    assert select.visible_batches(legacy, far, CONFIG).where("active_points <> num_points").count() == 0
    assert select.visible_batches(packed.batches.withColumn("state", F.lit(0)), CAMERA, CONFIG).count() == 0


def test_rejection_stops_a_far_plane_from_showing_through(spark):
    planes = cloud_of(spark, grid(14, 0.25, (1, 0, 0)) + grid(40, -0.5, (0, 1, 0)))
    config = CONFIG.but(point_size_scale=1.0)
    green = lambda im: sum(r.g > 0.5 for r in im.values())
    plain = green(image(planes, config))
    assert green(image(planes, config.but(enable_point_rejection=True, rejection_cone_threshold=1.2))) < 0.75 * plain
    both = config.but(enable_point_rejection=True, rejection_cone_threshold=1.2, render_mode=RenderMode.NEAREST)
    assert green(image(planes, both)) < 0.75 * plain


def test_a_tilted_surface_does_not_reject_itself(spark):
    tilted = cloud_of(spark, grid(40, lambda i, j: (j / 39 - 0.5) * 0.35, (0.9, 0.9, 0.9), 0.6))
    config = CONFIG.but(point_size_scale=5.0, enable_point_rejection=True)
    lit = len(image(tilted, config.but(enable_point_rejection=False)))
    fixed = lit - len(image(tilted, config.but(depth_tolerance=0.05)))
    bug = lit - len(image(tilted, config.but(depth_tolerance=0.0)))
    assert fixed <= lit / 200 and fixed <= bug


def test_hole_filling_grows_within_what_is_around(spark):
    sparse = cloud_of(spark, grid(22, 0.0, (0.2, 0.8, 0.5)))
    config = CONFIG.but(point_size_scale=1.0)
    before, after = image(sparse, config), image(sparse, config.but(hole_fill_iterations=2))
    assert len(after) > len(before)
    for k, r in after.items():
        assert r.depth > 0 and r.a == 1 and abs(r.g - 0.8) < 0.01
        if k in before:
            assert r.depth == pytest.approx(before[k].depth, abs=1e-9)


def test_nearest_ties_and_pick(spark):
    p = cloud_of(spark, [(0, 0, 0, 1, 0, 0, 1), (0, 0, 0, 0, 1, 0, 1), (0, 0, -1, 0, 0, 1, 1), (0.4, 0.4, 0, 1, 1, 1, 1)])
    rows = raster.project(p, CAMERA, CONFIG)
    least = {r.src_idx for r in raster.nearest_winners(rows, CONFIG, CAMERA).collect()}
    most = {r.src_idx for r in raster.nearest_winners(rows, CONFIG, CAMERA, prefer="max").collect()}
    assert least == {0, 3} and most == {1, 3}
    winners = raster.nearest_winners(rows, CONFIG, CAMERA)
    assert resolve.pick(winners, (0.0, 0.0), CONFIG, 5).first().src_idx == 0 and resolve.pick(winners, (-0.9, -0.9), CONFIG, 5).count() == 0
    at = (0.4 / 2.4 * CAMERA.projection[0], 0.4 / 2.4 * CAMERA.projection[5])
    assert resolve.pick(winners, at, CONFIG, 5).first().src_idx == 3


def test_displacement_moves_and_deletes(spark, cube):
    centre = lambda im: sum(k[0] for k in im) / len(im)
    config = CONFIG.but(apply_displacement=True)
    move = lambda dx: features.with_displacement(cube, F.struct(F.lit(dx).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz")))
    still, moved = image(cube), image(move(0.3), config)
    assert centre(moved) > centre(still) + 2
    assert not image(move(float("nan")), config) and not image(move(None), config)
    assert image(move(0.0), config) == still
    wave = features.with_displacement(cube, features.sine_wave(4.0, 0.1, 1.0))
    assert len(image(wave, config)) > 0

    @F.pandas_udf(features.DISPLACEMENT_TYPE)
    def shift(x):
        import pandas as pd

        return pd.DataFrame({"dx": x * 0 + 0.3, "dy": x * 0, "dz": x * 0})

    assert image(features.with_displacement(cube, shift("x")), config).keys() == moved.keys()


def test_tint_replaces_discards_and_leaves(spark, cube):
    config = CONFIG.but(apply_tint=True)
    tint = lambda a: features.with_tint(cube, F.struct(F.lit(1.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit(a).alias("a")))
    assert all(r.r == 1 and r.g == 0 for r in image(tint(1.0), config).values())
    assert not image(tint(-1.0), config) and image(tint(0.0), config) == image(cube)


def test_a_discarded_tint_still_hides_what_is_behind(spark):
    p = cloud_of(spark, [(0, 0, 0.2, 1, 0, 0, 1), (0, 0, -0.5, 0, 1, 0, 1)])
    a = F.when(F.col("src_idx") == 0, -1.0).otherwise(0.0)
    tinted = features.with_tint(p, F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), a.alias("a")))
    assert not image(tinted, CONFIG.but(apply_tint=True, point_size_scale=1.0))
    cover = image(tinted, CONFIG.but(apply_tint=True, tint_alpha_is_coverage=True, point_size_scale=1.0))
    assert [r.g for r in cover.values()] == [1.0]


def test_motion_blur_spreads_and_is_translucent(cube):
    config = CONFIG.but(motion_blur=1.0)
    still, blurred = image(cube), image(cube, config, then=standard_camera((0.6, 0.3, 2.4)))
    assert len(blurred) > len(still) and any(0 < r.a < 1 for r in blurred.values())
    assert image(cube, config).keys() == still.keys()


def test_edges_are_antialiased(spark):
    p = cloud_of(spark, [(0, 0, 0, 1, 1, 1, 1)])
    config = CONFIG.but(point_size_scale=21.0, point_edge_antialiasing=True)
    soft = image(p, config)
    assert all(r.a == 1 for r in image(p, config.but(point_edge_antialiasing=False)).values())
    assert sum(0 < r.a < 1 for r in soft.values()) > 20 and soft[32, 31].a == 1


def test_world_sizes_and_orthographic(spark):
    p = cloud_of(spark, [(0, 0, 0.9, 1, 1, 1, 1), (0.5, 0, -1, 1, 1, 1, 1)])
    config = CONFIG.but(point_size_mode=PointSize.WORLD, point_size_scale=0.05, maximum_point_size=30.0)
    near = sum(r.depth > 0.0065 for r in image(p, config).values())
    assert near > len(image(p, config)) - near > 0
    ortho = Camera(CAMERA.view, orthographic(3.0, 3.0, 0.01, 100.0))
    sizes = image(p, config, ortho)
    assert len(sizes) == 2 * len(g.disc(g.radius_of(2 * 0.05 * 32 * 2 / 3)))
    assert len(image(p, config.but(enable_point_rejection=True), ortho)) > 0


def test_world_mode_equals_screen_mode_at_one_size(cube):
    world = CONFIG.but(point_size_mode=PointSize.WORLD, minimum_point_size=3.0, maximum_point_size=3.0)
    assert image(cube, world) == image(cube)


def test_clouds_are_one_scene_and_hidden_ones_are_not_in_it(spark):
    red, green = cloud_of(spark, [(0, 0, 0.2, 1, 0, 0, 1)]), cloud_of(spark, [(0, 0, -0.2, 0, 1, 0, 1)])
    both = resolve.render([Cloud(red), Cloud(green)], CAMERA, CONFIG.but(point_size_scale=1.0)).collect()
    assert [(r.r, r.g) for r in both] == [(1.0, 0.0)]
    hidden = resolve.render([Cloud(red, visible=False), Cloud(green)], CAMERA, CONFIG).first()
    assert hidden.g == 1.0
    near = resolve.render([Cloud(red, parents=(Cloud(None, visible=False),)), Cloud(green)], CAMERA, CONFIG.but(render_mode=RenderMode.NEAREST)).first()
    assert near.g == 1.0
    with pytest.raises(ValueError):
        resolve.render([Cloud(red, visible=False)], CAMERA, CONFIG)


def test_composites(spark):
    config = CONFIG.but(point_size_scale=1.0)
    front, back = (resolve.render([Cloud(cloud_of(spark, [(0, 0, z, 1, 0, 0, 1)]))], CAMERA, config) for z in (0.3, -0.3))
    scene = resolve.render([Cloud(cloud_of(spark, [(0, 0, 0, 0, 0, 1, 1)]))], CAMERA, config)
    assert resolve.composite_depth(front, scene).first().r == 1 and resolve.composite_depth(back, scene).first().b == 1
    over = resolve.composite_over(back, scene).first()
    assert (over.r, over.b) == (1, 0) and over.depth == scene.first().depth
    part = resolve.in_viewport(front, (5, 6), 2).collect()
    own = front.first()
    assert {(r.px, r.py) for r in part} == {(own.px * 2 + dx + 5, own.py * 2 + dy + 6) for dx in (0, 1) for dy in (0, 1)}
    full = resolve.dense(front, config)
    assert full.count() == 64 * 64 and full.where("a = 0").count() == 64 * 64 - 1


def test_supersampling_keeps_sizes_on_screen(cube):
    fine = CONFIG.but(render_scale=2.0)
    big = resolve.render([Cloud(cube)], CAMERA, fine)
    small = resolve.downsampled(big, 2).collect()
    assert big.agg(F.max("px")).first()[0] > 64 and abs(len(small) - len(image(cube))) < 0.2 * len(small)


def test_hash_and_planes(spark):
    def plain(x):
        x ^= x >> 16
        x = x * 0x7FEB352D & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x846CA68B & 0xFFFFFFFF
        return (x ^ x >> 16) / 2**32

    values = [0, 1, 2, 65535, 65536, 123456789, 2**32 - 1]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(g.hash_unit(F.col("v"))).collect()
    assert [r[0] for r in got] == [plain(v) for v in values]
    assert all(math.isclose(a * a + b * b + c * c, 1) for a, b, c, _ in g.frustum_planes(CAMERA.clip()))


@pytest.mark.parametrize("prefer", ["min", "max"])
@pytest.mark.parametrize("config", [RasterConfig(width=24, height=24, point_size_scale=3.0), RasterConfig(width=24, height=24, point_size_mode=PointSize.WORLD, point_size_scale=0.05, maximum_point_size=5.0)])
def test_winners_by_key_and_by_depth_agree(spark, prefer, config):
    rng = random.Random(17)
    rows = [(i, *(round(rng.uniform(-0.5, 0.5), 1) for _ in range(3)), rng.randrange(1 << 32)) for i in range(3000)]
    points = spark.createDataFrame(rows, "src_idx bigint, x double, y double, z double, rgba bigint").where("src_idx % 3 <> 1")
    camera = standard_camera()
    seen = raster.project(points, camera, config)
    narrow, by_depth = (raster.nearest_winners(seen, config, camera, prefer, wide=w) for w in (False, True))
    far = raster.nearest_winners(seen.withColumn("src_idx", F.col("src_idx") + (1 << 40)), config, camera, prefer)
    got = sorted(map(tuple, narrow.collect()))
    assert got and got == sorted(map(tuple, by_depth.collect())) == sorted((x, y, d, i - (1 << 40), c) for x, y, d, i, c in far.collect())
    pixels = {}
    for r in raster.splat(seen, config, camera).collect():
        order = (r.depth, -r.src_idx if prefer == "min" else r.src_idx)
        pixels[r.px, r.py] = max(pixels.get((r.px, r.py), ((-1, 0), 0)), (order, r.rgba))
    assert got == sorted((x, y, d, abs(i), c) for (x, y), ((d, i), c) in pixels.items() if d > 0)
    for plan in (narrow, by_depth):
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("config", [RasterConfig(width=40, height=40, point_size_scale=11.0), RasterConfig(width=40, height=40, point_size_mode=PointSize.WORLD, point_size_scale=0.06, maximum_point_size=9.0)])
def test_wide_footprints_are_summed_by_the_limits_they_reach(spark, config):
    rng = random.Random(23)
    rows = [(i, rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4), rng.choice([0.3, rng.uniform(-0.5, 0.5)]), rng.randrange(1 << 32)) for i in range(2500)]
    points = spark.createDataFrame(rows, "src_idx bigint, x double, y double, z double, rgba bigint")
    assert not raster._cells(raster._fixed_radius(config, CAMERA))
    seen = raster.project(points, CAMERA, config)
    depths = raster.depth_image(seen, config, CAMERA).cache()
    got = {(r.px, r.py): (r.sum_r, r.sum_g, r.sum_b, r.cnt) for r in raster.average_sums(seen, depths, config, CAMERA).collect()}
    near, want = {(r.px, r.py): r.depth for r in depths.collect()}, {}
    for r in raster.splat(seen, config, CAMERA).collect():
        d = near[r.px, r.py]
        if d > 0 and r.ndc_z >= d / g.DEPTH_STEPS * (1.0 - config.depth_tolerance):
            was = want.get((r.px, r.py), (0, 0, 0, 0))
            want[r.px, r.py] = tuple(a + b for a, b in zip(was, (r.rgba & 255, r.rgba >> 8 & 255, r.rgba >> 16 & 255, 1)))
    assert got == want and len(got) > 300
