import pytest
from pyspark.sql import functions as F

from cloudweave.model import PackConfig, RasterConfig, standard_camera
from cloudweave.operators.scene import Scene
from cloudweave.operators.tables import written_at
from cloudweave.operators.versions import Versions
from cloudweave.sources import points as src
from cloudweave.streaming import sweep


def ids(df):
    return sorted(r.id for r in df.collect())


def test_sizes_by_number():
    for points in (0, 1, 4, 9, 12):
        for short in (None, 0):
            sizes = sweep.EvenSizes(points, 4, short)
            assert len(sizes) == len(list(sizes)) and sum(sizes) == points


def test_a_killed_driver_leaves_the_former_front(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/s", []

    def select(a, b):
        calls.append((a, b))
        if len(calls) == 4:
            raise KeyboardInterrupt  # the driver is killed in the middle of a frame
        return spark.range(4 * a, 4 * b).withColumn("call", F.lit(len(calls)))

    driver = lambda **k: sweep.DurableSweep(Versions(spark, folder), [4, 4, 4, 4], select, budget=4, **k)
    config = RasterConfig()
    first = driver()
    assert first.front is None and first.advance(config) and ids(first.front) == list(range(16))
    seen = first.front
    assert not first.advance(config) and not first.advance(config) and first.progress == 0.5
    first.versions.write(spark.range(3))  # a table that was written but never named
    with pytest.raises(KeyboardInterrupt):
        first.advance(config)
    second = driver()
    assert second.progress == 0.5 and {r.call for r in second.front.collect()} == {1}
    assert not second.advance(config) and second.advance(config) and second.progress == 0
    assert ids(second.front) == list(range(16)) and {r.call for r in second.front.collect()} == {2, 3, 5, 6} and calls[1:] == [(0, 1), (1, 2), (2, 3), (2, 3), (3, 4)]
    assert ids(seen) == list(range(16))  # a reader of the former front set still has it
    assert second.tidy() == 2 and ids(second.front) == list(range(16))
    # Other levels of detail start again, another content too, with a full sweep.
    assert not second.advance(config) and not second.advance(config.but(lod_bias=1)) and second.progress == 0.25
    other = driver(key="2")
    assert other.front is None and other.progress == 0 and other.advance(config) and other.state["sweeps"] == 1
    assert not sweep.DurableSweep(Versions(spark, f"file://{tmp_path}/none"), [], select).advance()


def test_scenes_sweep_and_go_on(spark, tmp_path):
    camera, config = standard_camera(), RasterConfig(width=32, height=32)
    grid = src.cube_grid(spark, 8)
    packing = PackConfig(points_per_batch=100, coarse_divisions=4)
    scene = Scene(config.but(lod_points_per_frame=250), f"file://{tmp_path}/scene")
    plain = Scene(config)
    for s in (scene, plain):
        s.add("grid", grid, packing=packing)
    image = lambda s, c=camera: sorted(map(tuple, s.render(c).collect()))
    want = image(plain)
    assert image(scene) == want  # the first frame has no front set, so it sweeps all
    moved = standard_camera((0.3, 0.2, 2.4))
    before = {r.src_idx for r in scene.sweep("grid", camera).front.collect()}
    assert image(scene, moved) and {r.src_idx for r in scene.sweep("grid", moved).front.collect()} == before  # the front set is the first camera's
    swept = scene.sweep("grid", moved)
    assert 0 < swept.progress < 1 and swept.state["sweeps"] == 1
    again = Scene(config.but(lod_points_per_frame=250), f"file://{tmp_path}/scene")
    again.add("grid", grid, packing=packing)
    again.render(moved).count()
    assert again.sweep("grid", moved).state["sweeps"] == 2 or again.sweep("grid", moved).progress > swept.progress
    again.add("grid", grid, packing=packing)
    assert again.sweep("grid", moved).front is None


def test_a_cache_that_ends(spark):
    cache, config, made = sweep.SelectCache(most=2), RasterConfig(), []

    def make():
        made.append(written_at(spark.range(len(made) + 1), "cached"))
        return made[-1]

    cameras = [standard_camera((0.0, 0.0, 2.0 + k)) for k in range(4)]
    get = lambda k, g=1, cloud="c": cache.get(cloud, g, cameras[k], config, None, make)
    there = lambda k: spark._jvm.org.apache.hadoop.fs.Path(made[k][1]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(made[k][1]))
    a = get(0)
    get(1)
    assert get(0) is a and cache.skipped == 1
    get(2)  # 1 was used least recently
    assert len(cache) == 2 and [there(k) for k in range(3)] == [True, False, True] and a.count() == 1
    with cache.held(a):
        with cache.held(a):
            get(3)
            get(1)
            assert cache.evicted == 3 and there(0)
        assert there(0) and a.count() == 1
    assert not there(0)
    get(1, g=2)  # a later generation takes the place of the former
    assert len(cache) == 2 and not there(4) and there(5)
    cache.forget("c")
    assert len(cache) == 0 and not any(there(k) for k in range(len(made)))
