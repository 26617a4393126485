import re

from pyspark.sql import functions as F

from cloudweave.model import RasterConfig, standard_camera
from cloudweave.operators import features
from cloudweave.operators.history import DisplacementHistory
from cloudweave.operators.scene import Scene
from cloudweave.sources import points as src


def shift(dx, gone=None):
    x = F.lit(float(dx)) if gone is None else F.when(F.col("src_idx") == gone, float("nan")).otherwise(float(dx))
    return F.struct(x.alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))


def test_former_displacements_by_view(spark):
    memory = DisplacementHistory(spark, buckets=3)
    cloud = memory.bucketed("c", src.cube_grid(spark, 3).withColumn("src_idx", F.col("point_id")))
    frame = lambda dx, gone=None: features.with_displacement(cloud, shift(dx, gone))
    former = lambda view, df: {r.src_idx: r.prev_dx for r in memory.with_former(view, "c", df).collect()}
    assert set(former("a", frame(1)).values()) == {1.0}  # nothing before
    memory.snapshot("a", "c", frame(1, gone=5))
    memory.snapshot("b", "c", frame(7).where("src_idx < 20"))
    a, b = former("a", frame(2)), former("b", frame(2))
    assert a.pop(5) == 2.0 and set(a.values()) == {1.0}
    assert {i for i, d in b.items() if d == 7.0} == set(range(20)) and {d for i, d in b.items() if i >= 20} == {2.0}
    for k in (3, 4, 5):
        memory.snapshot("a", "c", frame(k))
    assert set(former("a", frame(9)).values()) == {5.0} and len(memory._frames["a", "c"]) == 2
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("cloudweave_")}
    memory.forget()
    after = {t.name for t in spark.catalog.listTables() if t.name.startswith("cloudweave_")}
    assert len(before - after) == 4


def test_the_join_moves_no_points(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        memory = DisplacementHistory(spark, buckets=4)
        cloud = memory.bucketed("c", src.cube_grid(spark, 6).withColumn("src_idx", F.col("point_id")))
        memory.snapshot("v", "c", features.with_displacement(cloud, shift(1)))
        joined = memory.with_former("v", "c", features.with_displacement(cloud, shift(2)))
        assert {(r.dx, r.prev_dx) for r in joined.collect()} == {(2.0, 1.0)}
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and not re.search(r"Exchange", plan)
        memory.forget()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_points_that_move_leave_streaks(spark):
    camera = standard_camera()
    config = RasterConfig(width=48, height=48, apply_displacement=True, motion_blur=1.0, motion_blur_samples=8, point_size_scale=1.0)
    scene = Scene(config)
    scene.add("grid", src.cube_grid(spark, 3))
    scene.displace("grid", shift(0.0))
    still = scene.render(camera).count()
    scene.displace("grid", shift(0.4))
    moving = scene.render(camera).count()
    assert scene.render(camera).count() <= still + 3 < moving  # the third frame stands where the second did
    scene.displace("grid", shift(0.0))
    scene.forget()
    assert scene.render(camera).count() == still
    scene.displace("grid", None)
    assert scene.render(camera).count() == still
    scene.remove("grid")
    assert not scene._history._clouds and not scene._history._frames
