import random

import pytest
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import Camera, PackConfig, RasterConfig, look_at, perspective, standard_camera
from cloudweave.operators import pack, select, tables
from cloudweave.operators.tables import ranked
from cloudweave.sources import points as src

M64 = (1 << 64) - 1


def lcg_cloud(count, seed, span=2.0):
    """The points of a linear congruential generator (fixed multiplier and increment)."""
    out, s = [], seed

    def draw():
        nonlocal s
        s = (s * 6364136223846793005 + 1442695040888963407) & M64
        return (s >> 40) / (1 << 24)

    for i in range(count):
        x, y, z = (draw() * span - span / 2 for _ in range(3))
        out.append((i, x, y, z, *(draw() for _ in range(3)), 1.0))
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    rows = spark.createDataFrame(lcg_cloud(4000, 0x5EED), "point_id bigint, x double, y double, z double, r double, g double, b double, a double")
    return src.with_rgba(rows), pack.pack(src.with_rgba(rows), PackConfig(points_per_batch=256, coarse_divisions=8))


def test_every_point_is_packed_once_with_its_colour(cloud):
    raw, packed = cloud
    assert packed.points.select("point_id", "rgba").exceptAll(raw.select("point_id", "rgba")).count() == 0 and packed.points.count() == 4000
    assert packed.batches.agg(F.sum("num_points")).first()[0] == 4000 and packed.batches.count() == 16


def test_boxes_hold_their_points_and_counts_add_up(cloud):
    _, packed = cloud
    rows = packed.points.join(packed.batches, "batch_id")
    outside = F.lit(False)
    for a in "xyz":
        outside = outside | (F.col(a) < F.col(f"min_{a}")) | (F.col(a) > F.col(f"max_{a}"))
    assert rows.where(outside).count() == 0
    for r in packed.batches.collect():
        assert r.lod_cum[7] == r.num_points and list(r.lod_cum) == sorted(r.lod_cum)
    wrong = rows.where((F.col("local_idx") >= F.get("lod_cum", F.col("lod_level"))) | ((F.col("lod_level") > 0) & (F.col("local_idx") < F.get("lod_cum", F.col("lod_level") - 1))))
    assert wrong.count() == 0


def test_levels_are_greedy_by_rank(cloud):
    _, packed = cloud
    b, rows = packed.bounds, sorted(packed.points.collect(), key=lambda r: r.pk)
    claimed = {}
    for level in range(3):
        edge, seen = pack.voxel_edge(b, 8, level), set()
        for r in rows:
            if r.pk in claimed:
                continue
            cell = tuple(int((r[a] - b.low[k]) // edge) for k, a in enumerate("xyz"))
            if cell not in seen:
                seen.add(cell)
                claimed[r.pk] = level
    assert all(claimed.get(r.pk, 3) == r.lod_level for r in rows)


def test_morton_is_bit_interleaving_and_rank_is_dense(cloud):
    _, packed = cloud
    rows = sorted(packed.points.collect(), key=lambda r: r.pk)
    assert [r.pk for r in rows] == list(range(4000)) and all((a.mk, a.point_id) < (b.mk, b.point_id) for a, b in zip(rows, rows[1:]))
    e, low = packed.bounds.extent, packed.bounds.low
    for r in rows[::97]:
        cells = [int(min(max((r[a] - low[k]) * (1023.0 / e[k]), 0), 1023)) for k, a in enumerate("xyz")]
        assert r.mk == sum((cells[k] >> bit & 1) << (3 * bit + 2 - k) for bit in range(10) for k in range(3))


@pytest.mark.parametrize("n", range(0, 41))
def test_shuffle_is_the_swap_loop(n):
    order = list(range(n))
    i = 1
    while i < n - 1 - i:
        order[i], order[n - 1 - i] = order[n - 1 - i], order[i]
        i += 2
    swapped = [n - 1 - b if (b % 2 == 1 and b < n - 1 - b) or ((n - 1 - b) % 2 == 1 and n - 1 - b < b) else b for b in range(n)]
    assert swapped == order


def test_first_points_after_the_shuffle(cloud):
    _, packed = cloud
    at = 0
    for r in packed.batches.orderBy("new_id").collect():
        assert r.first_point == at
        at += r.num_points


def test_shuffle_column_and_off(spark, cloud):
    raw, _ = cloud
    got = [r[0] for r in spark.range(9).select(pack.shuffled_id(F.col("id"), F.lit(9))).collect()]
    assert got == [0, 7, 2, 5, 4, 3, 6, 1, 8]
    plain = pack.pack(raw, PackConfig(points_per_batch=512, shuffle_batches=False)).batches.collect()
    assert all(r.new_id == r.batch_id and r.first_point == r.batch_id * 512 for r in plain)


def test_hot_keys_rank_as_a_plain_sort(spark):
    rng = random.Random(8)
    rows = [(rng.choice([5] * 6 + [1, 2, 9, 300]), i, rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, i bigint, v double")
    want = {i: n for n, (_, i, _) in enumerate(sorted(rows))}
    for buckets in (16, 1, None):
        assert {r.i: r.n for r in ranked(df, "k", ["i"], "n", buckets=buckets).collect()} == want
    assert ranked(df.limit(0), "k", ["i"], "n").count() == 0


def test_quantised_words_and_precisions(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.999999999,), (1.0,)], "p double").withColumn("q", g.quantise30(F.col("p"), F.lit(0.0), F.lit(1.0)))
    for r in df.collect():
        assert r.q == int(min(r.p, 0.99999994) * 2**30)
    one = spark.range(1).select(*(g.word(F.lit(0x3FFFFFFF), F.lit(1 << 20), F.lit(5), w).alias(w) for w in ("low", "med", "high"))).first()
    assert (one.low, one.med, one.high) == (1023 + (1 << 10), 1023, 1023 + (5 << 20))


def test_empty_cloud(spark, cloud):
    raw, _ = cloud
    empty = pack.pack(raw.limit(0))
    assert empty.points.count() == 0 and empty.batches.count() == 0 and empty.bounds == pack.Bounds((0.0, 0.0, 0.0), (0.0, 0.0, 0.0))


def test_range_join_on_a_partly_filled_pool(spark):
    slots = spark.createDataFrame([(0, 0, 512, 1), (1, 512, 512, 1), (2, 1024, 307, 1), (3, 1536, 0, 0)], "batch_id int, first_point bigint, num_points int, state int")
    got = {r.i: (r.batch_id, r.local_idx) for r in pack.point_to_batch(spark.createDataFrame([(i,) for i in (0, 511, 512, 1330, 1331, 1600)], "i bigint"), slots).collect()}
    assert got == {0: (0, 0), 511: (0, 511), 512: (1, 0), 1330: (2, 306)}


def test_config_limits():
    assert PackConfig(lod_levels=99).lod_levels == 8 and PackConfig(lod_levels=0, coarse_divisions=0).coarse_divisions == 1
    with pytest.raises(ValueError):
        PackConfig(points_per_batch=70000)


def test_ranges_grow_with_the_rows_and_cut_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANK_ROWS", 500)
    sizes = []
    write = tables.written
    monkeypatch.setattr(tables, "written", lambda df, name: sizes.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) or write(df, name))
    df = spark.range(20_000).select(F.lit(7).cast("bigint").alias("k"), F.col("id").alias("i"))
    assert {r.n - r.i for r in ranked(df, "k", ["i"], "n").collect()} == {0}
    assert len(sizes) == 40 and max(sizes) < 1500


def test_levels_of_crowded_and_of_no_voxels(spark):
    rng = random.Random(4)
    rows = [(i, *(rng.choice([0.0, 0.01, 0.02, rng.random()]) for _ in range(3)), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "point_id bigint, x double, y double, z double, rgba bigint")
    for levels in (1, 2, 5, 8):
        config = PackConfig(points_per_batch=64, coarse_divisions=3, lod_levels=levels)
        packed = pack.pack(df, config)
        claimed = {}
        points = sorted(packed.points.collect(), key=lambda r: r.pk)
        for level in range(levels - 1):
            edge, seen = pack.voxel_edge(packed.bounds, 3, level), set()
            for r in points:
                cell = tuple(int((r[a] - packed.bounds.low[k]) // edge) for k, a in enumerate("xyz"))
                if r.pk not in claimed and cell not in seen:
                    seen.add(cell)
                    claimed[r.pk] = level
        assert [r.lod_level for r in points] == [claimed.get(r.pk, levels - 1) for r in points]


def files_read(df):
    """Bytes of the files that a scan has opened, by its own metric."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    # A scan that the planner has done away with has no such metric.
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("filesSize").value() for m in metrics if m.contains("filesSize"))


@pytest.fixture(scope="module")
def spread(spark):
    rows = spark.createDataFrame([r[:4] + (255,) for r in lcg_cloud(30_000, 0xB10C, 20.0)], "point_id bigint, x double, y double, z double, rgba bigint")
    return rows, pack.pack(rows, PackConfig(points_per_batch=100, coarse_divisions=8), block_points=300)


def test_files_hold_ranges_of_batches_by_level(spark, spread):
    _, packed = spread
    files = packed.points.groupBy(F.input_file_name().alias("f")).agg(F.min("batch_id").alias("low"), F.max("batch_id").alias("high"), F.count_distinct("block", "lod_level").alias("n"), F.min("block").alias("block")).collect()
    assert len(files) > 100 and all(r.n == 1 and r.high - r.low < 3 and r.low // 3 == r.block for r in files)
    assert packed.points.count() == 30_000 and {r.block for r in packed.batches.collect()} == set(range(100))


def test_a_camera_reads_the_files_it_needs(spark, spread):
    rows, packed = spread
    config = RasterConfig(enable_lod_dither=False)
    narrow = Camera(look_at((8.0, 8.0, 12.0), (8.0, 8.0, 0.0)), perspective(4.0, 1.0, 0.01, 100.0))
    zones = select.visible_batches(packed.batches, narrow, config)
    share = zones.count() / packed.batches.count()
    whole, part = files_read(packed.points.select("rgba")), files_read(packed.scan(zones).select("rgba"))
    assert 0 < share < 0.06 and part < 0.1 * whole
    # From afar only coarse levels are wanted, of all blocks.
    afar = standard_camera((0.0, 0.0, 90.0))
    zones = select.visible_batches(packed.batches, afar, config.but(lod_bias=-4))
    assert zones.count() > 200 and zones.agg(F.max("top")).first()[0] < 3
    assert files_read(packed.scan(zones).select("rgba")) < 0.75 * whole
    for camera in (narrow, afar, standard_camera((3.0, 1.0, 12.0))):
        loose = pack.PackedCloud(packed.points.drop("block"), packed.batches, packed.bounds, packed.config)
        got, want = (sorted(tuple(r) for r in select.selected_points(c, camera, RasterConfig()).collect()) for c in (packed, loose))
        assert got == want and got


def test_ranges_of_blocks(spark, monkeypatch):
    zones = spark.createDataFrame([(b, t) for b, t in [(0, 3), (0, 1), (1, 3), (2, 9), (5, 3), (9, 3), (20, 3), (3, 0), (7, 0)]], "block int, top int")
    assert pack.block_ranges(zones, 4) == {3: [(0, 2), (5, 5), (9, 9), (20, 20)], 0: [(3, 3), (7, 7)]}
    monkeypatch.setattr(pack, "MOST_RANGES", 2)
    assert pack.block_ranges(zones, 4) == {3: [(0, 9), (20, 20)], 0: [(3, 3), (7, 7)]}
    assert pack.block_ranges(zones.limit(0), 4) == {}


def test_nothing_seen_reads_nothing(spark, spread):
    _, packed = spread
    away = Camera(look_at((0.0, 0.0, 40.0), (0.0, 0.0, 90.0)), perspective(30.0, 1.0, 0.01, 100.0))
    assert select.selected_points(packed, away, RasterConfig()).count() == 0
    assert files_read(packed.scan(select.visible_batches(packed.batches, away, RasterConfig())).select("rgba")) == 0


def test_precision_of_batches_that_draw_no_points(spark, spread, monkeypatch):
    from cloudweave.plans import catalog

    _, packed = spread
    # The same batches, of which every third has points of the finest level alone.
    fine = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(k < 3, 0).otherwise(F.col("num_points")))
    batches = packed.batches.withColumn("lod_cum", F.when(F.col("batch_id") % 3 == 0, fine).otherwise(F.col("lod_cum")))
    monkeypatch.setattr(catalog, "packed", lambda spark, sf_dir: pack.PackedCloud(packed.points, batches, packed.bounds, packed.config))
    monkeypatch.setattr(catalog, "IMAGE", catalog.IMAGE.but(lod_bias=-9))
    ids = lambda df: {r.batch_id for r in df.collect()}
    inside = ids(batches.where(g.in_frustum(catalog.CLOSE.clip())))
    assert ids(catalog.queries()["precision_level"](spark, "")) == inside
    assert ids(catalog.queries()["prefix_select"](spark, "")) == ids(select.visible_batches(batches, catalog.CLOSE, catalog.IMAGE)) < inside


def test_blocks_are_bounded_whatever_the_cloud():
    config = PackConfig(points_per_batch=512)
    sizes = [pack.batches_per_block(n, config, 12) * 512 for n in (3_600_000, 36_000_000, 216_000_000)]
    assert max(sizes) <= 1 << 19 and sizes[2] <= 2 * sizes[0]


def test_voxels_are_sorted_in_slices_of_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(pack, "BLOCK_POINTS", 100)
    rows = [(i, x, y, z) for i, x, y, z, *_ in lcg_cloud(1950, 0xF10)]
    df = spark.createDataFrame(rows, "pk bigint, x double, y double, z double").coalesce(1)
    config, b = PackConfig(coarse_divisions=3), pack.bounds(df)
    sliced, count = pack.slices(df, 1950)
    sizes = [r["count"] for r in sliced.groupBy(F.spark_partition_id()).count().collect()]
    assert count == 20 and max(sizes) == 100 and sum(sizes) == 1950
    claims = pack.lod_claims(df, b, config, 1950)
    # What finds the first rows of voxels in the splits of the scan comes after the cut into slices.
    plan = claims._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1)
    assert "Partial" in plan[partial:].split("\n")[0] and "REPARTITION_BY_NUM" in plan[partial:]
    claimed = {}
    for level in range(3):
        edge, seen = pack.voxel_edge(b, 3, level), set()
        for pk, *place in rows:
            cell = tuple(int((v - low) // edge) for v, low in zip(place, b.low))
            if pk not in claimed and cell not in seen:
                seen.add(cell)
                claimed[pk] = level
    assert {r.pk: r.lod_level for r in claims.collect()} == claimed
