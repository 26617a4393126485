import json
import logging
import random

import pytest
from pyspark.sql import functions as F

from cloudweave.model import RasterConfig, standard_camera
from cloudweave.operators import pack, resolve, select, tables
from cloudweave.sources import chunks
from cloudweave.sources import points as src
from cloudweave.streaming import residency, sweep


def chunk(name, depth=0, num_points=200):
    return {"chunk_id": name, "depth": depth, "num_points": num_points}


def test_pinned_chunks_stay_and_deep_ones_are_evicted():
    pool = residency.Pool.new(8, pinned_depth=2)
    pool.apply([chunk("a", 0), chunk("b", 1), chunk("c", 3), chunk("d", 4)], [])
    t = pool.telemetry("x")
    assert (t["resident_chunks"], t["pinned_chunks"], t["generation"]) == (4, 2, 1)
    pool.apply([], ["c", "d"])
    t = pool.telemetry("x")
    assert (t["resident_chunks"], t["pinned_chunks"], t["evicted_chunks"], t["free_slots"], t["generation"]) == (2, 2, 2, 6, 2)


def test_full_pool_waits_and_tries_again():
    pool = residency.Pool.new(2)
    pool.apply([chunk("a"), chunk("b"), chunk("c")], [])
    t = pool.telemetry("x")
    assert (t["resident_chunks"], t["pending_chunks"], t["starved_ticks"], t["blocked_on_full_pool"]) == (2, 1, 1, True)
    pool.apply([], ["a"])
    t = pool.telemetry("x")
    assert (t["resident_chunks"], t["pending_chunks"], t["uploaded_chunks"]) == (2, 0, 3)
    assert [b["slot"] for b in pool.batches()] == [1, 0]


def test_oversized_late_and_repeated_chunks():
    pool = residency.Pool.new(2, upload_limit=1)
    pool.apply([chunk("huge", 0, 5000), chunk("a"), chunk("a"), chunk("b"), chunk("c")], [])
    assert pool.last_error and pool.dropped == 1 and list(pool.resident) == ["a"]
    pool.apply([], ["c", "nowhere"])
    assert pool.dropped == 2 and list(pool.resident) == ["a", "b"] and pool.evicted == 0
    before = pool.generation
    pool.replace([chunk("n", 0, 300)])
    assert list(pool.resident) == ["n"] and pool.generation > before and [b["num_points"] for b in pool.batches()] == [256, 44]
    again = residency.Pool.from_json(pool.to_json())
    assert again == pool


def test_settle_states_and_rate():
    s = residency.settle_state
    assert s(False, 0, False, False) == s(True, 2, False, False) == "streaming"
    assert s(True, 0, False, False) == "settled(full)"
    assert s(True, 3, True, False) == "settled(clamped(byBudget=false, byPool=true))"
    assert residency.decode_rate(None, 300, 0.01) is None and residency.decode_rate(None, 200000, 0.08) == 2.5e6
    assert residency.decode_rate(100.0, 20, 0.1) == pytest.approx(120.0)
    assert residency.split_budget(10, 3) == [3, 3, 3] and residency.pixel_scale(256, standard_camera().projection) > 0


def test_stream_is_the_replay(spark, tmp_path):
    rng = random.Random(1)
    rows = [("c%d" % (i % 2), i, rng.choice(["add", "add", "remove"]), f"k{rng.randint(0, 12)}", rng.randint(0, 4), rng.randint(1, 700)) for i in range(90)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], residency.DELTA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(residency.DELTA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = residency.follow(stream, 9, points_per_batch=256, pinned_depth=1).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    told = {(r.cloud_id, r.tick): r for r in spark.sql("select * from told").collect()}
    ticked = spark.createDataFrame([(*r, i // 30) for i, r in enumerate(rows)], residency.DELTA + ", tick int")
    want = residency.replay(ticked, 9, points_per_batch=256, pinned_depth=1).collect()
    assert len(want) == 6 and all(told[r.cloud_id, r.tick] == r for r in want)
    slots = residency.resident_batches(spark.sql("select * from told")).collect()
    last = {r.cloud_id: r for r in want if r.tick == 3}
    assert len(slots) == sum(r.resident_batches for r in last.values()) and sum(r.num_points for r in slots) == sum(r.resident_points for r in last.values())


def test_plan_chunk_and_sweeps(spark):
    plan = sweep.plan_chunk
    assert plan([10, 10, 10], 0, 15, True) == sweep.Chunk(0, 2, True, False)
    assert plan([10, 10, 10], 2, 15, True) == sweep.Chunk(2, 1, False, True)
    assert plan([50, 10], 0, 5, True).count == 1 and plan([5, 5], 0, 0, True).completes and plan([5, 5], 0, 1, False).completes
    driver = sweep.SweepDriver([4, 4, 4], lambda a, b: spark.range(4 * a, 4 * b), budget=4)
    assert driver.advance() and driver.front.count() == 12
    first = driver.front
    assert not driver.advance() and driver.front is first and driver.progress == pytest.approx(1 / 3)
    driver.restart()
    assert [driver.advance() for _ in range(3)] == [False, False, True] and sorted(r.id for r in driver.front.collect()) == list(range(12))
    driver.replace([4], lambda a, b: spark.range(4))
    assert driver.front is None and driver.advance() and driver.front.count() == 4 and driver.sweeps == 3


def test_select_cache(spark):
    cache, camera = sweep.SelectCache(), standard_camera()
    config = RasterConfig()
    make = lambda: spark.range(1)
    a = cache.get("c", 1, camera, config, None, make)
    assert cache.get("c", 1, camera, config.but(point_size_scale=9.0), None, make) is a and cache.skipped == 1
    assert cache.get("c", 1, camera, config.but(lod_bias=1), None, make) is not a
    cache.get("c", 2, camera, config, None, make)
    cache.get("c", 2, standard_camera((1.0, 0.0, 2.0)), config, None, make)
    assert cache.ran == 4


def test_capacity_and_warning(spark, caplog):
    cloud = pack.pack(src.cube_grid(spark, 8), pack.PackConfig(points_per_batch=64, coarse_divisions=4))
    chosen = select.select_points(cloud, standard_camera(), RasterConfig(enable_lod_dither=False))
    full = chosen.count()
    s = select.selection_stats(chosen, 100).first()
    assert (s.appended, s.overflow, s.kept) == (full, full - 100, 100) and select.capped(chosen, 100).count() == 100
    with caplog.at_level(logging.WARNING, "cloudweave"):
        assert resolve.warn_overflow("grid", s.overflow, 100) and not resolve.warn_overflow("grid", s.overflow, 100)
    assert len(caplog.records) == 1


def test_sweep_restarts_on_other_levels_of_detail(spark):
    driver, config = sweep.SweepDriver([4, 4, 4], lambda a, b: spark.range(4 * a, 4 * b), budget=4), RasterConfig()
    assert driver.advance(config) and not driver.advance(config) and driver.cursor == 1
    assert not driver.advance(config.but(point_size_scale=3.0)) and driver.cursor == 2
    assert not driver.advance(config.but(lod_bias=1)) and driver.cursor == 1
    assert [driver.advance(config.but(lod_bias=1)) for _ in range(2)] == [False, True]
    assert sorted(r.id for r in driver.front.collect()) == list(range(12))


def test_chunk_deltas_within_a_budget(spark, tmp_path):
    for cloud in "ab":
        (tmp_path / cloud).mkdir()
        for k in range(3):
            row = {"cloud_id": cloud, "seq": k, "op": "add", "chunk_id": f"{k}-0-0-0", "depth": 1, "num_points": 10}
            (tmp_path / cloud / f"{k}.json").write_text(json.dumps(row) + "\n")
    paths = [str(tmp_path / c) for c in "ab"]

    def ticks(total_bytes, name):
        seen = []
        query = chunks.chunk_deltas(spark, paths, total_bytes).writeStream.foreachBatch(lambda df, k: seen.append(sorted((r.cloud_id, r.seq) for r in df.collect())))
        query.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return seen

    everything = [(c, k) for c in "ab" for k in range(3)]
    small = ticks(2, "small")
    assert len(small) == 3 and [len(t) for t in small] == [2, 2, 2] and sorted(sum(small, [])) == everything
    assert ticks(None, "all") == [everything]
    with pytest.raises(ValueError):
        chunks.chunk_deltas(spark, [])


def told_by_hand(ticks, slots, batch, limit):
    """Figures after each tick of (op, chunk, points) records, from nothing but who holds each slot and who waits."""
    holder, kept, size, queue, out = [None] * slots, {}, {}, [], []
    order = list(range(slots))
    up = down = lost = hungry = 0
    for records in ticks:
        gone = [c for op, c, _ in records if op == "remove"]
        for c in gone:
            if c in size:
                order = kept[c][::-1] + order
                holder = [None if h == c else h for h in holder]
                del size[c]
                down += 1
        lost += sum(c in gone for c, _ in queue)
        queue = [w for w in queue if w[0] not in gone] + [(c, n) for op, c, n in records if op == "add"]
        placed, stuck = 0, False
        while queue and placed < limit:
            c, n = queue[0]
            need = max(1, (n + batch - 1) // batch)
            if c not in size and need > slots:
                lost += 1
            elif c not in size and need > len(order):
                hungry, stuck = hungry + 1, True
                break
            elif c not in size:
                kept[c], order = order[:need], order[need:]
                for s in kept[c]:
                    holder[s] = c
                size[c], up, placed = n, up + 1, placed + 1
            queue = queue[1:]
        firsts = [(c, s) for c in size for s in kept[c]]
        assert sorted(s for _, s in firsts) == [s for s, h in enumerate(holder) if h] and holder.count(None) == len(order)
        out.append((len(size), sum(size.values()), len(queue), up, down, lost, hungry, len(order), stuck, firsts))
    return out


@pytest.mark.parametrize("rows_at_once", [7, 10_000])
def test_replay_against_a_pool_kept_by_hand(spark, rows_at_once):
    rng = random.Random(5)
    records = {c: [[(rng.choice(["add", "add", "add", "remove"]), f"k{rng.randint(0, 30)}", rng.randint(1, 2800)) for _ in range(rng.randint(1, 20))] for _ in range(25)] for c in ("a", "b", None)}
    rows = [(c, 100 * t + i, op, k, 0, n, t) for c, ticks in records.items() for t, part in enumerate(ticks) for i, (op, k, n) in enumerate(part)]
    rows += [("a", 1, "add", "never", 0, 1, None)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        told = residency.replay(spark.createDataFrame(rows, residency.DELTA + ", tick int"), 10, points_per_batch=256, upload_limit=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for cloud, ticks in records.items():
        want = told_by_hand(ticks, 10, 256, 3)
        own = sorted((r for r in told if r.cloud_id == cloud), key=lambda r: r.tick)
        got = [
            (r.resident_chunks, r.resident_points, r.pending_chunks, r.uploaded_chunks, r.evicted_chunks, r.dropped_chunks, r.starved_ticks, r.free_slots, r.blocked_on_full_pool, [(b["chunk_id"], b["slot"]) for b in json.loads(r.slots)])
            for r in own
        ]
        assert got == want and any(w[8] for w in want) and want[-1][5] and want[-1][4]


def test_rates_and_quantiles_of_hot_null_and_short_keys(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(1, 900), rng.choice([0.01, 0.05, 0.2, 1.5])) for i in range(400) for k in ["hot", rng.choice(["b", "c", None])]] + [("short", 1, 5, 0.001), ("none", 1, 5, None)]
    samples = spark.createDataFrame(rows, "k string, at long, points int, seconds double")
    got = {r.k: r.decode_rate for r in residency.decode_rates(samples, "k", "at").collect()}
    for key in {r[0] for r in rows}:
        rate = None
        for _, _, points, seconds in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            rate = rate if seconds is None else residency.decode_rate(rate, points, seconds)
        assert got.pop(key) == (rate if rate is None else pytest.approx(rate))
    assert not got
    of = {"low": 0.0, "median": 0.5, "p90": 0.9, "top": 1.0}
    found = {r.k: r for r in tables.quantiles(samples, "k", "seconds", ["at"], of).collect()}
    for r in samples.groupBy("k").agg(*(F.percentile("seconds", q).alias(n) for n, q in of.items()), F.avg("seconds").alias("mean")).collect():
        assert [found[r.k][n] for n in (*of, "mean")] == [v if v is None else pytest.approx(v) for v in (r[n] for n in (*of, "mean"))]
    assert tables.quantiles(samples.limit(0), "k", "seconds", ["at"], of).count() == 0


def test_dropping_waiting_chunks_looks_at_no_others():
    looked = []

    class Chunk(dict):
        def __getitem__(self, key):
            looked.append(dict.__getitem__(self, "chunk_id"))
            return dict.__getitem__(self, key)

    queue = residency.Queue([Chunk(chunk(f"k{k % 700}")) for k in range(1000)])
    looked.clear()
    assert queue.drop({"k5", "k650", "nowhere"}) == 3 and len(queue) == 997 and len(looked) <= 3
    for k in range(5):
        assert queue.first()["chunk_id"] == f"k{k}"
        queue.done()
    assert queue.first()["chunk_id"] == "k6" and len(queue) == 992 and [c["chunk_id"] for c in queue][-1] == "k299"
    pool = residency.Pool.new(2, upload_limit=1)
    pool.apply([chunk("a"), chunk("b"), chunk("c"), chunk("d")], [])
    pool.apply([], ["c"])
    again = residency.Pool.from_json(pool.to_json())
    assert again == pool and again.telemetry("x") == pool.telemetry("x") and [c["chunk_id"] for c in again.pending] == ["d"]
