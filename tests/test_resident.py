import random

import pytest
from pyspark.sql import functions as F

from cloudweave.model import RasterConfig, standard_camera
from cloudweave.operators import raster
from cloudweave.operators.versions import Conflict, Versions
from cloudweave.streaming import residency, resident

PER = 8


class Maps:
    """What a state's handle gives, in memory, with counts of what is written."""

    def __init__(self):
        self.tables, self.value = {}, None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getMapState(self, name, key, value):
        return self.tables.setdefault(name, Map())


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(sorted(self.items()))


@pytest.mark.parametrize("seed", range(4))
def test_pool_in_maps_is_the_pool_in_memory(seed):
    rng, handle = random.Random(seed), Maps()
    plain = residency.Pool.new(12, points_per_batch=10, pinned_depth=1, upload_limit=3)
    for _ in range(120):
        added = [{"chunk_id": f"k{rng.randint(0, 25)}", "depth": rng.randint(0, 3), "num_points": rng.randint(1, 40 if rng.random() < 0.9 else 200)} for _ in range(rng.randint(0, 4))]
        removed = [f"k{rng.randint(0, 25)}" for _ in range(rng.randint(0, 3))]
        state = residency.StatePool(handle)
        pool = state.pool(12, points_per_batch=10, pinned_depth=1, upload_limit=3)
        pool.apply(added, removed)
        state.save(pool)
        plain.apply(added, removed)
        assert pool.telemetry("c") == plain.telemetry("c") and pool.changed == plain.changed
    assert not {p for p in handle.tables["queue"] if p[0] < pool.pending.at}
    assert sum(len(v[0]) for v in handle.tables["where"].values()) == len(handle.tables["queue"]) == len(plain.pending)


def test_a_tick_writes_what_it_changes():
    handle, writes = Maps(), []
    for tick in range(60):
        state = residency.StatePool(handle)
        pool = state.pool(100_000, upload_limit=50)
        pool.apply([{"chunk_id": f"c{tick}-{k}", "depth": 0, "num_points": 300} for k in range(20)], [f"c{tick - 1}-0"] if tick else [])
        state.save(pool)
        writes.append(state.writes)
    assert len(pool.resident) == 60 * 20 - 59 and max(writes[1:]) - min(writes[1:]) <= 3 and max(writes) < 200


def chunk_points(spark, rng, chunks):
    rows = [(c, k, 100 * i + j, *(rng.uniform(-0.5, 0.5) for _ in range(3)), rng.randrange(1 << 24)) for i, (c, k, n) in enumerate(chunks) for j in range(n)]
    return spark.createDataFrame(rows, "cloud_id string, chunk_id string, point_id bigint, x double, y double, z double, rgba bigint"), rows


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    rng = random.Random(3)
    chunks = [(c, f"k{k}", rng.randint(1, 30)) for c in "ab" for k in range(6)]
    points, rows = chunk_points(spark, rng, chunks)
    size = {(c, k): n for c, k, n in chunks}
    ticks = [[("add", c, f"k{k}") for c in "ab" for k in range(4)], [("remove", "a", "k1"), ("add", "a", "k5"), ("remove", "b", "k0")], [("add", "a", "k1"), ("remove", "a", "k2"), ("add", "b", "k4")]]
    records = [(c, 10 * t + i, op, k, 0, size[c, k], t) for t, tick in enumerate(ticks) for i, (op, c, k) in enumerate(tick)]
    log = residency.replay_changes(spark.createDataFrame(records, residency.DELTA + ", tick int"), 40, points_per_batch=PER)
    held = resident.ResidentCloud(spark, f"file://{tmp_path_factory.mktemp('resident')}/cloud", PER)
    placed = resident.parts(points, PER)
    versions = [held.commit(log.where(F.col("tick") == t + 1), placed) for t in range(3)]
    there, want = set(), []
    for tick in ticks:
        for op, c, k in tick:
            (there.add if op == "add" else there.discard)((c, k))
        want.append(sorted(r[2] for r in rows if (r[0], r[1]) in there))
    return held, versions, want


def ids(df):
    return sorted(r.point_id for r in df.select("point_id").collect())


def test_versions_keep_their_points(cloud):
    held, versions, want = cloud
    assert [ids(held.points(v)) for v in versions] == want and ids(held.points()) == want[-1]
    rows = held.points().collect()
    assert len({(r.cloud_id, r.src_idx) for r in rows}) == len(rows)
    slots = {(r.cloud_id, r.slot): r.num_points for r in held.slots().collect()}
    for r in held.batches().collect():
        assert slots.pop((r.cloud_id, r.batch_id)) == r.num_points and r.first_point == r.batch_id * PER
    assert not slots


def test_dirty_runs_are_the_slots_that_changed(cloud):
    held, versions, _ = cloud
    for a, b in ((0, 1), (1, 2), (0, 2)):
        at = [{(r.cloud_id, r.slot): (r.chunk_id, r.part, r.generation) for r in held.slots(v).collect()} for v in (versions[a], versions[b])]
        changed = {k for k in at[0].keys() | at[1].keys() if at[0].get(k) != at[1].get(k)}
        runs = held.dirty(versions[a], versions[b]).collect()
        told = [(r.cloud_id, s) for r in runs for s in range(r.first_slot, r.first_slot + r.slots)]
        assert len(told) == len(set(told)) and changed <= set(told)
        assert all((r.cloud_id, r.first_slot + r.slots) not in told for r in runs)


def test_drawing_a_resident_cloud(cloud):
    held, _, want = cloud
    config, camera = RasterConfig(width=32, height=32), standard_camera()
    image = raster.nearest_winners(raster.project(held.points().where("cloud_id = 'a'"), camera, config), config, camera)
    assert image.count() and set(r.src_idx for r in image.collect()) <= {r.src_idx for r in held.points().collect()}


def test_compaction_and_vacuum(spark, cloud):
    held, versions, want = cloud
    pinned = held.points(versions[1])
    compacted = held.compact()
    assert ids(held.points(compacted)) == want[-1] and ids(pinned) == want[1]
    assert len(held.versions.read(compacted)["points"]) == 1
    assert held.versions.vacuum(keep_from=versions[1]) == 0  # the versions that are kept name all of them
    assert ids(held.points(versions[1])) == want[1] and versions[0] not in held.versions.all
    assert held.versions.vacuum(keep_from=compacted) == 6
    assert held.versions.all == [compacted] and ids(held.points()) == want[-1]


def test_manifests(spark, tmp_path):
    a, b = (Versions(spark, f"file://{tmp_path}/m") for _ in range(2))
    assert a.latest is None and a.read() == {}
    first = a.commit({"x": [1]}, None)
    with pytest.raises(Conflict):
        b.commit({"x": [2]}, None)
    assert b.read() == {"x": [1]} and b.commit({"x": [3]}, first) == first + 1
    # A writer that died after its claim leaves a number that is passed over.
    (tmp_path / "m" / "versions" / f"{first + 2}.claim").touch()
    assert a.read() == {"x": [3]} and a.commit({"x": [4]}, first + 1) == first + 3 and b.latest == first + 3
    assert a.table([], "k long").count() == 0


def test_log_from_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(9)
    rows = [("c", i, rng.choice(["add", "add", "remove"]), f"k{rng.randint(0, 9)}", 0, rng.randint(1, 30)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], residency.DELTA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    points, _ = chunk_points(spark, rng, [("c", f"k{k}", 30) for k in range(10)])
    placed = resident.parts(points, PER)
    held = resident.ResidentCloud(spark, f"file://{tmp_path}/cloud", PER)
    stream = spark.readStream.schema(residency.DELTA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = residency.follow_changes(stream, 12, points_per_batch=PER).writeStream.foreachBatch(lambda df, k: held.commit(df, placed, k) and None)
    query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    ticked = spark.createDataFrame([(*r, i // 10) for i, r in enumerate(rows)], residency.DELTA + ", tick int")
    want = resident.latest(residency.replay_changes(ticked, 12, points_per_batch=PER))
    assert sorted(map(tuple, held.slots().collect())) == sorted(map(tuple, want.collect())) and held.slots().count()
    last = held.versions.latest
    assert held.commit(want, placed, 3) == last  # a micro-batch that comes again


def test_runs_for_chunks():
    pool = residency.Pool.new(10, points_per_batch=10, runs=True)
    pool.apply([{"chunk_id": n, "depth": 0, "num_points": 30} for n in "abc"], [])
    pool.apply([{"chunk_id": "d", "depth": 0, "num_points": 40}], ["b"])  # no run of four is left
    assert pool.resident["a"]["slots"] == [0, 1, 2] and pool.resident["c"]["slots"] == [6, 7, 8] and sorted(pool.resident["d"]["slots"]) == [3, 4, 5, 9]
    pool.apply([{"chunk_id": "e", "depth": 0, "num_points": 25}], ["d", "a"])
    assert pool.resident["e"]["slots"] == [0, 1, 2] and pool.free.runs == [(3, 6), (9, 10)]


def test_a_version_writes_no_points_that_it_does_not_show(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["add", "add", "remove"]), f"k{rng.randint(0, 9)}", 0, 25, i // 5) for i in range(200) for c in ("a", "b", None)]
    records = spark.createDataFrame(rows, residency.DELTA + ", tick int")
    for runs in (False, True):
        told = residency.replay_changes(records, 40, points_per_batch=PER, runs=runs)
        last = residency.replay_last_changes(records, 40, points_per_batch=PER, runs=runs)
        by_slot, want = {}, {}
        for r in sorted(told.collect(), key=lambda r: r.tick):
            want[r.cloud_id, r.slot] = r
        for r in last.collect():
            assert (r.cloud_id, r.slot) not in by_slot
            by_slot[r.cloud_id, r.slot] = r
        assert by_slot == want and {r.state for r in want.values()} == {0, 1}
    points, _ = chunk_points(spark, rng, [(c, f"k{k}", 25) for c in "ab" for k in range(10)])
    placed = resident.parts(points, PER)
    held = [resident.ResidentCloud(spark, f"file://{tmp_path}/{n}", PER) for n in "xy"]
    for cloud, log in zip(held, (told, last), strict=True):
        cloud.commit(log, placed)
    # All placements of the history are in the first log, but the points only of those that are left.
    shown = sorted(map(tuple, held[0].points().collect()))
    assert shown and shown == sorted(map(tuple, held[1].points().collect()))
    for cloud in held:
        assert cloud.versions.table(cloud.versions.read()["points"], resident.PLACED).count() == len(shown)
