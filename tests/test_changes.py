import json
import time

import pytest

from cloudweave.model import Cloud, RasterConfig, standard_camera
from cloudweave.operators import pack, raster, select
from cloudweave.sources import changes
from cloudweave.sources import points as src
from cloudweave.streaming import residency, telemetry


def record(k, op="add", n=10, **more):
    return {"cloud_id": "c", "seq": k, "op": op, "chunk_id": f"k{k}", "depth": 1, "num_points": n, "payload_bytes": 100 + k} | more


def write(folder, number, rows):
    draft = folder.parent / f"{number:06d}.draft"
    draft.write_text("".join(json.dumps(r) + "\n" for r in rows))
    draft.rename(folder / f"{number:06d}.json")


def drain(stream, checkpoint, **options):
    """Batches of a query until nothing is left to read."""
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, k: seen.append(sorted((r.seq for r in df.collect()))) and None).option("checkpointLocation", str(checkpoint)).start()
    query.processAllAvailable()
    query.stop()
    return [b for b in seen if b]


def test_admission_restart_and_a_change_of_budget(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        write(folder, k, [record(k)])
    size = (folder / "000000.json").stat().st_size
    stream = lambda b: changes.change_stream(spark, str(folder), max_bytes=b)
    assert drain(stream(2 * size), tmp_path / "ck") == [[0, 1], [2, 3], [4, 5]]
    for k in range(6, 10):
        write(folder, k, [record(k, extra={"a": 1})])
    write(folder, 10, [])
    (folder / changes.CONTROL).write_text(json.dumps({"max_bytes": 1, "target_size": 32}))
    assert drain(stream(10**9), tmp_path / "ck") == [[6], [7], [8], [9]]  # none is lost, none comes twice; the file's budget holds
    (folder / changes.CONTROL).write_text("{")
    write(folder, 11, [record(11)])
    write(folder, 12, [record(12)])
    assert drain(stream(10**9), tmp_path / "ck") == [[11, 12]]
    assert drain(stream(10**9), tmp_path / "other") == [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12]]


def test_records_tell_what_waits(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        write(folder, k, [record(k), record(100 + k, op="remove")])
    (folder / changes.CONTROL).write_text(json.dumps({"max_bytes": 3 * (folder / "000000.json").stat().st_size, "target_size": 32}))
    seen = []
    query = changes.change_stream(spark, f"file://{folder}", clean="delete").writeStream.foreachBatch(lambda df, k: seen.extend(df.collect()) and None).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    by_seq = {r.seq: r for r in seen}
    assert sorted(by_seq) == [0, 1, 2, 3, 100, 101, 102, 103] and len(seen) == 8
    assert (by_seq[0].in_flight, by_seq[0].decode_pending, by_seq[0].target, by_seq[0].payload_bytes) == (3, 1, 32.0, 100)
    assert (by_seq[3].in_flight, by_seq[3].decode_pending) == (1, 0)
    assert len(list(folder.glob("0*.json"))) < 4  # files before the last commit are gone


def test_reader_takes_files_again_as_before(tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.json").write_text("x" * 10)
    reader = changes.ChangeFiles({"path": str(tmp_path), "max_bytes": "25"})
    first, at = reader.read(reader.initialOffset())
    second, end = reader.read(at)
    names = lambda rows: [r[0][-6:] for r in rows]
    assert names(first) == ["0.json", "1.json"] and names(second) == ["2.json", "3.json"] and names(reader.readBetweenOffsets(at, end)) == ["2.json", "3.json"]
    third, last = reader.read(end)
    assert names(third) == ["4.json"] and reader.read(last)[1] == last and not list(reader.read(last)[0])


def test_clock():
    c = residency.Clock()
    c.add(1000, 0)
    assert c.rate is None
    c.add(10, 20)
    c.add(90, 100)
    assert c.rate == pytest.approx(1000.0) and (c.sampled, c.points) == (100, 0)
    c.add(400, 200)
    assert c.rate == pytest.approx(0.8 * 1000 + 0.2 * 4000)


def test_snapshots_go_on_without_records_and_are_observed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, 0, [record(k, n=300) for k in range(5)] + [record(50, n=99_999)])
    told = residency.follow_snapshots(changes.change_stream(spark, str(folder)), 12, idle_ms=1, points_per_batch=100, upload_limit=1)
    listener = telemetry.PoolListener()
    spark.streams.addListener(listener)
    query = telemetry.observed(told).writeStream.format("memory").queryName("snapshots").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            rows = spark.sql("select * from snapshots order by tick").collect()
            if rows and rows[-1].starved_ticks:
                break
            time.sleep(1)
        write(folder, 1, [record(0, "remove"), record(1, "remove"), record(60, n=10)])
        while time.time() < deadline and not (rows := spark.sql("select * from snapshots where evicted_chunks = 2 and pending_chunks = 0 order by tick").collect()):
            time.sleep(1)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    first = spark.sql("select * from snapshots order by tick").collect()
    # One chunk a tick, of one file of records: the others came by timers; the fifth finds no room.
    assert [(r.tick, r.resident_chunks, r.state) for r in first[:4]] == [(k, k, "streaming") for k in (1, 2, 3, 4)]
    assert first[4].state == "settled(clamped(byBudget=false, byPool=true))" and (first[4].free_slots, first[4].pool_capacity, first[4].starved_ticks) == (0, 12, 1)
    assert rows and rows[-1].last_error.startswith("chunk k50") and rows[-1].state == "settled(full)" and rows[-1].decoded_points_per_second > 0
    assert rows[-1].resident_chunks == rows[-1].uploaded_chunks - 2 and len(residency.SNAPSHOT_NAMES) == 17
    heard = listener.latest["snapshots"]
    assert heard["starved_ticks"] >= 1 and listener.ticks["snapshots"] >= 4


def test_a_drawing_query_counts_its_survivors(spark):
    cloud = pack.pack(src.cube_grid(spark, 8), pack.PackConfig(points_per_batch=64, coarse_divisions=4))
    config = RasterConfig(width=32, height=32, enable_lod_dither=False)
    chosen = telemetry.Selection(select.selected_points(cloud, standard_camera(), config), 100)
    image = raster.depth_image(raster.project(chosen.points, standard_camera(), config), config, standard_camera())
    assert image.count() and chosen.stats == {"appended": 512, "overflow": 412, "kept": 100}
    assert raster.accumulate([Cloud(chosen.points)], standard_camera(), config).count()
