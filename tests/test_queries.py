import os

import duckdb
import pytest

from cloudweave.plans import catalog, streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = list(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("the generated tables are not here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.collect()
    assert rows and rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())


def test_every_query_has_sql_but_the_pools_telling():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"starvation"}
    assert set(streams.queries()) < set(catalog.queries())


def test_all_points_are_looked_up(spark):
    if not os.path.isdir(SF):
        pytest.skip("the generated tables are not here")
    found = catalog.queries()["point_to_batch_all"](spark, SF).collect()
    assert sorted(r.i for r in found) == list(range(spark.read.parquet(f"{SF}/lineitem.parquet").count()))
    assert len({(r.batch_id, r.local_idx) for r in found}) == len(found)


def test_all_records_are_judged(spark):
    if not os.path.isdir(SF):
        pytest.skip("the generated tables are not here")
    resident, pending, evicted = {}, {}, []
    for r in streams.deltas(spark, SF).orderBy("seq").collect():
        if r.op == "add":
            if r.chunk_id not in resident:
                pending[r.chunk_id] = r.seq
            resident[r.chunk_id] = r.num_points
        else:
            pending.pop(r.chunk_id, None)
            if r.chunk_id in resident:
                evicted.append((r.seq, r.chunk_id, resident.pop(r.chunk_id)))
    assert sorted((r.seq, r.chunk_id) for r in catalog.queries()["pending_all"](spark, SF).collect()) == sorted((s, c) for c, s in pending.items())
    assert sorted(tuple(r) for r in catalog.queries()["evicted_all"](spark, SF).select("seq", "chunk_id", "num_points").collect()) == sorted(evicted)
    assert {s % 2 for s in pending.values()} == {0, 1} == {s % 2 for s, _, _ in evicted}


def test_scans_read_only_what_they_need(spark):
    if not os.path.isdir(SF):
        pytest.skip("the generated tables are not here")
    plan = catalog.queries()["nearest_depth_image"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_quantity" in schema and "l_partkey" not in schema and "l_shipdate" not in schema
    # points are reduced by centre before they are splatted
    assert plan.index("Generate explode") < plan.rindex("HashAggregate")


def test_starvation_against_pools_kept_by_hand(spark):
    if not os.path.isdir(SF):
        pytest.skip("the generated tables are not here")
    from test_streaming import told_by_hand

    clouds = {}
    for r in streams.deltas(spark, SF).orderBy("seq").collect():
        clouds.setdefault(r.cloud_id, {}).setdefault(r.seq // 100, []).append((r.op, r.chunk_id, r.num_points))
    told = {}
    for r in catalog.queries()["starvation"](spark, SF).collect():
        told.setdefault(r.cloud_id, []).append(r)
    assert told.keys() == clouds.keys() and len(clouds) > 3
    for cloud, ticks in clouds.items():
        got = [(r.resident_chunks, r.resident_points, r.pending_chunks, r.uploaded_chunks, r.evicted_chunks, r.dropped_chunks, r.starved_ticks, r.free_slots, r.blocked_on_full_pool) for r in sorted(told[cloud], key=lambda r: r.tick)]
        assert got == [t[:9] for t in told_by_hand([ticks[k] for k in sorted(ticks)], 100, 256, 32)]
