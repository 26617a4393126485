"""Queries of residency, sweeps, history and sources, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.model import Cloud, multiply
from cloudweave.operators import pack, raster, select
from cloudweave.operators.tables import quantiles, shared_folder, written
from cloudweave.operators.versions import Versions
from cloudweave.plans import sql as q
from cloudweave.sources import ply
from cloudweave.sources import points as src
from cloudweave.streaming import residency, resident, sweep

BUDGET = 3000


def deltas(spark, sf_dir):
    """Events as change records: a user is a chunk of one of 16 clouds, an error removes it, another event adds it."""
    e = src.load(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("cloud-"), F.col("user_id") % 16).alias("cloud_id"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"),
        F.col("user_id").cast("string").alias("chunk_id"),
        (F.col("user_id") % 5).cast("int").alias("depth"),
        (F.col("event_id") % 700 + 1).cast("int").alias("num_points"),
    )


_DELTA = "del AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, user_id::VARCHAR AS chunk_id, user_id % 5 AS depth, event_id % 700 + 1 AS num_points FROM events)"
_LAST = "lst_ AS (SELECT chunk_id, arg_max(op, seq) AS op, arg_max(depth, seq) AS depth, arg_max(num_points, seq) AS num_points FROM del {where} GROUP BY chunk_id)"

_BEFORE = "bef AS (SELECT d.seq, d.chunk_id, d.op, arg_max(g.op, g.seq) AS former, arg_max(g.num_points, g.seq) AS points FROM del d LEFT JOIN del g ON g.chunk_id = d.chunk_id AND g.seq < d.seq GROUP BY d.seq, d.chunk_id, d.op)"


def pool_apply_delta(spark, sf_dir):
    return residency.latest_residents(deltas(spark, sf_dir)).select("chunk_id", "depth", "num_points")


def pinned_counts(spark, sf_dir):
    r = residency.latest_residents(deltas(spark, sf_dir))
    return r.agg(F.count("*").alias("chunks"), F.sum("num_points").alias("points"), F.count_if(F.col("depth") <= 1).alias("pinned"))


def _former(d, column):
    return F.lag(column).over(Window.partitionBy("chunk_id").orderBy("seq"))


def pending_all(spark, sf_dir):
    """Records that would still be placed: additions whose chunk is neither resident before them nor removed later."""
    d = deltas(spark, sf_dir)
    gone = F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(Window.partitionBy("chunk_id"))
    judged = d.select("seq", "chunk_id", "op", _former(d, "op").alias("former"), gone.alias("gone"))
    return judged.where("op = 'add' and coalesce(former, 'remove') <> 'add' and coalesce(seq > gone, true)").select("seq", "chunk_id")


def evicted_all(spark, sf_dir):
    """Removals of chunks that are resident before them, with the points that go."""
    d = deltas(spark, sf_dir)
    judged = d.select("seq", "chunk_id", "op", _former(d, "op").alias("former"), _former(d, "num_points").alias("points"))
    return judged.where("op = 'remove' and former = 'add'").select("seq", "chunk_id", F.col("points").alias("num_points"))


#: Chunks of the resident clouds' points, clouds, points of a slot, and events of a tick.
CHUNKS, CLOUDS, SLOT_POINTS, TICK = 256, 16, 64, 100


def resident_cloud(spark, sf_dir) -> resident.ResidentCloud:
    """Line items, in chunks by supplier, that come and go with the events of users of the same numbers."""
    points = src.numbered_lineitem_points(spark, sf_dir, chunk=F.col("l_suppkey") % CHUNKS)
    named = points.select(F.concat(F.lit("cloud-"), F.col("chunk") % CLOUDS).alias("cloud_id"), F.col("chunk").cast("string").alias("chunk_id"), "point_id", "x", "y", "z", "rgba")
    placed = resident.parts(named, SLOT_POINTS)
    # A row for each of CHUNKS; used twice.
    sizes = written(placed.groupBy("cloud_id", "chunk_id").agg(F.count("*").cast("int").alias("num_points")), "sizes")
    e = src.load(spark, sf_dir, "events").select((F.col("user_id") % CHUNKS).cast("string").alias("chunk_id"), F.col("event_id").cast("bigint").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"))
    records = e.join(F.broadcast(sizes), "chunk_id").select("cloud_id", "seq", "op", "chunk_id", F.lit(0).alias("depth"), "num_points", F.floor(F.col("seq") / TICK).alias("tick"))  # CHUNKS rows
    # Room for all chunks, so that none has to wait: each may leave one slot not full.
    total = sizes.agg(F.sum("num_points").alias("n")).first()["n"] or 0
    log = residency.replay_last_changes(records, total // SLOT_POINTS + CHUNKS, runs=True, points_per_batch=SLOT_POINTS, upload_limit=CHUNKS)
    held = resident.ResidentCloud(spark, f"{shared_folder(spark)}/cloudweave/resident-{uuid.uuid4().hex}", SLOT_POINTS)
    held.commit(log, placed)
    return held


def resident_cloud_image(spark, sf_dir):
    """What is resident after all events, drawn."""
    from cloudweave.plans.catalog import CAMERA, IMAGE

    return raster.accumulate([Cloud(resident_cloud(spark, sf_dir).points())], CAMERA, IMAGE)


def resident_slots(spark, sf_dir):
    """Slots and points that each cloud holds after all events."""
    return resident_cloud(spark, sf_dir).slots().groupBy("cloud_id").agg(F.count("*").alias("slots"), F.sum("num_points").alias("points"), F.count_distinct("chunk_id").alias("chunks"))


_RESIDENT = f"""evt AS (SELECT user_id % {CHUNKS} AS chunk, event_id // {TICK} AS tick, event_type <> 'error' AS added FROM events),
res AS (SELECT chunk FROM evt GROUP BY chunk HAVING max(tick) = max(tick) FILTER (added)),
cnk AS (SELECT * FROM lineitem WHERE l_suppkey % {CHUNKS} IN (SELECT chunk FROM res))"""


def starvation(spark, sf_dir):
    """The pool's own telling of all records, a hundred a tick."""
    d = deltas(spark, sf_dir).withColumn("tick", F.floor(F.col("seq") / 100))
    return residency.replay(d, 100, points_per_batch=256, pinned_depth=1)


def settle_state(spark, sf_dir):
    """Events as moments of a stream: whether it has settled, what waits, and what holds it back."""
    e = src.load(spark, sf_dir, "events")
    flags = {"settled": F.col("event_type") != "signup", "pending": (F.col("event_id") % 3).cast("int"), "blocked": F.col("value") > 50, "budget": F.col("user_id") % 2 == 0}
    t = e.select("event_id", *(c.alias(n) for n, c in flags.items()))
    return t.withColumn("state", residency.settle_column(*(F.col(c) for c in flags)))


_SETTLE = """SELECT event_id, s AS settled, p::BIGINT AS pending, b AS blocked, c AS budget,
CASE WHEN NOT s OR (p > 0 AND NOT b) THEN 'streaming' WHEN NOT c AND NOT b THEN 'settled(full)'
ELSE 'settled(clamped(byBudget=' || c::VARCHAR || ', byPool=' || b::VARCHAR || '))' END AS state
FROM (SELECT event_id, event_type <> 'signup' AS s, event_id % 3 AS p, value > 50 AS b, user_id % 2 = 0 AS c FROM events)"""


def sweep_chunks(spark, sf_dir):
    from cloudweave.plans.catalog import packed

    return sweep.chunk_table(packed(spark, sf_dir).batches, BUDGET)


def sweep_publish(spark, sf_dir):
    """The front set after a first full sweep, and one in budgeted chunks that another driver ends."""
    from cloudweave.plans.catalog import CLOSE, IMAGE, PACK, packed

    c = packed(spark, sf_dir)
    known = c.batches.agg(F.sum("num_points").alias("n"), F.max(F.when(F.col("num_points") < PACK.points_per_batch, F.col("new_id"))).alias("short")).first()
    sizes = sweep.EvenSizes(known["n"] or 0, PACK.points_per_batch, known["short"])

    def part(first: int, stop: int):
        chosen = c.batches.where((F.col("new_id") >= first) & (F.col("new_id") < stop))
        return select.selected_points(pack.PackedCloud(c.points, chosen, c.bounds, c.config), CLOSE, IMAGE)

    folder = f"{shared_folder(spark)}/cloudweave/sweep-{uuid.uuid4().hex}"
    driver = lambda: sweep.DurableSweep(Versions(spark, folder), sizes, part, budget=max(1, (known["n"] or 0) // 2))
    first = driver()
    first.advance()
    first.advance()
    second = driver()
    while not second.advance():
        pass
    return second.front.select("src_idx", "point_id")


def running_budget(spark, sf_dir):
    """The first chunk of each supplier's line items as batches of their quantities."""
    rows = src.load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("num_points"))
    named = rows.select(F.col("l_suppkey").alias("sweep"), F.col("l_partkey").alias("new_id"), "num_points")
    return sweep.running_chunks(named, 40)


def frame_history(spark, sf_dir):
    """Each event with the former value of its user, as a frame with the former view of its camera."""
    e = src.load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"))


def view_union(spark, sf_dir):
    rows = src.load(spark, sf_dir, "lineitem")
    a = rows.select(F.col("l_partkey").alias("node"), F.col("l_quantity").cast("double").alias("score"))
    b = rows.select(F.col("l_suppkey").alias("node"), (F.col("l_tax") * 100.0).alias("score"))
    return residency.merged_views([a, b])


def timing_summary(spark, sf_dir):
    e = src.load(spark, sf_dir, "events").select("event_type", "value", "event_id")
    found = quantiles(e, "event_type", "value", ["event_id"], {"median": 0.5, "p90": 0.9})
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90")))


def decode_rates(spark, sf_dir):
    """Events as decoded chunks of a stream for each user, their values as hundredths of a second."""
    e = src.load(spark, sf_dir, "events")
    samples = e.select("user_id", "event_id", (F.col("event_id") % 700 + 1).alias("points"), (F.col("value") / 100).alias("seconds"))
    return residency.decode_rates(samples, "user_id", "event_id").select("user_id", F.round("decode_rate", 4).alias("decode_rate"))


_RATES = """WITH s AS (SELECT user_id, event_id, CASE WHEN value / 100 >= 0.05 THEN (event_id % 700 + 1) / (value / 100) END AS rate FROM events),
l AS (SELECT user_id, list(rate ORDER BY event_id) FILTER (rate IS NOT NULL) AS rates FROM s GROUP BY user_id)
SELECT user_id, round(CASE WHEN len(rates) > 0 THEN list_reduce(rates, lambda a, b: 0.8::DOUBLE * a + 0.2::DOUBLE * b) END, 4) AS decode_rate FROM l"""


def frame_matrices(spark, sf_dir):
    """Orders in clip space, by the product of projection, view and model."""
    from cloudweave.plans.catalog import CAMERA, MOVED

    m = multiply(CAMERA.projection, CAMERA.view, MOVED)
    rows = src.orders_points(spark, sf_dir)
    return rows.select("point_id", *(F.round(g.transform_row(m, k, *(F.col(a) for a in "xyz")), 9).alias(f"clip_{n}") for k, n in enumerate("xyzw")))


def ply_roundtrip(spark, sf_dir):
    """Line items as PLY files of both kinds in the shared folder, read back."""
    points, out = src.lineitem_points(spark, sf_dir), None
    for kind in ("ascii", "binary_little_endian"):
        folder = f"{shared_folder(spark)}/cloudweave/ply-{uuid.uuid4().hex}"
        files = [r["path"] for r in ply.save(points, folder, kind, rows=10_000).collect()]  # a row a file
        back = ply.load(spark, sorted(files), range_bytes=1 << 20).select(F.lit(kind).alias("kind"), "x", "y", "z", "r", "g", "b", "a")
        out = back if out is None else out.unionByName(back)
    return out


_PLY = "SELECT kind, " + ", ".join(f"{a}::REAL::DOUBLE AS {a}" for a in "xyz") + ", " + ", ".join(f"{q.channel(k)} / CAST(255 AS DOUBLE) AS {n}" for k, n in enumerate("rgb")) + ", CAST(1 AS DOUBLE) AS a FROM pts, (VALUES ('ascii'), ('binary_little_endian')) t(kind)"


def _matrix_sql(factors: dict) -> str:
    """Points times the product of column-major matrices, worked out from their cells."""
    cells = ",\n".join(f"{n} AS (SELECT k % 4 AS r, k // 4 AS c, v FROM (VALUES " + ", ".join(f"({k}, {q.d(v)})" for k, v in enumerate(m)) + ") t(k, v))" for n, m in factors.items())
    first, *rest = factors
    steps, done = [], first
    for n in rest:
        steps.append(f"{done}{n} AS (SELECT a.r, b.c, sum(a.v * b.v) AS v FROM {done} a JOIN {n} b ON a.c = b.r GROUP BY a.r, b.c)")
        done += n
    clip = ", ".join(f"round(sum(v * CASE c WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN z ELSE 1 END) FILTER (r = {k}), 9) + 0.0 AS clip_{n}" for k, n in enumerate("xyzw"))
    points = q.ORD.replace("SELECT ", "SELECT o_orderkey AS point_id, ", 1)
    return f"WITH {points}, {cells},\n" + ",\n".join(steps) + f"\nSELECT point_id, {clip} FROM pts2, {done} GROUP BY point_id"


def queries() -> dict[str, tuple[Callable, str | None]]:
    from cloudweave.plans import catalog as c

    take = -(-BUDGET // c.PACK.points_per_batch)
    pending = f"WITH {_DELTA}, {_BEFORE} SELECT seq, chunk_id FROM bef WHERE op = 'add' AND coalesce(former, 'remove') <> 'add' AND NOT EXISTS (SELECT 1 FROM del g WHERE g.op = 'remove' AND g.chunk_id = bef.chunk_id AND g.seq > bef.seq)"
    evicted = f"WITH {_DELTA}, {_BEFORE} SELECT seq, chunk_id, points AS num_points FROM bef WHERE op = 'remove' AND former = 'add'"
    return {
        "pool_apply_delta": (pool_apply_delta, f"WITH {_DELTA}, {_LAST.format(where='')} SELECT chunk_id, depth, num_points FROM lst_ WHERE op = 'add'"),
        "pinned_counts": (pinned_counts, f"WITH {_DELTA}, {_LAST.format(where='')} SELECT count(*) AS chunks, sum(num_points)::BIGINT AS points, count(*) FILTER (depth <= 1) AS pinned FROM lst_ WHERE op = 'add'"),
        "pending_antijoin": (pending_all, pending),
        "evicted_semijoin": (evicted_all, evicted),
        "pending_all": (pending_all, pending),
        "evicted_all": (evicted_all, evicted),
        "resident_cloud_image": (resident_cloud_image, c.with_(_RESIDENT, q.PTS.replace("FROM lineitem", "FROM cnk"), q.average_pixels(c.CAMERA, c.IMAGE, c.RADIUS), select=q.PIXELS)),
        "resident_slots": (resident_slots, f"WITH {_RESIDENT}, siz AS (SELECT l_suppkey % {CHUNKS} AS chunk, count(*) AS n FROM cnk GROUP BY 1) SELECT 'cloud-' || (chunk % {CLOUDS}) AS cloud_id, sum((n + {SLOT_POINTS - 1}) // {SLOT_POINTS})::BIGINT AS slots, sum(n)::BIGINT AS points, count(*) AS chunks FROM siz GROUP BY 1"),
        "starvation": (starvation, None),
        "settle_state": (settle_state, _SETTLE),
        "sweep_chunks": (sweep_chunks, "WITH " + c._PACKED + f"\nSELECT new_id::BIGINT AS new_id, num_points, (new_id // {take})::BIGINT AS chunk FROM zon"),
        "sweep_publish": (sweep_publish, "WITH " + ",\n".join(c._SELECTED) + "\nSELECT src_idx::BIGINT AS src_idx, point_id FROM sel"),
        "running_budget": (running_budget, "WITH g AS (SELECT l_suppkey AS sweep, l_partkey AS new_id, count(*) AS num_points FROM lineitem GROUP BY 1, 2) SELECT sweep, new_id, num_points FROM (SELECT *, coalesce(sum(num_points) OVER (PARTITION BY sweep ORDER BY new_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) WHERE before < 40"),
        "frame_history": (frame_history, "SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events"),
        "view_union": (view_union, "SELECT node, max(score) AS score FROM (SELECT l_partkey AS node, l_quantity::DOUBLE AS score FROM lineitem UNION ALL SELECT l_suppkey, l_tax * 100.0::DOUBLE FROM lineitem) GROUP BY node"),
        "timing_summary": (timing_summary, "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type"),
        "decode_rates": (decode_rates, _RATES),
        "frame_matrices": (frame_matrices, _matrix_sql({"p": c.CAMERA.projection, "v": c.CAMERA.view, "m": c.MOVED})),
        "ply_roundtrip": (ply_roundtrip, f"WITH {q.PTS} {_PLY}"),
    }
