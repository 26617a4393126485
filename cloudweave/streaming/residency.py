"""Streaming residency: a pool of slots that follows a stream of chunk additions and removals.

The state of a pool is keyed by cloud: which chunk holds which slots, the free slots, and a queue of chunks that wait.
Each micro-batch is one tick: removals free slots (and drop waiting chunks), additions are queued, and queued chunks are
placed in order until the upload limit, a full pool, or the end of the queue. Batch and stream share `Pool`, which keeps
its tables in memory, or in maps of Spark's state, of which a tick writes only the entries that it changes.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.operators.tables import ranked_within
from cloudweave.streaming.slots import FreeSlots, Run

UPLOAD_LIMIT = 32
#: Share of a new sample in the running decode rate, and the shortest time that makes a sample, in seconds.
RATE_SHARE, LEAST_SAMPLE = 0.2, 0.05

DELTA = "cloud_id string, seq bigint, op string, chunk_id string, depth int, num_points int"
TELEMETRY = (
    "cloud_id string, tick bigint, resident_chunks bigint, resident_batches bigint, resident_points bigint, pinned_chunks bigint, pending_chunks bigint, "
    "uploaded_chunks bigint, evicted_chunks bigint, dropped_chunks bigint, starved_ticks bigint, free_slots bigint, blocked_on_full_pool boolean, "
    "generation bigint, last_error string, resident string, slots string"
)


class Queue:
    """Chunks that wait, in order. Each has a place, and a name knows its places, so dropping chunks looks at no others."""

    def __init__(self, chunks: Iterable[dict] = ()) -> None:
        self._at: dict[int, dict] = {}
        self._places: dict[str, deque[int]] = {}
        self._front = self._behind = 0
        self.extend_(chunks)

    def __len__(self) -> int:
        return len(self._at)

    def __iter__(self) -> Iterator[dict]:
        return iter(self._at.values())

    def __eq__(self, other) -> bool:
        return list(self) == list(other) if isinstance(other, (Queue, list)) else NotImplemented

    def extend_(self, chunks: Iterable[dict]) -> None:
        for c in chunks:
            self._at[self._behind] = c
            self._places.setdefault(c["chunk_id"], deque()).append(self._behind)
            self._behind += 1

    def first(self) -> dict | None:
        if not self._at:
            return None
        while self._front not in self._at:
            self._front += 1
        return self._at[self._front]

    def done(self) -> None:
        """Takes the first one out."""
        name = self.first()["chunk_id"]
        del self._at[self._front]
        self._places[name].popleft()
        if not self._places[name]:
            del self._places[name]

    def drop(self, gone: set[str]) -> int:
        """Takes out the chunks of these names, wherever they are; how many there were."""
        before = len(self._at)
        for name in gone:
            for place in self._places.pop(name, ()):
                del self._at[place]
        return before - len(self._at)


@dataclass
class Pool:
    """Slots of points_per_batch points. The free list is last in, first out, with slot 0 first."""

    capacity: int
    points_per_batch: int = 256
    pinned_depth: int = -1
    upload_limit: int = UPLOAD_LIMIT
    free: list[int] = field(default_factory=list)
    resident: dict[str, dict] = field(default_factory=dict)
    pending: Queue | list[dict] = field(default_factory=list)
    tick: int = 0
    uploaded: int = 0
    evicted: int = 0
    dropped: int = 0
    starved: int = 0
    blocked: bool = False
    generation: int = 0
    last_error: str | None = None
    points: int = 0
    slots_held: int = 0
    pinned: int = 0
    #: What the last tick did, in order: a chunk, or None where one went, its slots and its points.
    changes: list[tuple[str | None, Sequence[int], int]] = field(default_factory=list, compare=False)
    _texts: dict[str, str] | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        if type(self.pending) is list:
            self.pending = Queue(self.pending)

    @classmethod
    def new(cls, capacity: int, runs: bool = False, **options) -> Pool:
        """An empty pool. runs: chunks lie in slots that are together, where there are such."""
        return cls(capacity, free=FreeSlots(capacity) if runs else list(range(capacity - 1, -1, -1)), **options)

    @classmethod
    def from_json(cls, text: str) -> Pool:
        return cls(**json.loads(text))

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k not in ("changes", "_texts")}, default=list)

    @property
    def changed(self) -> dict[int, dict]:
        """Slots that the last tick changed, with what they hold now."""
        out = {}
        for name, slots, left in self.changes:
            for part, slot in enumerate(slots):
                if name is None:
                    out[slot] = {"chunk_id": None, "part": None, "num_points": 0, "state": 0}
                else:
                    out[slot] = {"chunk_id": name, "part": part, "num_points": min(left - part * self.points_per_batch, self.points_per_batch), "state": 1}
        return out

    def _needed(self, num_points: int) -> int:
        return max(1, -(-num_points // self.points_per_batch))

    def add_batches(self, num_points: int) -> Sequence[int]:
        if isinstance(self.free, FreeSlots) and (first := self.free.reserve(self._needed(num_points))) is not None:
            return Run(first, first + self._needed(num_points))
        return [self.free.pop() for _ in range(self._needed(num_points))]

    def place(self, chunk: dict) -> None:
        """Gives a chunk its slots; there must be enough."""
        name, slots = chunk["chunk_id"], self.add_batches(chunk["num_points"])
        self.resident[name] = {"slots": slots, "num_points": chunk["num_points"], "depth": chunk["depth"]}
        self.changes.append((name, slots, chunk["num_points"]))
        self._texts = None
        self.points += chunk["num_points"]
        self.slots_held += len(slots)
        self.pinned += chunk["depth"] <= self.pinned_depth

    def remove(self, chunk_id: str) -> bool:
        """Frees a resident chunk's slots; removing what isn't there changes nothing."""
        found = self.resident.pop(chunk_id, None)
        if found is None:
            return False
        if isinstance(self.free, FreeSlots):
            self.free.release(found["slots"])
        else:
            for slot in found["slots"]:
                self.free.append(slot)
        self.changes.append((None, found["slots"], 0))
        self._texts = None
        self.points -= found["num_points"]
        self.slots_held -= len(found["slots"])
        self.pinned -= found["depth"] <= self.pinned_depth
        return True

    def clear(self) -> None:
        for chunk_id in list(self.resident):
            self.remove(chunk_id)
        self.generation += 1

    def replace(self, chunks: list[dict]) -> None:
        """The whole content anew: the pool keeps its identity, its generation goes up."""
        self.clear()
        self.pending = Queue()
        emptied = self.changes
        self.apply(chunks, [])
        self.changes = emptied + self.changes

    def apply(self, added: list[dict], removed: list[str]) -> None:
        """One tick: evict, queue, upload, commit."""
        self.tick += 1
        self.changes = []
        dirty = False
        for chunk_id in removed:
            if self.remove(chunk_id):
                self.evicted += 1
                dirty = True
        if removed:
            self.dropped += self.pending.drop(set(removed))
        self.pending.extend_(added)
        self.blocked = False
        placed = 0
        while placed < self.upload_limit and (chunk := self.pending.first()) is not None:
            if chunk["chunk_id"] not in self.resident:
                need = self._needed(chunk["num_points"])
                if need > self.capacity:
                    self.last_error = f"chunk {chunk['chunk_id']} needs {need} slots of {self.capacity}"
                    self.dropped += 1
                elif len(self.free) < need:
                    self.starved += 1
                    self.blocked = True
                    break
                else:
                    self.place(chunk)
                    self.uploaded += 1
                    placed += 1
                    dirty = True
            self.pending.done()
        self.generation += dirty

    def batches(self) -> list[dict]:
        """Slot records of resident chunks: where each batch begins and how many points it has."""
        out = []
        for chunk_id, c in self.resident.items():
            left = c["num_points"]
            for slot in c["slots"]:
                out.append({"chunk_id": chunk_id, "slot": slot, "first_point": slot * self.points_per_batch, "num_points": min(left, self.points_per_batch), "state": 1})
                left -= self.points_per_batch
        return out

    def telemetry(self, cloud_id: str) -> dict:
        if self._texts is None:  # they stay as long as nothing comes or goes
            self._texts = {"resident": ",".join(sorted(self.resident)), "slots": json.dumps(self.batches())}
        return {
            "cloud_id": cloud_id, "tick": self.tick, "resident_chunks": len(self.resident), "resident_batches": self.slots_held,
            "resident_points": self.points, "pinned_chunks": self.pinned,
            "pending_chunks": len(self.pending), "uploaded_chunks": self.uploaded, "evicted_chunks": self.evicted, "dropped_chunks": self.dropped, "starved_ticks": self.starved,
            "free_slots": len(self.free), "blocked_on_full_pool": self.blocked, "generation": self.generation, "last_error": self.last_error, **self._texts,
        }


def settle_state(settled: bool, pending: int, blocked: bool, budget_limited: bool) -> str:
    """streaming until the source has settled and nothing more can be placed; then full, or what held it back."""
    if not settled or (pending and not blocked):
        return "streaming"
    if not (budget_limited or blocked):
        return "settled(full)"
    return f"settled(clamped(byBudget={str(budget_limited).lower()}, byPool={str(blocked).lower()}))"


def settle_column(settled, pending, blocked, budget_limited):
    """settle_state of columns."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    clamped = F.concat(F.lit("settled(clamped(byBudget="), flag(budget_limited), F.lit(", byPool="), flag(blocked), F.lit("))"))
    return F.when(~settled | ((pending > 0) & ~blocked), "streaming").when(~budget_limited & ~blocked, "settled(full)").otherwise(clamped)


def decode_rate(old: float | None, points: int, seconds: float) -> float | None:
    """The running points a second; samples that are too short leave it."""
    if seconds < LEAST_SAMPLE:
        return old
    now = points / seconds
    return now if old is None else (1 - RATE_SHARE) * old + RATE_SHARE * now


def decode_rates(samples: DataFrame, key: str, order: str) -> DataFrame:
    """key, decode_rate: what decode_rate comes to after all samples (key, order, points, seconds) of a key, in order.

    A sample's share of the running rate depends on how many come after it, so rates are sums over ranked rows and no
    key's samples are gone through one after another. Keys whose samples are all too short have a null rate.
    """
    long_enough = F.col("seconds") >= LEAST_SAMPLE
    rows = samples.withColumn("_rate", F.when(long_enough, F.col("points") / F.col("seconds")))
    # Samples that don't count come first, as nulls, then the others in order.
    of_key = {"_n": F.count("*"), "_known": F.count("_rate")}
    placed = ranked_within(rows, key, [F.col("_rate").isNotNull(), order], "_place", ["_rate"], of_key)
    first = F.col("_place") == F.col("_n") - F.col("_known")
    share = F.pow(F.lit(1 - RATE_SHARE), F.col("_n") - 1 - F.col("_place")) * F.when(first, 1.0).otherwise(RATE_SHARE)
    return placed.groupBy(key).agg(F.sum(F.col("_rate") * share).alias("decode_rate"))


#: What a pool keeps in its state besides its tables: its own numbers, and the sizes of the tables.
HEAD = (
    "tick bigint, uploaded bigint, evicted bigint, dropped bigint, starved bigint, blocked boolean, generation bigint, last_error string, points bigint, slots_held bigint, "
    "pinned bigint, chunks bigint, placed bigint, height int, first bigint, behind bigint, waiting bigint"
)
HEAD_NAMES = [c.split()[0] for c in HEAD.split(", ")]


class StatePool:
    """A pool whose tables are maps of Spark's state, so a tick reads and writes what it touches, whatever the pool holds.

    resident: chunk to slots, points, depth and its place in the order of placing. stack: the places of free slots that
    differ from the first order. queue: place to chunk; where: a waiting chunk's places. Places of chunks that are done or
    dropped are deleted, and the queue's beginning moves past them, once.
    """

    def __init__(self, handle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.resident = handle.getMapState("resident", "chunk_id string", "slots array<int>, num_points int, depth int, placed bigint")
        self.stack = handle.getMapState("stack", "place int", "slot int")
        self.queue = handle.getMapState("queue", "place bigint", "chunk_id string, depth int, num_points int")
        self.where = handle.getMapState("where", "chunk_id string", "places array<bigint>")
        self.writes = 0

    def pool(self, capacity: int, **options) -> Pool:
        head = dict(zip(HEAD_NAMES, self.head.get(), strict=True)) if self.head.exists() else {n: 0 for n in HEAD_NAMES} | {"height": capacity, "last_error": None, "blocked": False}
        own = {n: head[n] for n in ("tick", "uploaded", "evicted", "dropped", "starved", "blocked", "generation", "last_error", "points", "slots_held", "pinned")}
        return Pool(capacity, free=_Stack(self, capacity, head["height"]), resident=_Resident(self, head["chunks"], head["placed"]), pending=_Waiting(self, head["first"], head["behind"], head["waiting"]), **own, **options)

    def save(self, pool: Pool) -> None:
        sizes = {"chunks": pool.resident.chunks, "placed": pool.resident.placed, "height": pool.free.height, "first": pool.pending.at, "behind": pool.pending.behind, "waiting": pool.pending.waiting}
        self.head.update(tuple((vars(pool) | sizes)[n] for n in HEAD_NAMES))
        self.writes += 1

    def put(self, table, key: tuple, value: tuple) -> None:
        table.updateValue(key, value)
        self.writes += 1

    def drop(self, table, key: tuple) -> None:
        table.removeKey(key)
        self.writes += 1


class _Stack:
    """Free slots; a place that was never written holds the slot that was there at first."""

    def __init__(self, state: StatePool, capacity: int, height: int) -> None:
        self.state, self.capacity, self.height = state, capacity, height

    def __len__(self) -> int:
        return self.height

    def pop(self) -> int:
        self.height -= 1
        found = self.state.stack.getValue((self.height,)) if self.state.stack.containsKey((self.height,)) else None
        return found[0] if found else self.capacity - 1 - self.height

    def append(self, slot: int) -> None:
        self.state.put(self.state.stack, (self.height,), (slot,))
        self.height += 1


class _Resident:
    def __init__(self, state: StatePool, chunks: int, placed: int) -> None:
        self.state, self.chunks, self.placed = state, chunks, placed

    def __len__(self) -> int:
        return self.chunks

    def __contains__(self, chunk_id: str) -> bool:
        return self.state.resident.containsKey((chunk_id,))

    def __setitem__(self, chunk_id: str, chunk: dict) -> None:
        self.placed += 1
        self.chunks += 1
        self.state.put(self.state.resident, (chunk_id,), (chunk["slots"], chunk["num_points"], chunk["depth"], self.placed))

    def pop(self, chunk_id: str, default=None):
        if chunk_id not in self:
            return default
        slots, num_points, depth, _ = self.state.resident.getValue((chunk_id,))
        self.state.drop(self.state.resident, (chunk_id,))
        self.chunks -= 1
        return {"slots": list(slots), "num_points": num_points, "depth": depth}

    def items(self) -> list[tuple[str, dict]]:
        """All chunks in the order in which they were placed; read for a full telling, never written."""
        rows = sorted(((v[3], k[0], v) for k, v in self.state.resident.iterator()), key=lambda r: r[0])
        return [(name, {"slots": list(v[0]), "num_points": v[1], "depth": v[2]}) for _, name, v in rows]

    def __iter__(self):
        return iter([name for name, _ in self.items()])


class _Waiting:
    def __init__(self, state: StatePool, at: int, behind: int, waiting: int) -> None:
        self.state, self.at, self.behind, self.waiting = state, at, behind, waiting

    def __len__(self) -> int:
        return self.waiting

    def _places(self, chunk_id: str) -> list[int]:
        return list(self.state.where.getValue((chunk_id,))[0]) if self.state.where.containsKey((chunk_id,)) else []

    def extend_(self, chunks: list[dict]) -> None:
        for c in chunks:
            self.state.put(self.state.queue, (self.behind,), (c["chunk_id"], c["depth"], c["num_points"]))
            self.state.put(self.state.where, (c["chunk_id"],), ([*self._places(c["chunk_id"]), self.behind],))
            self.behind += 1
            self.waiting += 1

    def first(self) -> dict | None:
        if not self.waiting:
            return None
        while not self.state.queue.containsKey((self.at,)):
            self.at += 1
        chunk_id, depth, num_points = self.state.queue.getValue((self.at,))
        return {"chunk_id": chunk_id, "depth": depth, "num_points": num_points}

    def done(self) -> None:
        name = self.first()["chunk_id"]
        rest = [p for p in self._places(name) if p != self.at]
        self.state.drop(self.state.queue, (self.at,))
        if rest:
            self.state.put(self.state.where, (name,), (rest,))
        else:
            self.state.drop(self.state.where, (name,))
        self.at += 1
        self.waiting -= 1

    def drop(self, gone: set[str]) -> int:
        dropped = 0
        for name in gone:
            places = self._places(name)
            for p in places:
                self.state.drop(self.state.queue, (p,))
            if places:
                self.state.drop(self.state.where, (name,))
            dropped += len(places)
        self.waiting -= dropped
        return dropped


CHANGES = "cloud_id string, tick bigint, generation bigint, slot int, chunk_id string, part int, num_points int, state int"
CHANGE_NAMES = [c.split()[0] for c in CHANGES.split(", ")]


def _changes_of(pool: Pool, cloud: str | None) -> pd.DataFrame:
    return pd.DataFrame([{"cloud_id": cloud, "tick": pool.tick, "generation": pool.generation, "slot": s} | c for s, c in sorted(pool.changed.items())], columns=CHANGE_NAMES).astype({"chunk_id": object, "part": "Int32"})


def _follower(capacity: int, options: dict, tell):
    """A stateful processor that applies each micro-batch as a tick and yields what tell(pool, cloud) makes of it."""
    from pyspark.sql.streaming import StatefulProcessor

    class Follow(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = StatePool(handle)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            pool = self.state.pool(capacity, **options)
            added, removed = [], []
            for part in rows:
                records = _records(part)
                added += records[0]
                removed += records[1]
            pool.apply(*_in_order(added, removed))
            self.state.save(pool)
            yield tell(pool, key[0])

        def close(self) -> None:
            pass

    return Follow()


#: All that is told of a pool at a time.
SNAPSHOT = (
    "cloud_id string, tick bigint, state string, pool_capacity int, free_slots int, resident_chunks bigint, resident_points bigint, pinned_chunks bigint, pending_chunks bigint, "
    "decode_in_flight bigint, decode_pending bigint, decoded_points_per_second double, uploaded_chunks bigint, evicted_chunks bigint, dropped_chunks bigint, starved_ticks bigint, last_error string"
)
SNAPSHOT_NAMES = [c.split()[0] for c in SNAPSHOT.split(", ")]
#: How long a pool with waiting chunks waits for records before it has a tick without any, in milliseconds.
IDLE_MS = 200


class Clock:
    """The decode rate by the clock: when it was sampled last, the points since, and the rate."""

    def __init__(self, sampled: int | None = None, points: int = 0, rate: float | None = None) -> None:
        self.sampled, self.points, self.rate = sampled, points, rate

    def add(self, points: int, now: int) -> None:
        """Points that were decoded until now (milliseconds); the first call begins the first sample."""
        if self.sampled is None:
            self.sampled = now
            return
        self.points += points
        seconds = (now - self.sampled) / 1000
        if seconds >= LEAST_SAMPLE:
            self.rate = decode_rate(self.rate, self.points, seconds)
            self.sampled, self.points = now, 0


def follow_snapshots(deltas: DataFrame, capacity: int, idle_ms: int = IDLE_MS, **options) -> DataFrame:
    """A SNAPSHOT of each cloud's pool after each micro-batch, and after each tick that a timer makes.

    deltas: DELTA records, with any of in_flight, decode_pending (of the source), settled, budget_limited (of the camera's
    wanted chunks). Rates are by the processing time of micro-batches. A pool with waiting chunks that could be placed
    goes on without new records: a timer gives it a tick every idle_ms.
    """
    from pyspark.sql.streaming import StatefulProcessor

    more = [c for c in ("in_flight", "decode_pending", "settled", "budget_limited") if c in deltas.columns]

    class Snapshots(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.state = handle, StatePool(handle)
            self.clock = handle.getValueState("clock", "sampled bigint, points bigint, rate double")
            self.told = handle.getValueState("told", "in_flight bigint, decode_pending bigint, settled boolean, budget_limited boolean")

        def _tick(self, key, added: list, removed: list, points: int, told: tuple, now: int) -> pd.DataFrame:
            pool = self.state.pool(capacity, **options)
            pool.apply(added, removed)
            self.state.save(pool)
            clock = Clock(*self.clock.get()) if self.clock.exists() else Clock()
            clock.add(points, now)
            self.clock.update((clock.sampled, clock.points, clock.rate))
            for timer in list(self.handle.listTimers()):
                at = timer[0] if isinstance(timer, tuple) else timer
                if at > now:  # one that has expired goes by itself
                    self.handle.deleteTimer(at)
            if len(pool.pending) and not pool.blocked:
                self.handle.registerTimer(now + idle_ms)
            in_flight, decode_pending, settled, limited = told
            row = {
                "cloud_id": key[0], "tick": pool.tick, "state": settle_state(settled, len(pool.pending) + decode_pending, pool.blocked, limited), "pool_capacity": capacity, "free_slots": len(pool.free),
                "resident_chunks": len(pool.resident), "resident_points": pool.points, "pinned_chunks": pool.pinned, "pending_chunks": len(pool.pending), "decode_in_flight": in_flight, "decode_pending": decode_pending,
                "decoded_points_per_second": clock.rate or 0.0, "uploaded_chunks": pool.uploaded, "evicted_chunks": pool.evicted, "dropped_chunks": pool.dropped, "starved_ticks": pool.starved, "last_error": pool.last_error,
            }
            return pd.DataFrame([row], columns=SNAPSHOT_NAMES)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            added, removed, last = [], [], {}
            for part in rows:
                records = _records(part)
                added += records[0]
                removed += records[1]
                last |= {c: part[c].max() for c in more if part[c].notna().any()}
            told = (int(last.get("in_flight", 0)), int(last.get("decode_pending", 0)), bool(last.get("settled", True)), bool(last.get("budget_limited", False)))
            self.told.update(told)
            yield self._tick(key, *_in_order(added, removed), sum(c["num_points"] for _, c in added), told, timer_values.getCurrentProcessingTimeInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            told = tuple(self.told.get()) if self.told.exists() else (0, 0, True, False)
            yield self._tick(key, [], [], 0, told, timerValues.getCurrentProcessingTimeInMs())

        def close(self) -> None:
            pass

    return deltas.groupBy("cloud_id").transformWithStateInPandas(Snapshots(), outputStructType=SNAPSHOT, outputMode="Append", timeMode="ProcessingTime")


def _records(rows: pd.DataFrame) -> tuple[list, list]:
    """(seq, record) of additions and (seq, chunk) of removals."""
    added = [(r.seq, {"chunk_id": r.chunk_id, "depth": int(r.depth), "num_points": int(r.num_points)}) for r in rows[rows["op"] == "add"].itertuples()]
    gone = rows[rows["op"] == "remove"]
    return added, list(zip(gone["seq"].tolist(), gone["chunk_id"].tolist(), strict=True))


def _in_order(added: list, removed: list) -> tuple[list[dict], list[str]]:
    by_seq = lambda r: r[0]
    return [c for _, c in sorted(added, key=by_seq)], [c for _, c in sorted(removed, key=by_seq)]


def follow(deltas: DataFrame, capacity: int, **options) -> DataFrame:
    """Telemetry of each cloud's pool after each micro-batch of a stream of DELTA records.

    A pool's slots are one sequence of decisions, so a cloud is one key; clouds are independent of each other. What a
    tick writes to the state grows with its records; telling all slots reads the whole pool (see follow_changes).
    """
    tell = lambda pool, cloud: pd.DataFrame([pool.telemetry(cloud)])
    return deltas.groupBy("cloud_id").transformWithStateInPandas(_follower(capacity, options, tell), outputStructType=TELEMETRY, outputMode="Append", timeMode="None")


def follow_changes(deltas: DataFrame, capacity: int, **options) -> DataFrame:
    """The slots that each micro-batch changes, with what they hold now: the log of a resident cloud (CHANGES)."""
    return deltas.groupBy("cloud_id").transformWithStateInPandas(_follower(capacity, options, _changes_of), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def _ticks(batches: Iterator[pd.DataFrame], tick: str) -> Iterator[tuple]:
    """(cloud_id, its ticks as (added, removed)) of sorted batches, wherever they are cut; ticks are read as they are asked for."""

    def parted(records) -> tuple[list[dict], list[str]]:
        added, removed = [], []
        for _, _, op, chunk_id, depth, num_points in records:
            if op == "add":
                added.append({"chunk_id": chunk_id, "depth": int(depth), "num_points": int(num_points)})
            elif op == "remove":
                removed.append(chunk_id)
        return added, removed

    columns = ("cloud_id", tick, "op", "chunk_id", "depth", "num_points")
    records = (r for rows in batches for r in zip(*(rows[c].tolist() for c in columns), strict=True))
    for cloud, own in groupby(records, key=lambda r: None if r[0] != r[0] else r[0]):
        yield cloud, (parted(part) for _, part in groupby(own, key=itemgetter(1)))


#: Rows, and characters of their texts, that a worker hands on at a time, about.
TOLD_ROWS, TOLD_TEXT = 1000, 1 << 22


def _frames(rows: Iterator[dict], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of a bounded size."""
    held, text = [], 0
    for row in rows:
        held.append(row)
        text += sum(len(v) for v in row.values() if type(v) is str)
        if len(held) >= TOLD_ROWS or text >= TOLD_TEXT:
            yield pd.DataFrame(held, columns=names)
            held, text = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _at_each_tick(pool: Pool, ticks: Iterator[tuple]) -> Iterator[Pool]:
    for added, removed in ticks:
        pool.apply(added, removed)
        yield pool


def replay(deltas: DataFrame, capacity: int, tick: str = "tick", **options) -> DataFrame:
    """What `follow` would tell of a table of records with a tick column: one row for each cloud and tick.

    A cloud's records come to one worker, but sorted by Spark and a batch at a time: it holds one tick of them, and the
    pool, however long the history. Records without a tick are passed by.
    """
    names = [c.split()[0] for c in TELEMETRY.split(", ")]

    def tell(pool: Pool, cloud: str | None, ticks: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        return _frames((p.telemetry(cloud) for p in _at_each_tick(pool, ticks)), names)

    return _replayed(deltas, capacity, tick, options, TELEMETRY, tell)


def replay_changes(deltas: DataFrame, capacity: int, tick: str = "tick", **options) -> DataFrame:
    """As replay, of what follow_changes would tell: the slots that each tick changes."""

    def tell(pool: Pool, cloud: str | None, ticks: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        return (_changes_of(p, cloud) for p in _at_each_tick(pool, ticks) if p.changes)

    return _replayed(deltas, capacity, tick, options, CHANGES, tell)


def replay_last_changes(deltas: DataFrame, capacity: int, tick: str = "tick", **options) -> DataFrame:
    """Of what replay_changes tells, the last row of each slot: all that a version after all records needs.

    It has a row for each slot that was ever used, however often chunks came and went.
    """
    return _replayed(deltas, capacity, tick, options, CHANGES, _last_changes)


def _last_changes(pool: Pool, cloud: str | None, ticks: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    at, since = np.zeros(pool.capacity, np.int64), np.zeros(pool.capacity, np.int64)  # ticks and generations count from 1
    for p in _at_each_tick(pool, ticks):
        for _, slots, _ in p.changes:
            own = slice(slots.first, slots.end) if isinstance(slots, Run) else slots
            at[own], since[own] = p.tick, p.generation

    def rows(slots: np.ndarray, chunk_id: str | None, part, num_points, state: int) -> pd.DataFrame:
        values = (cloud, at[slots], since[slots], slots, chunk_id, part, num_points, state)
        return pd.DataFrame(dict(zip(CHANGE_NAMES, values, strict=True))).astype({"cloud_id": object, "chunk_id": object, "part": "Int32"})

    for name, c in pool.resident.items():
        slots, part = np.array(c["slots"], np.int32), np.arange(len(c["slots"]), dtype=np.int32)
        yield rows(slots, name, part, np.minimum(c["num_points"] - part.astype(np.int64) * pool.points_per_batch, pool.points_per_batch), 1)
        at[slots] = 0
    emptied = np.flatnonzero(at).astype(np.int32)
    for k in range(0, len(emptied), 100 * TOLD_ROWS):
        yield rows(emptied[k : k + 100 * TOLD_ROWS], None, None, 0, 0)


def _replayed(deltas: DataFrame, capacity: int, tick: str, options: dict, schema: str, tell) -> DataFrame:
    """What tell(pool, cloud, ticks) gives of each cloud's new pool."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cloud, ticks in _ticks(batches, tick):
            yield from tell(Pool.new(capacity, **options), cloud, ticks)

    known = deltas.where(F.col(tick).isNotNull())
    # By ranges, as hashes of a few clouds meet; each that has its share of the records gets a task of its own.
    tasks = 4 * deltas.sparkSession.sparkContext.defaultParallelism
    return known.repartitionByRange(tasks, "cloud_id").sortWithinPartitions("cloud_id", tick, "seq").mapInPandas(run, schema)


SLOTS = "array<struct<chunk_id: string, slot: int, first_point: bigint, num_points: int, state: int>>"


def resident_batches(told: DataFrame) -> DataFrame:
    """The resident batches of each cloud (and the generation they are of) by its latest telemetry.

    Queries join points to them by slot; a pool has at most capacity rows here. In a stream's foreachBatch this is the
    table to publish.
    """
    last = told.groupBy("cloud_id").agg(F.max_by(F.struct("generation", "slots"), "tick").alias("last"))
    return last.select("cloud_id", "last.generation", F.inline(F.from_json("last.slots", SLOTS)))


def latest_residents(deltas: DataFrame) -> DataFrame:
    """The chunks that are there after all records, if the pool is large enough: those whose last record adds them."""
    return deltas.groupBy("cloud_id", "chunk_id").agg(F.max_by(F.struct("op", "depth", "num_points"), "seq").alias("last")).where("last.op = 'add'").select("cloud_id", "chunk_id", "last.depth", "last.num_points")


def merged_views(views: list[DataFrame]) -> DataFrame:
    """The greatest score that any camera gives a node, from (node, score) of each."""
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out.groupBy("node").agg(F.max("score").alias("score"))


def pixel_scale(height: int, projection: tuple[float, ...]) -> float:
    """Pixels of a unit at distance one."""
    return height / 2 * projection[5]


def split_budget(total_bytes: int, streams: int) -> list[int]:
    """A byte budget in equal parts."""
    return [total_bytes // max(1, streams)] * streams
