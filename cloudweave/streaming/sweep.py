"""Amortised selection: whole batches within a budget of points each frame, published only when a sweep is complete."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.model import RasterConfig
from cloudweave.operators.tables import dropped, written
from cloudweave.operators.versions import Versions


@dataclass(frozen=True)
class Chunk:
    first: int
    count: int
    starts: bool
    completes: bool


class EvenSizes(Sequence):
    """Points of batches that are all of one size but one, by their numbers; nothing is listed."""

    def __init__(self, points: int, per_batch: int, short_at: int | None = None) -> None:
        self.count = -(-points // per_batch)
        self.per_batch, self.short = per_batch, points - (self.count - 1) * per_batch
        self.short_at = self.count - 1 if short_at is None else short_at

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.count:
            raise IndexError(k)
        return self.short if k == self.short_at else self.per_batch


def plan_chunk(sizes: Sequence[int], cursor: int, budget: int, has_front: bool) -> Chunk:
    """Batches from the cursor on until the budget is reached; the one that crosses it is the last.

    Without a budget, or before the first complete sweep, all that are left.
    """
    if budget <= 0 or not has_front:
        end = len(sizes)
    else:
        end, total = cursor, 0
        while end < len(sizes) and (end == cursor or total < budget):
            total += sizes[end]
            end += 1
    return Chunk(cursor, end - cursor, cursor == 0, end >= len(sizes))


def chunk_table(batches: DataFrame, budget: int) -> DataFrame:
    """new_id, chunk of batches (new_id, num_points of equal size but one) under a budget, in one expression.

    With p points in a batch a chunk takes ceil(budget / p) batches: it stops after the one that reaches the budget.
    """
    per = batches.agg(F.max("num_points").alias("p")).first()["p"] or 1
    take = max(1, -(-budget // per)) if budget > 0 else None
    chunk = F.floor(F.col("new_id") / F.lit(take)) if take else F.lit(0)
    return batches.select("new_id", "num_points", chunk.cast("bigint").alias("chunk"))


def running_chunks(batches: DataFrame, budget: int) -> DataFrame:
    """The batches of the first chunk of batches of any sizes: those before which fewer points than the budget lie."""
    before = F.coalesce(F.sum("num_points").over(Window.partitionBy("sweep").orderBy("new_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return batches.withColumn("_before", before).where(F.col("_before") < budget).drop("_before")


@dataclass
class SweepDriver:
    """Selects a cloud's batches chunk by chunk into a back set; the front set is always one complete sweep.

    select(batch_ids): the selection of those batches. A change of the settings that advance is told restarts the sweep;
    a replaced cloud starts with a full one.
    """

    sizes: list[int]
    select: Callable[[int, int], DataFrame]
    budget: int = 0
    cursor: int = 0
    back: list[DataFrame] = field(default_factory=list)
    front: DataFrame | None = None
    sweeps: int = 0
    settings: tuple | None = None

    @property
    def progress(self) -> float:
        return self.cursor / len(self.sizes) if self.sizes else 1.0

    def restart(self) -> None:
        self.cursor, self.back = 0, []

    def replace(self, sizes: list[int], select: Callable[[int, int], DataFrame]) -> None:
        self.sizes, self.select, self.front = sizes, select, None
        self.restart()

    def advance(self, config: RasterConfig | None = None) -> bool:
        """One frame; whether it published a new front set. Other levels of detail than in the last frame restart the sweep."""
        if config:
            now = (config.enable_clod, config.lod_bias, config.enable_lod_dither)
            if self.settings not in (None, now):
                self.restart()
            self.settings = now
        if not self.sizes:
            return False
        chunk = plan_chunk(self.sizes, self.cursor, self.budget, self.front is not None)
        self.back.append(written(self.select(chunk.first, chunk.first + chunk.count), "sweep"))
        self.cursor += chunk.count
        if not chunk.completes:
            return False
        out = self.back[0]
        for part in self.back[1:]:
            out = out.unionByName(part)
        self.front = out
        self.sweeps += 1
        self.restart()
        return True


def _settings(config: RasterConfig) -> list:
    """What a sweep is bound to: other levels of detail make its finished part worthless."""
    return [config.enable_clod, config.lod_bias, config.enable_lod_dither]


class DurableSweep:
    """A sweep whose progress and front set are versions of a shared folder, so both outlive the driver.

    A frame writes the selection of its chunk as a table, then commits a version that names it: behind the others of the
    back set, or, when the sweep is complete, as the last of the front set. What a driver that is killed in between has
    written is never named. Another driver on the same folder goes on with the sweep, and readers see the former front
    set until a whole sweep is there. `key` tells which content is swept (a cloud's generation): another one starts
    again, with a full sweep.
    """

    def __init__(self, versions: Versions, sizes: Sequence[int], select: Callable[[int, int], DataFrame], budget: int = 0, key: str = "") -> None:
        self.versions, self.sizes, self.select, self.budget, self.key = versions, sizes, select, budget, key

    @property
    def state(self) -> dict:
        found = self.versions.read()
        return found if found.get("key") == self.key else {"key": self.key, "cursor": 0, "back": [], "front": None, "sweeps": 0, "settings": None, "schema": None}

    @property
    def progress(self) -> float:
        return self.state["cursor"] / len(self.sizes) if len(self.sizes) else 1.0

    @property
    def front(self) -> DataFrame | None:
        """The last complete sweep's selection."""
        now = self.state
        return None if now["front"] is None else self.versions.table(now["front"], now["schema"])

    def advance(self, config: RasterConfig | None = None) -> bool:
        """One frame; whether it published a new front set."""
        if not len(self.sizes):
            return False
        last, now = self.versions.latest, self.state
        settings = _settings(config) if config else now["settings"]
        if now["settings"] not in (None, settings):
            now |= {"cursor": 0, "back": []}
        chunk = plan_chunk(self.sizes, now["cursor"], self.budget, now["front"] is not None)
        part = self.select(chunk.first, chunk.first + chunk.count)
        now |= {"back": [*now["back"], self.versions.write(part)], "cursor": now["cursor"] + chunk.count, "settings": settings, "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema)}
        if chunk.completes:
            now |= {"front": now["back"], "back": [], "cursor": 0, "sweeps": now["sweeps"] + 1}
        self.versions.commit(now, last)
        return chunk.completes

    def tidy(self) -> int:
        """Deletes what the last version doesn't name: former front sets (whose readers must be done), killed frames."""
        return self.versions.vacuum(self.versions.latest or 0)


class SelectCache:
    """Selections by cloud and camera, its generation, and all that a selection depends on. Point size and colours don't count.

    The least recently used ones go when there are more than `most`, and their tables with them, unless they are held:
    then as soon as the last holder lets go. A selection that is read later than `most` others are made must be held.
    """

    def __init__(self, most: int = 64) -> None:
        self.most = most
        self._kept: OrderedDict[tuple, tuple[tuple, DataFrame, str | None]] = OrderedDict()
        self._held: dict[int, int] = {}
        self._leaving: dict[int, tuple[DataFrame, str]] = {}
        self.ran = self.skipped = self.evicted = 0

    def __len__(self) -> int:
        return len(self._kept)

    def get(self, cloud: str, generation: int, camera, config, model, make: Callable) -> DataFrame:
        """The kept selection, or make()'s: a DataFrame, or one with the path of its table."""
        key = (generation, camera, model, config.size, config.enable_frustum_culling, config.lod_bias, config.enable_clod, config.enable_lod_dither)
        slot = (cloud, camera)
        found = self._kept.get(slot)
        if found and found[0] == key:
            self.skipped += 1
            self._kept.move_to_end(slot)
            return found[1]
        self.ran += 1
        made = make()
        out, path = made if isinstance(made, tuple) else (made, None)
        if found:
            self._gone(self._kept.pop(slot))
        self._kept[slot] = (key, out, path)
        while len(self._kept) > self.most:
            self._gone(self._kept.popitem(last=False)[1])
        return out

    def forget(self, cloud: str) -> None:
        """Lets go all selections of a cloud."""
        for slot in [s for s in self._kept if s[0] == cloud]:
            self._gone(self._kept.pop(slot))

    @contextmanager
    def held(self, selection: DataFrame) -> Iterator[DataFrame]:
        """Keeps a selection's table until the block is left, whatever becomes of its entry."""
        k = id(selection)
        self._held[k] = self._held.get(k, 0) + 1
        try:
            yield selection
        finally:
            self._held[k] -= 1
            if not self._held[k]:
                del self._held[k]
                if k in self._leaving:
                    self._delete(*self._leaving.pop(k))

    def _gone(self, entry: tuple) -> None:
        _, out, path = entry
        self.evicted += 1
        if path is None:
            return
        if id(out) in self._held:
            self._leaving[id(out)] = (out, path)
        else:
            self._delete(out, path)

    def _delete(self, out: DataFrame, path: str) -> None:
        dropped(out.sparkSession, path)
