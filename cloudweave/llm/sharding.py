"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (rows of equal texts) are ordered by the hash of their text and cut into contiguous shards; the largest shard's
bytes are as few as any such cuts allow. The driver binary-searches that capacity, checking each greedily, on bucket
sums of the hash order. Where a cut might fall inside a bucket, the bucket is split further, level by level, until the
smallest feasible capacity is exact. A level brings at most a few thousand buckets' sums to the driver, whatever the
number of groups.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import table, written
from cloudweave.operators.tables import pinned

SHARDS = 24
#: Bits of the hash order that the first level and each further level part.
FIRST_BITS, MORE_BITS = 12, 5
KEY_BITS = 64
OVERHEAD = 8
#: Rows of a shard are numbered side by side in cells of about CELL_ROWS, or in larger ones where that would make over
#: ALL_CELLS of them, as their counts are broadcast.
CELL_ROWS, ALL_CELLS = 100, 1 << 18
#: Buckets whose sums one job brings to the driver.
AT_ONCE = 4096


@dataclass(frozen=True)
class Bucket:
    """Groups whose key lies in [low, high): their bytes, and whether they are one group."""

    low: int
    high: int
    size: int
    atomic: bool


def greedy(starts: list[int], buckets: list[Bucket], capacity: int, most: int, hopeful: bool) -> list[int] | None:
    """Cuts (bytes before each) of at most `most` shards of at most `capacity`, or None.

    Cuts are made at bucket ends; a hopeful check makes them anywhere in a bucket of many groups. So what is feasible
    without hope is feasible, and what isn't even with hope isn't. starts: bytes before each bucket, then the total.
    """
    at, cuts = 0, []
    while at < starts[-1]:
        if len(cuts) == most:
            return None
        reach = at + capacity
        k = bisect.bisect_right(starts, reach) - 1  # starts[k] <= reach
        end = starts[k]
        if hopeful and k < len(buckets) and not buckets[k].atomic:
            end = reach
        if end <= at:
            return None
        at = end
        cuts.append(at)
    return cuts


def smallest(starts: list[int], buckets: list[Bucket], most: int, hopeful: bool) -> int:
    """The least capacity that greedy() finds feasible."""
    low, high = -(-starts[-1] // most), starts[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(starts, buckets, mid, most, hopeful) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _open(starts: list[int], buckets: list[Bucket], low: int, high: int, most: int) -> list[int]:
    """Buckets of many groups in which a cut of a capacity in [low, high] might fall."""
    found, least, top = set(), 0, 0
    for _ in range(most):
        # The j-th cut is not before what the lowest capacity surely reaches, nor after what the highest might.
        k = bisect.bisect_right(starts, least + low) - 1
        least = starts[min(k, len(starts) - 1)]
        top = min(top + high, starts[-1])
        i, j = bisect.bisect_right(starts, least) - 1, bisect.bisect_left(starts, top)
        found.update(x for x in range(max(i, 0), min(j, len(buckets))) if not buckets[x].atomic)
    return sorted(found)


def cut_keys(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], int]:
    """The least key of each shard but the first, and the capacity, for groups (key, size).

    key is a long whose signed order is the groups' order; keys may repeat, and equal keys are one group.
    """

    whole = Bucket(-(1 << (KEY_BITS - 1)), 1 << (KEY_BITS - 1), 0, False)
    buckets = sorted(_split(groups, [whole], FIRST_BITS), key=lambda b: b.low)
    while True:
        starts = [0]
        for b in buckets:
            starts.append(starts[-1] + b.size)
        if not buckets:
            return [], 0
        high = smallest(starts, buckets, shards, hopeful=False)
        low = smallest(starts, buckets, shards, hopeful=True)
        wanted = _open(starts, buckets, low, high, shards) if low < high else []
        if not wanted:
            return [buckets[k].low for k in even_cuts(starts, high, shards)], high
        buckets = sorted([b for i, b in enumerate(buckets) if i not in set(wanted)] + _split(groups, [buckets[i] for i in wanted], MORE_BITS), key=lambda b: b.low)


def even_cuts(starts: list[int], capacity: int, most: int) -> list[int]:
    """Where to cut within the capacity: of the feasible places, each time the one nearest to an even share.

    A place is feasible if the shard before it holds no more than the capacity, and the rest fits the shards left.
    """
    total = starts[-1]
    earliest = [total]
    for _ in range(most - 1):
        earliest.append(starts[bisect.bisect_left(starts, earliest[-1] - capacity)] if earliest[-1] > capacity else 0)
    cuts, at = [], 0
    for j in range(1, most):
        low = bisect.bisect_left(starts, earliest[most - j])
        high = bisect.bisect_right(starts, at + capacity) - 1
        k = bisect.bisect_left(starts, j * total / most)
        k = min((x for x in (k - 1, k) if 0 <= x < len(starts)), key=lambda x: abs(starts[x] - j * total / most))
        k = min(max(k, low), high)
        if starts[k] > at and k < len(starts) - 1:
            cuts.append(k)
            at = starts[k]
    return cuts


def _split(groups: DataFrame, which: list[Bucket], bits: int) -> list[Bucket]:
    """The buckets in parts of some further bits of the key; all that are split together have one width."""
    out = []
    for width in sorted({b.high - b.low for b in which}):
        same = [b for b in which if b.high - b.low == width]
        step = max(0, width.bit_length() - 1 - bits)
        for lo in range(0, len(same), AT_ONCE):
            part = same[lo : lo + AT_ONCE]
            top = width.bit_length() - 1
            wanted = F.shiftright("key", top).isin([b.low >> top for b in part]) if top < KEY_BITS else F.lit(True)
            between = (F.col("key") >= part[0].low) & (F.col("key") <= part[-1].high - 1)
            rows = groups.where(between & wanted).groupBy(F.shiftright("key", step).alias("cell"))
            for r in rows.agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last")).collect():
                out.append(Bucket(r["cell"] << step, (r["cell"] + 1) << step, r["size"], r["first"] == r["last"]))
    return out


def text_key(text: Column) -> Column:
    """Rows of equal texts have one key; a null text is a group of its own."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", cell_rows: int = CELL_ROWS, all_cells: int = ALL_CELLS) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard.

    A null text has no bytes and the empty text's crc. Rows of equal texts share a shard. Repeated rows get a slot
    each, a null doc_id is kept, an empty table gives no rows; columns of docs with a result's name are replaced. A
    group larger than total/shards makes its shard as large as the group, and no larger.
    """
    names = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_key", "_cell")
    body = F.col(text).cast("string")
    keyed = docs.drop(*(c for c in docs.columns if c in names and c != text)).withColumns(
        {"size": F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + OVERHEAD, "text_crc32": F.crc32(F.coalesce(body, F.lit("")).cast("binary")), "_key": text_key(body)}
    )
    groups = written(keyed.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "groups", sort_by="key")
    keys, _ = cut_keys(groups, shards)

    def shard(key: str) -> Column:
        return (F.size(F.filter(F.lit(keys), lambda k: k <= F.col(key))) if keys else F.lit(0)).cast("int")

    # One number for each shard comes to the driver; a shard of many small texts has many cells.
    held = {r["shard"]: r["n"] for r in groups.groupBy(shard("key").alias("shard")).agg(F.sum("rows").alias("n")).collect()}
    each = max(cell_rows, -(-sum(held.values()) // all_cells))
    cells = F.element_at(F.lit([max(1, -(-held.get(k, 0) // each)) for k in range(shards)]), F.col("shard") + 1)
    # Pinned, as Spark would else spell them out in filters it infers from the join of slotted(), where text is gone.
    at_shard = pinned(keyed.withColumn("law", F.lit("bytes")), {"shard": shard("_key")})
    placed = pinned(at_shard, {"_cell": F.pmod(F.xxhash64("doc_id", "text_crc32"), cells).cast("int")}).drop("_key")
    return slotted(placed).withColumn("grown_shard", F.lit(None).cast("int"))


def slotted(placed: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, to rows with shard, _cell and doc_id.

    Rows are numbered in (shard, cell), and each cell begins after the cells before it. The counts of a shard's
    cells are summed up by one small window.
    """
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "_cell", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("doc_id"))
    # At most ALL_CELLS + shards rows are broadcast.
    return placed.withColumn("slot", own).join(F.broadcast(offsets), ["shard", "_cell"]).withColumn("slot", (F.col("slot") - 1 + F.col("_before")).cast("long")).drop("_cell", "_before")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharded(docs).drop("text")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
