import random
import zlib
from collections import Counter, defaultdict

import pytest

from cloudweave.llm import sharding


def best_capacity(sizes, most):
    """Smallest feasible capacity by trying them all."""
    low = max(max(sizes), -(-sum(sizes) // most))
    while True:
        shards, left = 1, low
        for s in sizes:
            if s > left:
                shards, left = shards + 1, low
            left -= s
        if shards <= most:
            return low
        low += 1


@pytest.mark.parametrize("most", [1, 3, 24])
def test_capacity_is_the_smallest(spark, most):
    rng = random.Random(most)
    texts = ["x" * rng.randint(0, 90) + str(rng.randint(0, 150)) for _ in range(400)] + ["hot copy " * 9] * 150 + [None, None, ""]
    docs = spark.createDataFrame([(i // 2 if i % 50 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, slot int")
    rows = sharding.sharded(docs, most).collect()
    assert len(rows) == len(texts)
    of, slots, bytes_ = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        t = r.text
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.grown_shard is None
        of[t].add(r.shard)
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(len(s) == 1 for s in of.values()) and all(0 <= s < most for s in slots)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keyed = docs.withColumn("k", sharding.text_key(sharding.F.col("text"))).collect()
    groups = Counter()
    for r in keyed:
        groups[r.k] += len((r.text or "").encode()) + 8
    assert max(bytes_.values()) == best_capacity([groups[k] for k in sorted(groups)], most)


def test_many_levels(spark):
    keys = [5, 6, 7, 8, 9, 1 << 40, (1 << 40) + 1, -3, -2, -(1 << 63), (1 << 63) - 1]
    sizes = [9, 20, 3, 14, 8, 30, 2, 11, 40, 6, 25]
    cuts, capacity = sharding.cut_keys(spark.createDataFrame(list(zip(keys, sizes)), "key long, size long"), 4)
    ordered = [s for _, s in sorted(zip(keys, sizes))]
    assert capacity == best_capacity(ordered, 4)
    parts = Counter()
    for k, s in zip(keys, sizes):
        parts[sum(c <= k for c in cuts)] += s
    assert max(parts.values()) == capacity and len(parts) == 4


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cell_rows, all_cells", [(1, 1 << 18), (1, 10), (1000, 1 << 18)])
def test_slots_have_no_gaps_whatever_the_cells(spark, tmp_path, cell_rows, all_cells):
    texts = ["" if i % 3 else f"text {i}" for i in range(600)] + ["long " * 200_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    slots = defaultdict(list)
    for r in sharding.sharded(docs, 5, cell_rows=cell_rows, all_cells=all_cells).select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(texts) and max(map(len, slots.values())) >= 400
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_on_a_table(spark, tmp_path):
    texts = [None, "", "a", "a", "Straße"] * 30
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.op8_sharding(spark, str(tmp_path)).collect()}
    assert got == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
