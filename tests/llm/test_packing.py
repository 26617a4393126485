import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloudweave.llm import packing


def best_fill(counts, capacity):
    """Largest sum of a multiset that holds the largest length once."""
    first = max(counts)
    sums = {0}
    for n, c in counts.items():
        c -= n == first
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= capacity - first}
    return first + max(sums)


def test_fill_is_the_closest_multiset():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(5, 60)
        counts = {rng.randint(1, capacity): rng.randint(1, 5) for _ in range(rng.randint(1, 6))}
        chosen = packing.fill(counts, capacity)
        assert all(0 < m <= counts[n] for n, m in chosen)
        assert sum(n * m for n, m in chosen) == best_fill(counts, capacity)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts = {n: rng.choice([1, 3, 1000, 10**7]) for n in rng.sample(range(1, 4096), 300)}
    used = defaultdict(int)
    for repeats, chosen in packing.plan(counts, 4096):
        assert repeats > 0 and sum(n * m for n, m in chosen) <= 4096
        for n, m in chosen:
            used[n] += repeats * m
    assert dict(used) == counts


def test_packs_all_ids(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "Straße, naïve. don't <|endoftext|> İ,"] + ["copy of one text"] * 40
    texts += [" ".join(rng.choice("alpha Beta, gamma. δ #1".split()) for _ in range(rng.randint(0, 90))) for _ in range(150)] + ["word " * 6000]
    rows = [(i if i % 30 else None, t, 1) for i, t in enumerate(texts)] + [(5, "repeat", 1), (5, "repeat", 1)]
    path = public_tokenizers.path(packing.TOKENIZER)
    window = 64
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), path, window).collect()
    reference = Tokenizer.from_file(path)
    want = defaultdict(int)
    for d, t, _ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), window):
            part = np.array(ids[at : at + window], "<u4").tobytes()
            want[d, at, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    have, windows = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        windows[r.sequence_id].append((r.offset, r.length))
    assert have == want
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert len(windows) <= 1 + sum(r.length for r in got) / window * 1.03
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


@pytest.mark.parametrize("cell_rows, all_cells", [(1000, 1 << 20), (3, 1 << 20), (3, 9)])
def test_cells_of_any_size_place_every_piece(spark, cell_rows, all_cells):
    rng = random.Random(4)
    lengths = [7] * 300 + [64] * 80 + [rng.randint(1, 64) for _ in range(300)]
    rows = spark.createDataFrame([(i // 2, i, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long")
    got = packing.place(rows, 64, cell_rows, all_cells).collect()
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.start for r in got) == list(range(len(lengths))) and sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 64
    used = sum(repeats for repeats, _ in packing.plan({n: lengths.count(n) for n in set(lengths)}, 64))
    assert len(windows) == used


def test_cells_of_null_ids_and_of_one_repeated_row(spark, monkeypatch):
    path, seen = public_tokenizers.path(packing.TOKENIZER), []
    for rows in ([(None, f"text {i}") for i in range(300)], [(5, "one row")] * 300):
        pieces = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).cache()
        assert pieces.select("_row").distinct().count() == pieces.count() == 300
        got = packing.place(pieces, 64, cell_rows=10)
        assert "_row" not in got.columns and len({(r.sequence_id, r.offset) for r in got.collect()}) == 300
        n = got._jdf.queryExecution().analyzed().toString()
        seen.append("_cell" in n)
        lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
        spread = packing.F.pmod(packing.F.xxhash64("doc_id", "start", "_row"), packing.F.lit(max(1, max(lengths.values()) // 10)))
        assert max(r["count"] for r in pieces.groupBy("length", spread.alias("c")).count().collect()) < 40
    assert all(seen)
