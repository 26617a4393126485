"""Packing of token sequences into windows by minimum bin slack.

Texts are cut into full windows, which need no packing, and one remaining piece each. The lengths of the remaining
pieces form a histogram of at most window-1 entries whatever the size of the corpus, so only that comes to the driver.
There a bitset subset-sum programme over the histogram picks the multiset of lengths that fills a window closest to its
capacity; the multiset is used as often as the counts allow (so each choice exhausts a length), and the choices are
repeated until no piece is left. A piece finds its window from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.llm.common import map_arrow, table, written
from cloudweave.llm.word_ids import encoder_of

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Pieces of one length are ranked in cells of about CELL_ROWS, so that no length is ranked by one task, or in larger ones
#: (all alike) where that would make over ALL_CELLS of them, so that the driver gets no more than about as many counts.
CELL_ROWS, ALL_CELLS = 1_000, 1 << 20

#: _row numbers the pieces of a run.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _row long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The (length, times) of the multiset from `counts` that leaves the least slack in `capacity`.

    The largest length is always taken once, so every call makes progress. Lengths enter in falling order; a length
    that may be taken m times enters as binary multiples, and the reachable sums after each are kept for backtracking.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True)
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in lengths:
        left = min(counts[n] - (n == first), room // n if n else 0)
        step = 1
        while left > 0:
            take = min(step, left)
            trail.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {first: 1}
    for n, take, before in reversed(trail):
        if not before >> total & 1:
            total -= n * take
            used[n] = used.get(n, 0) + take
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, multiset) until every piece is in a window."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        chosen = fill(left, capacity)
        repeats = min(left[n] // m for n, m in chosen)
        for n, m in chosen:
            left[n] -= repeats * m
            if not left[n]:
                del left[n]
        out.append((repeats, chosen))
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Cuts each text's ids (and end_id) into full windows and one rest: doc_id, start, length, ids_crc32, doc_tokens, _row."""

    def make():
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        number = count(TaskContext.get().partitionId() << 40)

        def step(batch: pa.RecordBatch) -> dict:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(texts), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n, next(number)) for at in range(0, n, window)]
            return dict(zip(_PIECES.names, map(list, zip(*rows, strict=True)), strict=True))

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, PIECES, _PIECES)


def place(pieces_df: DataFrame, window: int = WINDOW, cell_rows: int = CELL_ROWS, all_cells: int = ALL_CELLS) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, start and length (1 to window).

    A piece of `window` tokens is a sequence by itself. Ranks are taken within (length, cell) and carried on over the
    cells of a length, so a length or document that holds much of the corpus is spread over many tasks. The table of
    cell counts and the plan have at most all_cells + window and a few times window rows.
    """
    sizes = {r["length"]: r["n"] for r in pieces_df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = max(cell_rows, -(-sum(sizes.values()) // all_cells))
    spread = F.lit([max(1, -(-sizes.get(n, 0) // rows)) for n in range(window + 1)])
    # A document's id may be null in all rows, and rows may repeat, so the number of the written piece counts too.
    own = [c for c in ("doc_id", "start", "_row") if c in pieces_df.columns]
    cell = F.pmod(F.xxhash64(*own), F.element_at(spread, (F.col("length") + 1).cast("int"))).cast("int")
    celled = pieces_df.withColumn("_cell", cell)
    counts = celled.groupBy("length", "_cell").agg(F.count("*").alias("n")).orderBy("length", "_cell").toPandas()
    totals = counts.groupby("length")["n"].sum()
    full = int(totals.get(window, 0))
    before = counts.groupby("length")["n"].cumsum() - counts["n"]

    # Runs of ranks: the pieces of a length whose rank is from `rank` on go to windows from `seq` on, `times` in each.
    runs, seq = [(window, 0, 0, 1, 0)] if full else [], full
    taken: dict[int, int] = {}
    for repeats, chosen in plan({int(n): int(c) for n, c in totals.items() if n != window}, window):
        at = 0
        for n, m in chosen:
            runs.append((n, taken.get(n, 0), seq, m, at))
            taken[n] = taken.get(n, 0) + repeats * m
            at += n * m
        seq += repeats
    run = np.array(sorted(runs), np.int64).reshape(-1, 5)
    cell_key = counts["length"].to_numpy(np.int64) << 32 | counts["_cell"].to_numpy(np.int64)
    cell_before = before.to_numpy(np.int64)
    run_key = run[:, 0] << 44 | run[:, 1]

    w = Window.partitionBy("length", "_cell").orderBy(*own)
    ranked = celled.withColumn("_rank", F.row_number().over(w).cast("long") - 1)
    fields = [f for f in pieces_df.schema.fields if f.name != "_row"]
    keep = [f.name for f in fields]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    schema = StructType(fields).add("sequence_id", LongType()).add("offset", LongType())
    arrow = to_arrow_schema(schema)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            length, c, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "_cell", "_rank"))
            rank = rank + cell_before[np.searchsorted(cell_key, length << 32 | c)]
            k = np.searchsorted(run_key, length << 44 | rank, side="right") - 1
            _, first, start, times, at = run[k].T
            return {n: batch.column(n) for n in keep} | {"sequence_id": start + (rank - first) // times, "offset": at + (rank - first) % times * length}

        return step

    return map_arrow(ranked, make, schema, arrow)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Packs the texts of docs (doc_id, text) into windows; one row for each piece.

    Null and empty texts are one piece, end_id alone. Repeated rows are packed each for itself; a null doc_id is kept.
    Other columns are not looked at. An empty table gives no rows. The pieces are written to the shared folder once, so
    texts are encoded once.
    """
    return place(written(pieces(docs, tokenizer, window, end_id), "pieces", rows=docs.count(), gather=True), window)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
