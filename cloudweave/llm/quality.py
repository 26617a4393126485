"""Quality of whole texts by a small convolutional network over their bytes, in numpy.

Filters of WIDTH bytes are laid every STRIDE bytes. Their responses are max-pooled over chunks of two blocks, each chunk
overlapping the next by one block, so that the chunks cover the whole text; the mean and the largest of the chunks'
responses go through one logistic unit. A filter's response is a sum of table rows, one for the byte at each place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import held_out, labelled, map_arrow, table

FILTERS, WIDTH, STRIDE = 16, 8, 2
#: Bytes of a block; a chunk is two.
BLOCK = 512
PLACES = BLOCK // STRIDE
#: At most this many labelled texts of either label are fitted on, least crc32 of the id first.
SAMPLE = 1500
THRESHOLD = 0.3
#: Blocks that are convolved at once.
SLAB = 256


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (2 * FILTERS + 1,), the last the constant


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each with at least WIDTH zero bytes after it to full blocks; blocks of each."""
    blocks = np.array([(len(t) + WIDTH + BLOCK - 1) // BLOCK for t in texts], np.int64)
    data = b"".join(t + bytes(int(n) * BLOCK - len(t)) for t, n in zip(texts, blocks, strict=True)) + bytes(WIDTH)
    return np.frombuffer(data, np.uint8), blocks


def responses(net: Network, data: np.ndarray, first: int, count: int) -> np.ndarray:
    """Responses (count, PLACES, FILTERS) of the blocks from `first` on."""
    out = None
    for k in range(WIDTH):
        at = data[first * BLOCK + k : (first + count) * BLOCK + k : STRIDE]
        rows = net.filters[k].take(at, axis=0)
        out = rows if out is None else np.add(out, rows, out=out)
    return out.reshape(count, PLACES, FILTERS)


def _inside(blocks: np.ndarray) -> np.ndarray:
    """The last block of each text: its last places would look into the next text and are left out."""
    return np.cumsum(blocks) - 1


def pooled(net: Network, data: np.ndarray, blocks: np.ndarray, want_places: bool = False):
    """Largest response of each filter in each block, and where it is."""
    total = int(blocks.sum())
    top, place = np.empty((total, FILTERS), np.float32), np.zeros((total, FILTERS), np.int64) if want_places else None
    last = np.zeros(total, bool)
    last[_inside(blocks)] = True
    over = (WIDTH - 1 + STRIDE - 1) // STRIDE
    for lo in range(0, total, SLAB):
        n = min(SLAB, total - lo)
        r = responses(net, data, lo, n)
        r[last[lo : lo + n], PLACES - over :] = -np.inf
        if want_places:
            place[lo : lo + n] = r.argmax(axis=1)
            top[lo : lo + n] = np.take_along_axis(r, place[lo : lo + n, None, :], 1)[:, 0]
        else:
            r.max(axis=1, out=top[lo : lo + n])
    return top, place


def chunked(top: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responses of chunks (a block and the next of its text), which of the two they are from, and chunks of each text."""
    ends = np.cumsum(blocks)
    last = np.zeros(len(top), bool)
    last[ends - 1] = True
    after = np.concatenate([top[1:], top[-1:]])
    second = (after > top) & ~last[:, None]
    # A text of several blocks has a chunk less than blocks; a text of one block is one chunk.
    keep = ~last | np.repeat(blocks == 1, blocks)
    return np.where(second, after, top)[keep], second[keep], np.maximum(blocks - 1, 1)


def forward(net: Network, chunks: np.ndarray, counts: np.ndarray):
    """Scores, and what the fit needs: features, rectified chunks and the chunk that has each text's largest."""
    on = np.maximum(chunks + net.bias, 0)
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(on, starts, axis=0) / counts[:, None]
    most = np.maximum.reduceat(on, starts, axis=0)
    x = np.concatenate([mean, most, np.ones((len(counts), 1), on.dtype)], axis=1)
    z = np.clip(x @ net.dense, -30, 30)
    return 1 / (1 + np.exp(-z)), x, on, most, starts


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, blocks = laid_out(texts)
    chunks, _, counts = chunked(pooled(net, data, blocks)[0], blocks)
    return forward(net, chunks, counts)[0].astype(np.float64)


def fit(texts: list[bytes], labels: list[int], share: float, seed: int = 3, steps: int = 700, batch: int = 96) -> Network:
    """Fits the network by Adam on batches with as many texts of either label; share: of label 1 in all labelled rows.

    Without texts of both labels every score is the share.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1, np.float32))
    share = min(max(share, 0.01), 0.99)
    offset = np.log(share / (1 - share))
    y = np.array(labels, np.float32)
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    if not all(len(s) for s in sides):
        net.dense[-1] = offset
        return net
    net.dense[:] = rng.normal(0, 0.1, len(net.dense))
    params = [net.filters, net.bias, net.dense]
    moment, speed = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        rate = 0.01 * (1 - 0.95 * k / steps)
        pick = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        data, blocks = laid_out([texts[i] for i in pick])
        top, place = pooled(net, data, blocks, want_places=True)
        chunks, second, counts = chunked(top, blocks)
        p, x, on, most, starts = forward(net, chunks, counts)
        gap = ((p - y[pick]) / len(pick)).astype(np.float32)
        g_dense = x.T @ gap + 1e-4 * net.dense
        g_on = np.repeat(gap[:, None] * net.dense[:FILTERS] / counts[:, None], counts, axis=0)
        first_most = on == np.repeat(most, counts, axis=0)
        # the first chunk of a text that has its largest response takes the gradient
        seen = np.cumsum(first_most, axis=0)
        before = np.repeat(seen[starts] - first_most[starts], counts, axis=0)
        first_most &= seen - before == 1
        g_on += first_most * np.repeat(gap[:, None] * net.dense[FILTERS : 2 * FILTERS], counts, axis=0)
        g_on *= on > 0
        keep = np.flatnonzero(~np.isin(np.arange(len(top)), _inside(blocks)) | np.repeat(blocks == 1, blocks))
        block = keep[:, None] + second
        at = block * BLOCK + np.take_along_axis(place, block, 0) * STRIDE
        g_filters = np.zeros_like(net.filters)
        column = np.broadcast_to(np.arange(FILTERS), at.shape)
        live = g_on != 0
        for w in range(WIDTH):
            np.add.at(g_filters[w], (data[at[live] + w], column[live]), g_on[live])
        for i, (q, g) in enumerate(zip(params, (g_filters, g_on.sum(axis=0), g_dense), strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            speed[i] = 0.999 * speed[i] + 0.001 * g * g
            q -= (rate * (moment[i] / (1 - 0.9**k)) / (np.sqrt(speed[i] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    net.dense[-1] += offset
    return net


SCORED = "doc_id long, held_out boolean, score double, predicted int"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text).

    Null and empty texts are one block of zero bytes and get its score. Equal texts get equal scores. Repeated rows are
    scored each; a null doc_id is kept and counts as held out. An empty table gives no rows; other columns are not
    looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # WIDTH * 256 * FILTERS weights, whatever the corpus

    def make():
        net = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            s = np.concatenate([predict(net, texts[lo : lo + 100]) for lo in range(0, len(texts), 100)])
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out")), make, SCORED, _SCORED)


def fit_table(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    texts, marks, share = labelled(docs, labels, "quality", sample)
    return fit([t.encode() for t in texts], marks, share)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_table(docs, table(spark, sf_dir, "labels")))
