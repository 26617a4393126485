"""Near-duplicates by the Jaccard similarity of word shingles: candidates by min-hash bands, each link verified exactly."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm.common import map_arrow, written
from cloudweave.llm.components import components
from cloudweave.llm.simhash import kept_rows, keyed, neighbours, slices

SHINGLE, SIMILARITY = 5, 0.8
SEED = 42
#: Two texts are candidates if all ROWS least hashes of one of BANDS bands agree: at a similarity of 0.8 all but one in 2,800 are.
BANDS, ROWS = 20, 5
#: Shingles of a block of texts; a task holds two blocks of a torn cluster against each other.
CELL = 250_000
#: Shingles that are hashed at once by all functions.
BLOCK = 4096
_TIMES = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words too."""
    line, cuts = slices(text, shingle)
    digests = b"".join(map(xxhash.xxh64_digest, map(line.__getitem__, cuts), repeat(SEED)))
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed long of each band; equal longs of different bands don't meet, as the band's number is hashed too."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(29))
    for lo in range(0, len(mixed), BLOCK):
        np.minimum(least, (mixed[lo : lo + BLOCK, None] * _TIMES).min(axis=0), out=least)
    parts = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64).tolist()


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the hash of the words in order), text_key, bands of each row."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            prints = np.array([xxhash.xxh64_intdigest(slices(t, shingle)[0], SEED) for t in texts], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": prints.view(np.int64), "text_key": batch.column("text_key"), "bands": [bands(grams(t, shingle)) for t in texts]}

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_key", pa.int64()), ("bands", pa.list_(pa.int64()))])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "text_key")
    return map_arrow(rows, make, "doc_id long, fp long, text_key long, bands array<long>", schema)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """fp, grams of the rows of docs (fp, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"fp": batch.column("fp"), "grams": [grams(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]}

        return step

    return map_arrow(docs.select("fp", F.col("text").cast("string")), make, "fp long, grams array<long>", pa.schema([("fp", pa.int64()), ("grams", pa.list_(pa.int64()))]))


def joins(fps: list[int], groups: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of fps at the similarity that connect all groups which such a pair connects; pairs in one group aren't tried.

    Texts come by size. Two of them can be similar only if they share one of the first hashes of either, in the order
    of how rare they are: so many that too few are left behind them.
    """
    seen = Counter(h for s in sets for h in s.tolist())
    ordered = [sorted(s.tolist(), key=lambda h: (seen[h], h)) for s in sets]
    lead = {g: g for g in groups}

    def top(g: int) -> int:
        while lead[g] != g:
            lead[g] = lead[lead[g]]
            g = lead[g]
        return g

    at, out, members = defaultdict(list), [], [frozenset(s) for s in ordered]
    for i in sorted(range(len(fps)), key=lambda i: len(ordered[i])):
        n, tried = len(ordered[i]), set()
        for h in ordered[i][: n - ceil(similarity * n - 1e-9) + 1]:
            for j in at[h]:
                if j not in tried and top(groups[i]) != top(groups[j]):
                    tried.add(j)
                    common = len(members[i] & members[j])
                    if common * (1 + similarity) >= similarity * (n + len(members[j])) - 1e-9:
                        lead[top(groups[i])] = top(groups[j])
                        out.append((fps[j], fps[i]))
            at[h].append(i)
    return out


def cells(texts: DataFrame, cell: int) -> DataFrame:
    """texts (cluster, piece, fp, grams) of the clusters in several pieces, dealt to cells that hold all of their pairs.

    A piece of over `cell` shingles is parted into blocks of about so many, and the smaller ones of a cluster share
    blocks of that size. Two blocks make a cell, unless they are of one large piece: such pairs needn't be tried. So a
    cell is of bounded size whatever the size of a cluster, and a cluster that is one block is one cell.
    """
    sizes = written(texts.groupBy("cluster", "piece").agg(F.sum(F.size("grams").cast("long")).alias("size")), "piece-sizes")
    torn = sizes.groupBy("cluster").agg(F.count("*").alias("pieces"), F.sum(F.when(F.col("size") <= cell, F.col("size")).otherwise(0)).alias("small")).where("pieces > 1")
    known = sizes.join(torn, "cluster").withColumn("large", F.when(F.col("size") > cell, F.col("piece"))).withColumn("parts", F.ceil(F.when(F.col("large").isNull(), F.col("small")).otherwise(F.col("size")) / cell))
    # Small pieces are kept whole in a block; large ones are dealt by text.
    dealt = F.pmod(F.xxhash64(F.when(F.col("large").isNull(), F.col("piece")).otherwise(F.col("fp"))), F.col("parts"))
    placed = texts.join(known.select("cluster", "piece", "large", "parts"), ["cluster", "piece"]).withColumn("block", F.xxhash64("large", dealt))
    placed = written(placed.select("cluster", "piece", "large", "block", "fp", "grams"), "blocks")
    blocks = placed.select("cluster", "large", "block").distinct()
    low, high = blocks.toDF("cluster", "large_a", "a"), blocks.toDF("cluster", "large_b", "b")
    pairs = low.join(high, "cluster").where("a <= b and (large_a is null or large_b is null or large_a <> large_b)").select("cluster", "a", "b")
    pairs = pairs.withColumn("cell", F.struct("cluster", "a", "b"))
    sides = pairs.select("cluster", F.col("a").alias("block"), "cell").unionByName(pairs.where("a < b").select("cluster", F.col("b").alias("block"), "cell"))
    return placed.join(sides, ["cluster", "block"]).select("cell", "piece", "fp", "grams")


def mend(texts: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of texts (cluster, piece, fp, grams) that connect all pieces of each cluster which similar texts connect."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = joins(rows["fp"].tolist(), rows["piece"].tolist(), rows["grams"].tolist(), similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cells(texts, cell).groupBy("cell").applyInPandas(run, "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """prints (doc_id, fp, text_key) of docs (with text_key), and fp, component of each fp that is similar to another.

    Texts that share a band are one cluster. In each bucket of a band neighbours are verified; where that leaves a
    cluster in more than one piece, the texts of different pieces are held against each other, in blocks.
    """
    total = docs.count()
    prints = written(_sketches(docs, shingle), "sketches", rows=total, gather=True)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("key"))
    firsts = written(prints.groupBy("fp").agg(F.min(row).alias("first"), F.first("bands").alias("bands")), "firsts", rows=total)
    buckets = firsts.select("fp", F.explode("bands").alias("variant"))
    pairs = written(neighbours(buckets), "pairs", rows=total)
    n = pairs.count()
    clusters = written(components(pairs, n).withColumnRenamed("component", "cluster"), "clusters", rows=n)
    chosen = firsts.join(clusters, F.col("fp") == F.col("node")).select("fp", "first.*")
    named = docs.select("text", F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("text_key").alias("key"))
    texts = named.join(chosen.hint("shuffle_hash"), ["none", "id", "key"])
    sets = written(_sets(texts, shingle).groupBy("fp").agg(F.first("grams").alias("grams")), "grams")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    true = written(both.where(common * (1 + similarity) >= similarity * (F.size("ga") + F.size("gb")) - 1e-9).select("a", "b"), "links")
    pieces = components(true, n).withColumnRenamed("node", "fp").withColumnRenamed("component", "piece")
    placed = written(clusters.withColumnRenamed("node", "fp").join(pieces, "fp", "left").withColumn("piece", F.coalesce("piece", "fp")), "pieces", rows=n)
    mended = mend(placed.join(sets, "fp"), similarity, cell)
    return prints, components(true.unionByName(mended), n).withColumnRenamed("node", "fp")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """As simhash.one_of_each, of components of texts whose shingle sets are at least so similar."""
    prints, found = groups(keyed(docs), shingle, similarity)
    return kept_rows(docs, prints.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), prints)
