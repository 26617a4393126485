"""Near-duplicates by SimHash fingerprints, found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.llm.common import map_arrow, table, written
from cloudweave.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Hashes whose bits are unpacked at once.
BLOCK = 8192
#: Fingerprints in a task that emits their balls: 65 rows of each.
BALL_ROWS = 10_000
#: The bytes that part words are those at which bytes.split() splits; bytes.lower() lowers A-Z alone.
_FLIPS = [0, *(1 << k if k < 63 else -(1 << 63) for k in range(64))]


def slices(text: str | None, shingle: int) -> tuple[bytes, list[slice]]:
    """The words of a text with one space between them, and where in them its shingles are."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if len(words) < shingle:
        return line, [slice(0, len(line))]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return line, list(map(slice, [0, *(ends[: len(words) - shingle] + 1).tolist()], ends[shingle - 1 :].tolist()))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text: a bit is 1 if set in over half of its shingles' hashes; 0 without words."""
    line, cuts = slices(text, shingle)
    if not line:
        return 0
    grams = map(line.__getitem__, cuts)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(seed))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[lo : lo + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, extra: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row, and a long column that goes along."""
    along = [extra] if extra else []

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": prints.view(np.int64)} | {c: batch.column(c) for c in along}

        return step

    names = ["doc_id", "fp", *along]
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *along), make, ", ".join(f"{c} long" for c in names), pa.schema([(c, pa.int64()) for c in names]))


def neighbours(met: DataFrame) -> DataFrame:
    """Pairs (a, b): each fp of met (fp, variant) with the next lower one at a variant."""
    lower = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return met.select(lower.alias("a"), F.col("fp").alias("b")).where("a is not null").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints at 1 or 2 differing bits that connect all such fingerprints of prints (fp, distinct).

    Every fingerprint emits the 65 values within half the radius. Two fingerprints within the radius meet at one of
    them, and all that meet at one are within the radius of each other, so it is enough to link each with the next lower
    of those it meets. At most 65 distinct fingerprints meet at a value. The distances of the pairs are checked.
    """
    ball = prints.select("fp", F.explode(F.lit(_FLIPS)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    return neighbours(ball).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_key", F.xxhash64(F.col("text").cast("string")))


def _components(prints: DataFrame) -> DataFrame:
    """fp, component of each distinct fingerprint of prints (doc_id, fp), and component_id, the component's least doc_id."""
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts", rows=prints.count())
    n = firsts.count()
    found = components(links(firsts.select("fp").repartition(1 + n // BALL_ROWS)), n)
    grouped = firsts.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return grouped.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs (doc_id, text).

    component_id is the least doc_id among all documents that a row's fingerprint reaches over links of at most two
    differing bits. Null, empty and wordless texts have fingerprint zero. Repeated rows are repeated; a null doc_id is
    kept and is never a component's id unless no row of the component has one. An empty table gives no rows. Other
    columns are not looked at. Equal fingerprints are linked once, as one, whatever the number of their rows.
    """
    prints = written(fingerprints(docs), "fingerprints", rows=docs.count(), gather=True)
    return prints.join(_components(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, placed: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows of docs that are kept of the components in placed (doc_id, text_key, component), all columns."""
    pick = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("key"))).alias("kept"))
    kept = pick.select(F.col("kept.none").alias("none"), F.col("kept.id").alias("id"), F.col("kept.key").alias("key"))
    # The rows go along as structs, so no column of theirs can clash. Texts are streamed past a hash table of what is
    # kept in each partition, not sorted; only where rows repeat are they grouped.
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    found = named.join(kept.hint("shuffle_hash"), ["none", "id", "key"], "left_semi")
    repeated = prints.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return (found.dropDuplicates(["none", "id", "key"]) if repeated else found).select("row.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row of the least doc_id (a null one last, then the least hash of the text), all columns.

    Rows that repeat the kept one's doc_id and text go too.
    """
    prints = written(fingerprints(keyed(docs), extra="text_key"), "fingerprints", rows=docs.count(), gather=True)
    return kept_rows(docs, prints.join(_components(prints), "fp"), prints)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
