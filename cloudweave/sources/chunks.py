"""Chunk changes of streamed clouds as one stream, read from folders of JSON records within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudweave.streaming.residency import DELTA, split_budget


def chunk_deltas(spark: SparkSession, paths: list[str], total_bytes: int | None = None, clean: str = "off") -> DataFrame:
    """DELTA records of all folders. Each folder is a stream of its own, which gets an equal part of total_bytes a micro-batch.

    A file is never split, so each stream takes one at least. clean: what becomes of files that are done with (off,
    delete). The stream ends with query.stop().
    """
    if not paths:
        raise ValueError("a stream needs at least one folder")
    out = None
    for path, share in zip(paths, split_budget(total_bytes or 0, len(paths))):
        reader = spark.readStream.schema(DELTA).option("cleanSource", clean)
        if total_bytes is not None:
            reader = reader.option("maxBytesPerTrigger", max(1, share))
        part = reader.json(path)
        out = part if out is None else out.unionByName(part)
    return out
