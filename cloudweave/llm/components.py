"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm.common import written_at
from cloudweave.operators.tables import dropped


def _lows(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each a, itself included; partial sums keep a hub's shuffle small."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))


def components(edges: DataFrame, rows: int, rounds: int = 60) -> DataFrame:
    """edges (a long, b long; about so many rows) to (node, component): the least node that each node reaches.

    Loops, repeated and reversed edges are allowed; nodes without an edge to another are not in the result. Each
    round writes its edges to the shared folder and deletes those of the round before; a star's centre is joined by a
    sort-merge join that Spark may split.
    """
    now, path = written_at(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", rows=rows)
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lows(both), F.col("a") == F.col("k")).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = _lows(down)
        small = down.join(low, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("k").alias("b"))).where("a <> b").distinct()
        former, (now, path) = path, written_at(small, "edges", rows=rows)
        dropped(now.sparkSession, former)
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        rows = sign["n"]
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
