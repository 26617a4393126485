"""Points of tables and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.functions import geometry as g
from cloudweave.operators.tables import ranked


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lineitem_place() -> list:
    """Quantity, price and discount, brought to about [-0.5, 0.5]."""
    return [
        (F.col("l_quantity").cast("double") / 50.0 - 0.51).alias("x"),
        (F.col("l_extendedprice").cast("double") / 105000.0 - 0.504).alias("y"),
        (F.col("l_discount").cast("double") * 10.0 - 0.5).alias("z"),
        _rgba("l_partkey", "l_suppkey", "l_orderkey").alias("rgba"),
    ]


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points; only the six columns that make them are read."""
    return load(spark, sf_dir, "lineitem").select(*_lineitem_place())


def _rgba(r: str, gr: str, b: str):
    byte = lambda c: F.col(c).cast("bigint").bitwiseAND(F.lit(255).cast("bigint"))
    return byte(r) + F.shiftleft(byte(gr), 8) + F.shiftleft(byte(b), 16) + F.lit(255 << 24).cast("bigint")


def numbered_lineitem_points(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """The same with point_id, the place in the order of all columns of the table, and more columns of those that are read.

    Columns behind the last of those that make a point only tell rows apart whose points are equal, so they are not read.
    """
    places = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *places[3:])
    ordered = ranked(rows, "l_orderkey", [c for c in rows.columns if c != "l_orderkey"], "point_id", keep=places)
    return ordered.select("point_id", *_lineitem_place(), *(c.alias(n) for n, c in more.items()))


def orders_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points: customer, total price and order key, brought to about [-0.5, 0.5]; point_id is the order key."""
    rows = load(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").cast("bigint").alias("point_id"),
        (F.col("o_custkey").cast("double") / 1500.0 - 0.5).alias("x"),
        (F.col("o_totalprice").cast("double") / 500000.0 - 0.5).alias("y"),
        ((F.col("o_orderkey") % 1000).cast("double") / 1000.0 - 0.3).alias("z"),
        _rgba("o_custkey", "o_orderkey", "o_custkey").alias("rgba"),
    )


def cube_grid(spark: SparkSession, per_axis: int) -> DataFrame:
    """per_axis ** 3 points (2 an axis at least) on [-0.5, 0.5], x fastest, coloured by their place."""
    n = max(2, per_axis)
    i = F.col("id")
    at = {"x": i % n, "y": F.floor(i / n) % n, "z": F.floor(i / (n * n))}
    unit = {a: c.cast("double") / float(n - 1) for a, c in at.items()}
    return spark.range(n**3).select(i.alias("point_id"), *((u - 0.5).alias(a) for a, u in unit.items()), g.pack_rgba(unit["x"], unit["y"], unit["z"], F.lit(1.0)).alias("rgba"))


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Points of (x, y, z, r, g, b, a) in memory, colours in 0 to 1."""
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "point_id bigint, x double, y double, z double, r double, g double, b double, a double")
    return with_rgba(df)


def with_rgba(points: DataFrame) -> DataFrame:
    return points.select("point_id", "x", "y", "z", g.pack_rgba(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("rgba"))
