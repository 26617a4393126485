"""Plumbing of the operators: shared folder, written tables, and global ranks without a global sort task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset and all of Spark is on this machine, a temporary one is set, which goes when Python ends; on a
    cluster there must be one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="cloudweave-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class owned:
    """Owns the intermediate tables that are written inside its block, and deletes them when it is left.

    What still reads them must be done by then, or be kept: keep(path) leaves a table to the block around, if there is
    one. A block of one query's own (with its result written or collected inside) leaves nothing in the shared folder.
    """

    _open = threading.local()

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> owned:
        owned._stack().append(self)
        return self

    def __exit__(self, *_) -> None:
        owned._stack().remove(self)
        for path in self.paths:
            dropped(self.spark, path)

    def keep(self, path: str) -> None:
        self.paths.remove(path)
        around = owned._stack().index(self) - 1
        if around >= 0:
            owned._stack()[around].paths.append(path)

    @classmethod
    def _stack(cls) -> list[owned]:
        if not hasattr(cls._open, "blocks"):
            cls._open.blocks = []
        return cls._open.blocks

    @classmethod
    def add(cls, path: str) -> None:
        """Gives a written table to the innermost block."""
        if cls._stack():
            cls._stack()[-1].paths.append(path)


def written_at(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back, with where it is.

    The lineage is cut, and a lost executor loses nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/cloudweave/{name}-{uuid.uuid4().hex}"
    owned.add(path)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no frame in use reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def file_by_file(spark: SparkSession) -> Iterator[None]:
    """Scans of jobs inside take a task for each file, instead of filling splits with files.

    A shuffle to over 200 partitions holds all rows of a task, so a task of many ranges of ranks would be large.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are worked out once for each row.

    Spark puts the expression of a column in place of its name in later filters, again and again; it doesn't do so
    through a generator, so the columns come from one that gives one row.
    """
    return df.select(*(F.col(c) for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


#: Rows of a global order that a task sorts, about.
RANK_ROWS = 1_000_000


def ranked(df: DataFrame, key: str, ties: list[str | Column], name: str, buckets: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the row number (from 0) in the order of key, then ties, without gathering all rows in a task.

    keep: the columns that are left, where others are there only to order by.

    Rows are cut into ordered ranges of about RANK_ROWS rows by sampled bounds of key and ties together, so a key that
    holds much of all rows is cut by its ties. The sorted ranges are written, numbered within, and moved on by the
    counts of the ranges before, one number for each range, which the driver reads once. So there are as many tasks as
    the rows ask for, and the numbers cost no join.
    """
    return ranked_counted(df, key, ties, name, buckets, keep)[0]


def ranked_counted(df: DataFrame, key: str, ties: list[str | Column], name: str, buckets: int | None = None, keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """As ranked, and the number of rows."""
    n = buckets or max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANK_ROWS))
    order = [key, *ties]
    # The number of a row's range, and 33 bits for its place there.
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(keep or df.columns), F.monotonically_increasing_id().alias("_at")), "ranked")
    part = F.shiftright("_at", 33)
    counts = {r["_part"]: r["_n"] for r in placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (own + F.get(longs(before), part.cast("int"))).cast("bigint")).drop("_at"), total


def longs(values: list[int]) -> Column:
    """A constant array of whole numbers, however many."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def ranked_within(df: DataFrame, key: str, ties: list[str | Column], name: str, keep: list[str], of_key: dict[str, Column]) -> DataFrame:
    """Rows of df (key, and the columns to keep) with the row number (from 0) in their key's order, and aggregates of_key.

    The order is of ties; a key may hold any share of all rows, as numbers are taken from the global order.
    """
    placed = ranked(df, key, ties, name, keep=list(dict.fromkeys([key, *keep])))
    sizes = placed.groupBy(F.col(key).alias("_key")).agg(F.min(name).alias("_first"), *(c.alias(n) for n, c in of_key.items()))
    return placed.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col(name) - F.col("_first")).drop("_key", "_first")


def quantiles(df: DataFrame, key: str, value: str, ties: list[str], of: dict[str, float]) -> DataFrame:
    """key, mean and the interpolated quantiles of value, nulls apart, by name.

    A quantile lies between two places of the order, each of which counts the more the nearer it is. So no key's values
    are gathered: rows are ranked in ranges and summed up by partial sums. ties tell rows of equal values apart, by which
    a common value is cut too.
    """
    # Nulls come first in the order; places are counted from the first value on.
    placed = ranked_within(df, key, [value, *ties], "_place", [value], {"_nulls": F.count_if(F.col(value).isNull()), "_known": F.count(value)})
    at = F.col("_place") - F.col("_nulls")
    off = {n: F.abs(at - F.lit(float(q)) * (F.col("_known") - 1)) for n, q in of.items()}
    return placed.groupBy(key).agg(F.avg(value).alias("mean"), *(F.sum(F.when((at >= 0) & (o < 1), F.col(value) * (1 - o))).alias(n) for n, o in off.items()))
