"""Shared plumbing of the training-data operators: tables, shared folder, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.operators import tables

#: Rows in one Arrow batch that goes to a Python worker. Documents may be long, so the batch is kept
#: far below Spark's default; at 100 kB a row it stays near 100 MB.
ARROW_ROWS = 1000

#: Narrow rows in a file, where their number is known beforehand.
FILE_ROWS = 100_000

#: Labelled rows whose crc32(doc_id) has this remainder (mod 5) are held out of every fit.
FOLDS, HELD_OUT = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table, with Arrow batches bounded for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_at(df: DataFrame, name: str, sort_by: str | None = None, rows: int | None = None, in_file: int = FILE_ROWS, gather: bool = False, compression: str | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back, with where it is.

    rows: about how many rows df has; where they are narrow and few, they go to few files, of about in_file rows. That
    takes a small shuffle if what makes them is costly and must stay spread (gather=True).
    """
    files = None if rows is None else 1 + rows // in_file
    out = df if files is None else df.repartition(files) if gather else df.coalesce(files)
    return tables.written_at(out.sortWithinPartitions(sort_by) if sort_by else out, name, compression)


def written(df: DataFrame, name: str, **how) -> DataFrame:
    return written_at(df, name, **how)[0]


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow by a function of one batch; make() runs once in each task, and may keep state of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch), schema=arrow)

    return df.mapInArrow(run, schema)


#: Bytes of texts that a model is fitted on at most (of each label), and of one of them.
FIT_BYTES, FIT_TEXT = 32 << 20, 4 << 20


def fitting(rows: DataFrame, group: str, order: str, sample: int) -> DataFrame:
    """Of rows (doc_id, text, a group, an order), one of each doc_id, in each group the first by order: at most `sample`
    whole texts of FIT_BYTES together. Texts of over FIT_TEXT bytes are left out.

    rows should be few: what may be chosen of a group is ordered in one task.
    """
    single = rows.where(F.octet_length("text") <= FIT_TEXT).groupBy("doc_id", group, order).agg(F.min("text").alias("text"))
    by = Window.partitionBy(group).orderBy(order, "doc_id")
    placed = single.withColumn("_place", F.row_number().over(by)).withColumn("_bytes", F.sum(F.octet_length("text").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where((F.col("_place") <= sample) & (F.col("_bytes") <= FIT_BYTES)).drop("_place", "_bytes")


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> tuple[list[str], list[int], float]:
    """Texts and labels to fit on, and the share of label 1; never of the held-out fold, never without both.

    At most `sample` texts of either label, one for an id, within the bounds of fitting(). The share is that of all
    labels outside the fold (one half where there are none).
    """
    own = labels.where(~held_out() & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
    order = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = None
    for value in (0, 1):
        part = own.where(F.col("_label") == value).withColumn("_order", order).orderBy("_order", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string")).where(~held_out() & F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = fitting(texts, "_label", "_order", sample).select("doc_id", "text", "_label").toPandas().sort_values(["doc_id", "text"])
    counts = own.agg(F.count("*").alias("n"), F.sum("_label").alias("ones")).first()
    return rows["text"].tolist(), rows["_label"].tolist(), ((counts["ones"] or 0) + 0.5) / (counts["n"] + 1)
