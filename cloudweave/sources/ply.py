"""PLY point clouds as a Spark data source: spark.read.format("ply").load(path).

The header is read on the driver and gives the schema's columns by their names' meaning; the body is cut into byte ranges
(binary) or row ranges found at line ends (ASCII) that tasks read by themselves. `load` does the same as Spark jobs: headers, line counts and values are all read by tasks,
and a bad file is set aside whole. Paths may be of any file system that
pyarrow opens; several, separated by commas, are scanned together. Option skip_bad_files=true leaves out files that
can't be read instead of failing. point_id begins at 0 in each file, with option unique_ids=true after the last of the
file before.
"""

from __future__ import annotations

import io
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOG = logging.getLogger("cloudweave")
#: Rows of a task, or bytes of ASCII.
RANGE_ROWS, RANGE_BYTES = 1 << 20, 64 << 20
#: Bytes that are read at a time in search of a header's or a line's end.
HEADER_BYTES = 1 << 16

#: The line that ends a header.
_END = re.compile(rb"\nend_header[ \t]*\r?\n")

# Fixed values of the PLY format: scalar types, each with both of its spellings, and their numpy types.
SCALARS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
# Names under which files hold each column.
MEANINGS = {
    "x": ("x",), "y": ("y",), "z": ("z",),
    "r": ("red", "r", "diffuse_red"), "g": ("green", "g", "diffuse_green"), "b": ("blue", "b", "diffuse_blue"),
}
SCHEMA = "path string, point_id bigint, x double, y double, z double, r double, g double, b double, a double"


class PlyError(ValueError):
    """A file that is not a PLY point cloud of the kinds that are read."""


class MissingHeader(PlyError):
    pass


class UnsupportedFormat(PlyError):
    pass


class UnsupportedList(PlyError):
    pass


class MissingProperty(PlyError):
    pass


class UnknownType(PlyError):
    pass


class TruncatedBody(PlyError):
    pass


class BadValue(PlyError):
    pass


@dataclass(frozen=True)
class Header:
    ascii: bool
    count: int
    body: int
    names: tuple[str, ...]
    types: tuple[str, ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(f"{i}", f"<{t}") for i, t in enumerate(self.types)])

    @property
    def columns(self) -> dict[str, int]:
        """Which property is which column; the first of a meaning counts."""
        out = {}
        for column, names in MEANINGS.items():
            found = [i for i, n in enumerate(self.names) if n.lower() in names]
            if found:
                out[column] = found[0]
        return out


def parse_header(data: bytes) -> Header:
    found = _END.search(data)
    if not data.startswith(b"ply") or not found:
        raise MissingHeader("no PLY header")
    end, line_end = found.start(), found.end() - 1
    kind = count = None
    element, names, types = None, [], []
    for words in (line.split() for line in data[:end].decode("ascii", "replace").splitlines()):
        if not words or words[0] in ("comment", "obj_info", "ply"):
            continue
        if words[0] == "format" and len(words) > 1:
            kind = words[1]
            if kind not in ("ascii", "binary_little_endian"):
                raise UnsupportedFormat(f"format {kind} is not read")
        elif words[0] == "element" and len(words) > 2:
            element = words[1]
            if element == "vertex":
                count = int(words[2])
        elif words[0] == "property" and element == "vertex":
            if words[1] == "list":
                raise UnsupportedList(f"list property {words[-1]} of vertices is not read")
            if words[1] not in SCALARS:
                raise UnknownType(f"property type {words[1]}")
            types.append(SCALARS[words[1]])
            names.append(words[2])
    if kind is None or count is None:
        raise MissingHeader("no format or no vertex element")
    header = Header(kind == "ascii", count, line_end + 1, tuple(names), tuple(types))
    for axis in "xyz":
        if axis not in header.columns:
            raise MissingProperty(f"property {axis} is missing")
    return header


def _scale(kind: str) -> float:
    """What a colour of full strength is in a declared type."""
    return float(np.iinfo(kind).max) if kind[0] in "iu" else 1.0


def _batch(path: str, first: int, header: Header, column) -> pa.RecordBatch:
    """A batch of column(i), the values of property i; coordinates by way of 32-bit floats, colours in 0 to 1."""
    found = header.columns
    out = {a: column(found[a]).astype(np.float32).astype(np.float64) for a in "xyz"}
    n = len(out["x"])
    for c in "rgb":
        out[c] = np.clip(column(found[c]).astype(np.float64) / _scale(header.types[found[c]]), 0, 1) if c in found else np.ones(n)
    out["a"] = np.ones(n)
    return pa.RecordBatch.from_pydict({"path": pa.array([path] * n, pa.string()), "point_id": np.arange(first, first + n)} | out)


@dataclass
class Range(InputPartition):
    path: str
    header: Header
    first: int
    rows: int
    start: int
    stop: int
    base: int = 0


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_header(f) -> Header:
    """The header of an open file, however long."""
    data = b""
    while more := f.read(HEADER_BYTES):
        data += more
        if not data.startswith(b"ply"[: len(data)]):
            break
        if _END.search(data, max(0, len(data) - len(more) - 64)):
            break
    return parse_header(data)


def ranges(path: str, rows: int = RANGE_ROWS) -> list[Range]:
    """Parts of a file of about so many rows. ASCII lines are counted once, on the driver, in blocks."""
    with _open(path) as f:
        header = read_header(f)
        size = f.size()
        if not header.ascii:
            step = header.dtype.itemsize
            if size - header.body < header.count * step:
                raise TruncatedBody(f"{path}: {header.count} rows of {step} bytes are declared, {size - header.body} bytes are there")
            return [Range(path, header, i, min(rows, header.count - i), header.body + i * step, header.body + min(i + rows, header.count) * step) for i in range(0, header.count, rows)]
        f.seek(header.body)
        out, seen, at, start = [], 0, header.body, header.body
        while seen < header.count and (block := f.read(1 << 22)):
            ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
            take = ends[: header.count - seen]
            for k in range((rows - seen % rows) - 1, len(take), rows):
                stop = at + int(take[k]) + 1
                out.append(Range(path, header, seen + k + 1 - rows, rows, start, stop))
                start = stop
            seen += len(take)
            stop_at = at + (int(take[-1]) + 1 if len(take) else 0)
            at += len(block)
        if seen == header.count - 1 and size > (stop_at if seen else header.body):
            seen, stop_at = header.count, size  # the last line has no end
        if seen < header.count:
            raise TruncatedBody(f"{path}: {header.count} rows are declared, {seen} are there")
        if seen % rows or not out:
            out.append(Range(path, header, seen - seen % rows, seen % rows, start, stop_at if header.count else start))
        return out


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    if not part.rows:
        return
    header = part.header
    with _open(part.path) as f:
        f.seek(part.start)
        data = f.read(part.stop - part.start)
    if not header.ascii:
        table = np.frombuffer(data, header.dtype, part.rows)
        yield _batch(part.path, part.base + part.first, header, lambda i: table[str(i)])
        return
    yield _ascii_batch(part.path, part.base + part.first, part.first, header, data, part.rows)


def _ascii_batch(path: str, point_id: int, line: int, header: Header, data: bytes, rows: int) -> pa.RecordBatch:
    """A batch of the first rows of an ASCII body's lines, of which the first is number `line`."""
    wanted = sorted(set(header.columns.values()))
    table = _by_csv(data, len(header.names), wanted, rows)
    values = {i: table.column(f"f{i}").to_numpy() for i in wanted} if table is not None else _by_word(path, line, header, data, wanted, rows)
    return _batch(path, point_id, header, lambda i: values[i])


def _by_csv(data: bytes, fields: int, wanted: list[int], rows: int) -> pa.Table | None:
    """Numbers of plain lines, with one blank between words; None for any other."""
    if b"  " in data or b"\t" in data or b" \n" in data or b"\n " in data or b"\r" in data or data.startswith(b" "):
        data = re.sub(rb" *\r?\n *", b"\n", re.sub(rb" {2,}", b" ", data)).lstrip(b" ")
    names = [f"f{i}" for i in range(fields)]
    try:
        table = pc.read_csv(
            io.BytesIO(data), pc.ReadOptions(column_names=names, block_size=max(1 << 20, len(data) + 1)), pc.ParseOptions(delimiter=" ", quote_char=False, ignore_empty_lines=False),
            pc.ConvertOptions(include_columns=[f"f{i}" for i in wanted], column_types={n: pa.float64() for n in names}, null_values=[], strings_can_be_null=False),
        ).slice(0, rows)
    except pa.ArrowInvalid:
        return None
    return table.combine_chunks() if table.num_rows == rows and not any(c.null_count for c in table.columns) else None


def _by_word(path: str, line: int, header: Header, data: bytes, wanted: list[int], rows: int) -> dict[int, np.ndarray]:
    """Numbers of lines of any kind, word by word; tells which line has none."""
    values: dict[int, list[float]] = {i: [] for i in wanted}
    for k, text in enumerate(data.decode("ascii", "replace").split("\n")[:rows]):
        words = [w for w in text.rstrip("\r").split(" ") if w]
        for i in wanted:
            try:
                values[i].append(float(words[i]))
            except (IndexError, ValueError):
                raise BadValue(f"{path}: line {line + k + 1} of the body has no number for {header.names[i]}") from None
    return {i: np.array(v) for i, v in values.items()}


class PlyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.rows = int(options.get("range_rows", RANGE_ROWS))
        self.skip = str(options.get("skip_bad_files", "false")).lower() == "true"
        self.unique = str(options.get("unique_ids", "false")).lower() == "true"

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for path in self.paths:
            try:
                found = ranges(path, self.rows)
                out += [replace(r, base=base) for r in found]
                base += sum(r.rows for r in found) if self.unique else 0
            except (PlyError, OSError) as e:
                if not self.skip:
                    raise
                LOG.warning("left out %s: %s", path, e)
        return out or [Range("", Header(False, 0, 0, (), ()), 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PlyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


# --- files by Spark jobs ---

_HEAD = "file int, path string, ascii boolean, count bigint, body bigint, names array<string>, types array<string>, size bigint, error string"
_HEAD_ARROW = pa.schema([("file", pa.int32()), ("path", pa.string()), ("ascii", pa.bool_()), ("count", pa.int64()), ("body", pa.int64()), ("names", pa.list_(pa.string())), ("types", pa.list_(pa.string())), ("size", pa.int64()), ("error", pa.string())])
_ARROW = pa.schema([("path", pa.string()), ("point_id", pa.int64()), *((c, pa.float64()) for c in "xyzrgba")])
_ERRORS = {e.__name__: e for e in (PlyError, MissingHeader, UnsupportedFormat, UnsupportedList, MissingProperty, UnknownType, TruncatedBody, BadValue)}


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            out = row | dict.fromkeys(("ascii", "count", "body", "names", "types", "size", "error"))
            try:
                with _open(row["path"]) as f:
                    h, size = read_header(f), f.size()
                if not h.ascii and size - h.body < h.count * h.dtype.itemsize:
                    raise TruncatedBody(f"{row['path']}: {h.count} rows of {h.dtype.itemsize} bytes are declared, {size - h.body} bytes are there")
                out |= {"ascii": h.ascii, "count": h.count, "body": h.body, "names": list(h.names), "types": list(h.types), "size": size}
            except (PlyError, OSError) as e:
                out["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([out], schema=_HEAD_ARROW)


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many lines begin in each range of bytes."""
    for batch in batches:
        lines = []
        for row in batch.to_pylist():
            with _open(row["path"]) as f:
                f.seek(max(row["start"] - 1, row["body"]))
                left, n = row["stop"] - 1 - f.tell(), int(row["start"] == row["body"])
                while left > 0 and (data := f.read(min(left, 1 << 22))):
                    n += int(np.count_nonzero(np.frombuffer(data, np.uint8) == 10))
                    left -= len(data)
            lines.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), pa.array(lines, pa.int64())], ["file", "start", "lines"])


def _lines_of(f, row: dict) -> bytes:
    """The lines that begin in a range of bytes, each to its end."""
    start = row["start"]
    if start > row["body"]:
        f.seek(start - 1)
        skipped = start - 1
        while data := f.read(HEADER_BYTES):
            if (at := data.find(b"\n")) >= 0:
                start = skipped + at + 1
                break
            skipped += len(data)
    f.seek(start)
    out = [f.read(max(0, row["stop"] - start))]
    if not out[0].endswith(b"\n"):
        while data := f.read(HEADER_BYTES):
            at = data.find(b"\n")
            out.append(data if at < 0 else data[: at + 1])
            if at >= 0:
                break
    return b"".join(out)


def _piece(row: dict) -> pa.RecordBatch:
    header = Header(row["ascii"], row["count"], row["body"], tuple(row["names"]), tuple(row["types"]))
    with _open(row["path"]) as f:
        if row["ascii"]:
            return _ascii_batch(row["path"], row["base"] + row["first"], row["first"], header, _lines_of(f, row), row["rows"])
        f.seek(row["start"])
        table = np.frombuffer(f.read(row["rows"] * header.dtype.itemsize), header.dtype, row["rows"])
    return _batch(row["path"], row["base"] + row["first"], header, lambda i: table[str(i)])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _piece(row).cast(_ARROW)


def _bad_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            try:
                _piece(row)
            except PlyError as e:
                yield pa.RecordBatch.from_pydict({"file": pa.array([row["file"]], pa.int32()), "error": [f"{type(e).__name__}: {e}"]})


def load(spark: SparkSession, paths: list[str], skip_bad_files: bool = False, unique_ids: bool = False, rows: int = RANGE_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The points (SCHEMA) of PLY files, of which only headers' figures and what is bad about a file come to the driver.

    Tasks read the headers, count the lines of ASCII bodies in ranges of bytes, and, once sums of these counts tell which
    row a range begins with, its values. Without skip_bad_files the first bad file is an error: a header or a length now,
    a value when it is read. With it, values of ASCII files are read once more beforehand, and a file in which any is bad
    is left out whole, before any of its rows goes on. unique_ids: see above.
    """
    from cloudweave.operators.tables import written

    cores = spark.sparkContext.defaultParallelism
    files = spark.createDataFrame(list(enumerate(paths)), "file int, path string").repartition(max(1, min(len(paths), 4 * cores)))
    heads = written(files.mapInArrow(_heads, _HEAD), "ply-heads")
    text = heads.where("error is null and ascii and size > body")
    spans = text.select("file", "path", "body", "size", F.explode(F.sequence("body", F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    spans = spans.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size")))
    lines = written(spans.repartition(4 * cores).mapInArrow(_line_counts, "file int, start bigint, lines bigint"), "ply-lines")
    short = heads.where("error is null and ascii").join(lines.groupBy("file").agg(F.sum("lines").alias("n")), "file", "left").where(F.coalesce("n", F.lit(0)) < F.col("count"))
    told = F.format_string("TruncatedBody: %s: %d rows are declared, %d are there", "path", "count", F.coalesce("n", F.lit(0).cast("bigint")))
    bad = _set_aside(heads.where("error is not null").select("file", "error").unionByName(short.select("file", told.alias("error"))), skip_bad_files)

    good = heads.where("error is null and count > 0")
    good = good.where(~F.col("file").isin(bad)) if bad else good
    by_file = Window.partitionBy("file").orderBy("start")
    first = F.sum("lines").over(by_file.rowsBetween(Window.unboundedPreceding, 0)) - F.col("lines")
    starts = lines.select("file", "start", first.alias("first"), "lines")
    text = good.where("ascii").join(starts, "file").where(F.col("first") < F.col("count"))
    text = text.select("*", F.least(F.col("lines"), F.col("count") - F.col("first")).alias("rows"), F.least(F.col("start") + range_bytes, F.col("size")).alias("stop")).where("rows > 0").drop("lines")
    width = F.aggregate("types", F.lit(0), lambda n, t: n + F.substring(t, 2, 1).cast("int")).cast("bigint")
    plain = good.where("not ascii").withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1, F.lit(rows).cast("bigint"))))
    plain = plain.select("*", F.least(F.lit(rows).cast("bigint"), F.col("count") - F.col("first")).alias("rows"), (F.col("body") + F.col("first") * width).alias("start"))
    pieces = written(text.unionByName(plain.withColumn("stop", F.col("start"))), "ply-pieces")
    if skip_bad_files:
        ascii_ = pieces.where("ascii").withColumn("base", F.lit(0).cast("bigint"))
        worse = _set_aside(ascii_.repartition(max(1, min(ascii_.count(), 1 << 16))).mapInArrow(_bad_values, "file int, error string"), True)
        pieces = pieces.where(~F.col("file").isin(worse)) if worse else pieces
    # A row for each file, in one order.
    counts = pieces.groupBy("file").agg(F.max("count").alias("_n"))
    base = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") if unique_ids else F.lit(0)
    based = pieces.join(counts.select("file", base.cast("bigint").alias("base")), "file")
    return based.repartition(max(1, min(pieces.count(), 1 << 16))).mapInArrow(_values, SCHEMA)


def _set_aside(errors: DataFrame, skip: bool) -> list[int]:
    """Files that are bad, each told once; the first is raised if none may be left out."""
    found = errors.groupBy("file").agg(F.min("error").alias("error")).orderBy("file").collect()
    for r in found:
        if not skip:
            kind, _, text = r["error"].partition(": ")
            raise _ERRORS[kind](text) if kind in _ERRORS else OSError(text)
        LOG.warning("left out %s", r["error"])
    return [r["file"] for r in found]


def save(points: DataFrame, folder: str, kind: str = "binary_little_endian", rows: int = RANGE_ROWS) -> DataFrame:
    """Writes points (x, y, z, rgba) as PLY files of floats and bytes, of at most so many rows, and tells path, points.

    Each task writes its own files, by its number, so one that runs again writes the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                rgba = part.column("rgba").to_numpy()
                table = list(zip(*(part.column(a).to_numpy().astype(np.float32) for a in "xyz"), *((rgba >> s & 255).astype(np.uint8) for s in (0, 8, 16)), strict=True))
                path = f"{folder}/part-{task:06d}-{number:06d}.ply"
                system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                system.create_dir(inner.rpartition("/")[0])
                with system.open_output_stream(inner) as f:
                    f.write(ply_bytes(table, kind))
                number += 1
                yield pa.RecordBatch.from_pydict({"path": [path], "points": [len(table)]})

    return points.select("x", "y", "z", "rgba").mapInArrow(run, "path string, points bigint")


def ply_bytes(points: list[tuple], kind: str = "binary_little_endian") -> bytes:
    """A PLY file of (x, y, z, r, g, b), floats and bytes; for tests and round trips."""
    head = f"ply\nformat {kind} 1.0\nelement vertex {len(points)}\n" + "".join(f"property float {a}\n" for a in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
    if kind == "ascii":
        return head.encode() + "".join(" ".join(repr(float(v)) for v in p[:3]) + f" {p[3]} {p[4]} {p[5]}\n" for p in points).encode()
    table = np.array([tuple(p) for p in points], np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")]))
    return head.encode() + table.tobytes()
