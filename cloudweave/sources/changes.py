"""Chunk changes as a streaming source of its own: files of JSON records that are admitted by bytes.

The source is a stream of files, of which only names and sizes come to the driver; tasks read and parse them. Its offset
is the name of the last file, kept in the query's checkpoint, so a restarted query goes on behind it. How much a
micro-batch takes is a budget of bytes, which a control file in the folder may change while the stream runs, as it may
the target size of chunks on screen. Each file comes with what is still waiting behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FILES = "path string, bytes bigint, pending_files bigint, pending_bytes bigint, budget bigint, target double"
#: Records of a stream: a change, the bytes of the chunk's payload, and the state of the source when it was admitted.
RECORDS = "cloud_id string, seq bigint, op string, chunk_id string, depth int, num_points int, payload_bytes bigint, in_flight bigint, decode_pending bigint, target double"
#: Seen as settings, not as records.
CONTROL = "control.json"
DEFAULT_BYTES, DEFAULT_TARGET = 64 << 20, 128.0


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ChangeFiles(SimpleDataSourceStreamReader):
    """Files of a folder in the order of their names; a new file's name must come after those before it."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.bytes = int(options.get("max_bytes", DEFAULT_BYTES))
        self.target = float(options.get("target_size", DEFAULT_TARGET))
        self.clean = str(options.get("clean", "off")).lower() == "delete"

    def _files(self) -> list[tuple[str, int]]:
        system, inner = _system(self.path)
        found = system.get_file_info(fs.FileSelector(inner))
        return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name != CONTROL and not f.base_name.startswith((".", "_")))

    def _settings(self) -> tuple[int, float]:
        """Budget and target as they are now: the control file's where it sets them, else the options'."""
        system, inner = _system(f"{self.path}/{CONTROL}")
        try:
            with system.open_input_stream(inner) as f:
                told = json.loads(f.read())
        except (FileNotFoundError, ValueError):
            told = {}
        return max(1, int(told.get("max_bytes", self.bytes))), float(told.get("target_size", self.target))

    def initialOffset(self) -> dict:
        return {"file": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next files, of at most the budget of bytes together, one at least; a file is never split."""
        budget, target = self._settings()
        waiting = [f for f in self._files() if f[0] > start["file"]]
        taken, total = 0, 0
        while taken < len(waiting) and (not taken or total + waiting[taken][1] <= budget):
            total += waiting[taken][1]
            taken += 1
        behind = waiting[taken:]
        rows = [(f"{self.path}/{n}", size, len(behind), sum(s for _, s in behind), budget, target) for n, size in waiting[:taken]]
        return iter(rows), {"file": waiting[taken - 1][0] if taken else start["file"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same files again, after a failure."""
        budget, target = self._settings()
        files = self._files()
        behind = [f for f in files if f[0] > end["file"]]
        return iter([(f"{self.path}/{n}", size, len(behind), sum(s for _, s in behind), budget, target) for n, size in files if start["file"] < n <= end["file"]])

    def commit(self, end: dict) -> None:
        """Files that all is done with are deleted, if that was asked for."""
        if self.clean:
            system, inner = _system(self.path)
            for name, _ in self._files():
                if name <= end["file"]:
                    system.delete_file(f"{inner}/{name}")


class ChunkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def schema(self) -> str:
        return FILES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return ChangeFiles(self.options)


_ARROW = pa.schema([("cloud_id", pa.string()), ("seq", pa.int64()), ("op", pa.string()), ("chunk_id", pa.string()), ("depth", pa.int32()), ("num_points", pa.int32()), ("payload_bytes", pa.int64())])
_OUT = pa.schema([*_ARROW, ("in_flight", pa.int64()), ("decode_pending", pa.int64()), ("target", pa.float64())])


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of files, a block at a time; fields that a record lacks are null, others are left."""
    for batch in batches:
        for row in batch.to_pylist():
            system, inner = _system(row["path"])
            if not row["bytes"]:
                continue
            with system.open_input_stream(inner) as f:
                reader = pj.open_json(f, parse_options=pj.ParseOptions(explicit_schema=_ARROW, unexpected_field_behavior="ignore"))
                for part in reader:
                    n = part.num_rows
                    more = [pa.array([v] * n, t) for v, t in ((batch.num_rows, pa.int64()), (row["pending_files"], pa.int64()), (row["target"], pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], schema=_OUT)


def change_stream(spark: SparkSession, path: str, max_bytes: int = DEFAULT_BYTES, target_size: float = DEFAULT_TARGET, clean: str = "off") -> DataFrame:
    """RECORDS of a folder's files, max_bytes of files a micro-batch; control.json may set max_bytes and target_size anew."""
    spark.dataSource.register(ChunkFiles)
    files = spark.readStream.format("chunk_files").option("max_bytes", max_bytes).option("target_size", target_size).option("clean", clean).load(path)
    return files.mapInArrow(parsed, RECORDS)
