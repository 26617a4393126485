"""The prefix trie of conversations, family by family, then of all.

Conversations of one base id are a family, and begin with turns of their base, which is one of them. So one shuffle by
the base id brings a base's turns to all that need them. Each family is rebuilt and made a small trie as its sorted rows
go by; a node is known by a digest of its turns, and only the families' nodes, combined, are shuffled on to be merged by
digest. A node of the whole belongs to the family of its least member. With this, each family is gone through once more
from its deepest nodes up: what lies below a node is the sum, over the families that have it, of what lies below it and
belongs to them. So nothing is repeated for each level of depth.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import table, written_at

FAMILY, MOST_BORROWED = 100, 6
#: Nodes of a family that a task combines at once, and rows it sends at once.
COMBINED, SENT = 100_000, 10_000
ROOT = b"\0" * 16

_NODES = pa.schema([("base", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("ends", pa.string())])
_NODE_ROW = "base long, node binary, parent binary, depth long, chars long, n long, low long, ends string"


def borrowed(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % MOST_BORROWED


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def hashed_turns(turns: DataFrame) -> DataFrame:
    """base, conv_id, turn, said (a digest of role and text), chars (code points of the text) of turns with a conv_id.

    What the trie needs of a turn is some 60 bytes, whatever the length of its text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    c = F.col("conv_id").cast("long")
    return turns.where("conv_id is not null").select(base_of(c).alias("base"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.char_length(text).cast("long").alias("chars"))


class _Family:
    """The trie of one family, and where its conversations end."""

    def __init__(self, base: int) -> None:
        self.base, self.nodes, self.ends = base, {}, {}
        self.base_turns: list[tuple[bytes, int]] = []

    def begin(self, conv_id: int) -> None:
        self.conv_id, self.at, self.depth, self.own, self.skip = conv_id, ROOT, 0, 0, 0
        self.count(None, 0)
        if conv_id != self.base:
            self.skip = borrowed(conv_id)
            for said, chars in self.base_turns[: self.skip]:
                self.step(said, chars)

    def add(self, said: bytes, chars: int) -> None:
        """The conversation's next own turn."""
        if self.conv_id == self.base and self.own < MOST_BORROWED:
            self.base_turns.append((said, chars))
        self.own += 1
        if self.own > self.skip:
            self.step(said, chars)

    def step(self, said: bytes, chars: int) -> None:
        parent, self.at = self.at, hashlib.blake2b(self.at + said, digest_size=16).digest()
        self.depth += 1
        self.count(parent, chars)

    def count(self, parent: bytes | None, chars: int) -> None:
        found = self.nodes.setdefault(self.at, [parent, self.depth, chars, 0, self.conv_id])
        found[3] += 1
        found[4] = min(found[4], self.conv_id)

    def end(self) -> None:
        self.ends.setdefault(self.at, []).append(self.conv_id)

    def sent(self) -> Iterator[tuple]:
        """The nodes so far, as rows; they may be sent in parts, as counts add up."""
        for node, (parent, depth, chars, n, low) in self.nodes.items():
            yield self.base, node, parent, depth, chars, n, low, None
        self.nodes = {}

    def sent_ends(self) -> Iterator[tuple]:
        """Where conversations of the family end: at most its own number of ids."""
        for node, ids in self.ends.items():
            yield self.base, node, None, None, None, None, None, ",".join(map(str, sorted(ids)))


def _family_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    family, conv_id = None, None
    for batch in batches:
        for base, conv, said, chars in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "said", "chars")), strict=True):
            if conv != conv_id or family is None:
                if family is not None:
                    family.end()
                    if base != family.base:
                        yield from family.sent()
                        yield from family.sent_ends()
                if family is None or base != family.base:
                    family = _Family(base)
                conv_id = conv
                family.begin(conv)
            family.add(said, chars)
            if len(family.nodes) >= COMBINED:
                yield from family.sent()
    if family is not None:
        family.end()
        yield from family.sent()
        yield from family.sent_ends()


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def family_nodes(turns: DataFrame) -> DataFrame:
    """base, node, parent, depth, chars, n, low of the nodes of each family's trie, and base, node, ends of its members' ends.

    A family's rows come sorted to one task, base first, and are not gathered: a task holds the nodes of one family (or
    COMBINED of them, if there are more; the rest of a node then comes in another row).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_family_rows(batches), _NODES)

    ordered = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "said")
    return ordered.select("base", "conv_id", "said", "chars").mapInArrow(run, _NODE_ROW)


def merged(found: DataFrame) -> DataFrame:
    """node, parent, depth, chars, n_convs, conv_id, n_children of all nodes, from the families' nodes."""
    # Rows of a node agree in all that is grouped by; only numbers are left to sum up, which takes no sort.
    nodes = found.where("n is not null").groupBy("node", "parent", "depth", "chars").agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("_up")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, F.col("node") == F.col("_up"), "left").select("node", "parent", "depth", "chars", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"))


_SUMS = pa.schema([("node", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _sums_below(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of families' nodes, deepest first: what lies below each and belongs to the family."""
    here, last, waiting = None, None, {}
    for batch in batches:
        for base, node, parent, leaf, saved in zip(*(batch.column(c).to_pylist() for c in ("base", "node", "parent", "leaf", "saved")), strict=True):
            if base != here:
                here, last, waiting = base, None, {}
            if node == last:
                continue  # a node that its family sent in parts
            last = node
            below = waiting.pop(node, (0, 0))
            leaves, tokens = below[0] + leaf, below[1] + saved
            if parent is not None:
                up = waiting.get(parent, (0, 0))
                waiting[parent] = (up[0] + leaves, up[1] + tokens)
            yield node, leaves, tokens


def sums_below(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens of the subtrees of all nodes.

    Each node belongs to the family of its least member, whose trie has all nodes above it, so every node is counted
    once for each that it is below of. A task holds the sums of one level of one family.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_sums_below(batches), _SUMS)

    mine = base_of(F.col("conv_id")) == F.col("base")
    told = nodes.select(F.col("node").alias("_node"), "conv_id", (F.col("n_children") == 0).cast("long").alias("_leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("_saved"))
    both = found.where("n is not null").select("base", "node", "parent", "depth").join(told, F.col("node") == F.col("_node"))
    rows = both.select("base", "node", "parent", "depth", F.when(mine, F.col("_leaf")).otherwise(F.lit(0)).cast("long").alias("leaf"), F.when(mine, F.col("_saved")).otherwise(F.lit(0)).cast("long").alias("saved"))
    ordered = rows.repartition("base").sortWithinPartitions("base", F.col("depth").desc(), "node")
    local = ordered.select("base", "node", "parent", "leaf", "saved").mapInArrow(run, "node binary, n_leaves long, saved_tokens long")
    return local.groupBy(F.col("node").alias("_below")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


_DIGESTS = pa.schema([("_end", pa.binary()), ("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    node, digest = None, None
    for batch in batches:
        for at, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if at != node:
                if node is not None:
                    yield node, digest.hexdigest()
                node, digest = at, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield node, digest.hexdigest()


def end_digests(found: DataFrame) -> DataFrame:
    """_end (a node), ends_sha256 of the nodes at which conversations end.

    A family's ids come as one text, and families follow each other in the order of numbers, so a digest is fed a row
    for each family, in order, and holds none of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_digests(batches), _DIGESTS)

    return found.where("ends is not null").select("base", "node", "ends").repartition("node").sortWithinPartitions("node", "base").select("node", "ends").mapInArrow(run, "_end binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The trie of turns (conv_id, turn, role, text): a row for each node, known by conv_id (its least member) and depth.

    Turns of a conversation are ordered by turn (null first), those of one turn by a digest of role and text; null roles
    and texts are empty, repeated rows are repeated turns. Rows without a conv_id belong to no conversation and are left
    out. The base of a negative id is the multiple of 100 next towards zero. An empty table gives no rows, as then the
    root has no member. Other columns are not looked at. A conversation of very many turns is gone through in one task,
    a row at a time. Two tables (the families' nodes and all nodes) are written to the shared folder, and read by what
    is returned.
    """
    found, _ = written_at(family_nodes(hashed_turns(turns)), "families")
    nodes, _ = written_at(merged(found), "nodes")
    above = nodes.select(F.col("node").alias("_above"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums_below(found, nodes), F.col("node") == F.col("_below"))
        .join(end_digests(found), F.col("node") == F.col("_end"), "left")
        .join(above, F.col("parent") == F.col("_above"), "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, role, text FROM r),
p AS (SELECT conv_id, depth, list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) AS path, length(text) AS chars FROM o
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
n AS MATERIALIZED (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS own, count(*) OVER (PARTITION BY depth, path) AS n_convs, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM p),
g AS MATERIALIZED (SELECT own AS conv_id, depth, any_value(n_convs) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM n GROUP BY own, depth),
u AS MATERIALIZED (SELECT g.*, a.own AS parent_conv_id FROM g LEFT JOIN n a ON a.conv_id = g.conv_id AND a.depth = g.depth - 1),
k AS MATERIALIZED (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE parent_conv_id IS NOT NULL GROUP BY ALL),
w AS MATERIALIZED (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT a.own AS conv_id, a.depth, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.chars)::BIGINT AS saved_tokens
  FROM w JOIN n a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.own, a.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM w JOIN s USING (conv_id, depth)
"""
