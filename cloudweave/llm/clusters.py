"""Centroid clustering by exponion search, in whole numbers.

Vectors lie in blocks, a row of a table for about a thousand of them, with their cluster, an upper bound of the distance
to its centroid and a lower bound of that to any other. A round is one pass over the blocks without a shuffle: bounds
move by how far the centroids did, and only where they cross is a vector measured, against the centroids inside a ball
around its own. A block tells what its vectors' moves add to and take from the clusters' sums, and these few numbers are
summed by Spark. Only centroids come to the driver and go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import table, written_at
from cloudweave.operators.tables import dropped

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024.0, 3
#: Components beyond this would make squared distances of more than 63 bits.
LARGEST = 1 << 27
#: Bounds are moved apart by this share, so that their rounding never hides a tie.
SLACK = 1e-9

_MOVES = "array<struct<cluster: int, n: bigint, total: array<bigint>>>"
_BLOCK = f"ids binary, x binary, kind string, cluster binary, upper binary, lower binary, moves {_MOVES}, scanned bigint"
_ARROW = pa.schema(
    [("ids", pa.binary()), ("x", pa.binary()), ("kind", pa.string()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()),
     ("moves", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))), ("scanned", pa.int64())]
)


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, embedding (doubles) of the rows with as many components, none of them null or not finite."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where((F.size("embedding") == dimensions) & ~bad)


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * values) as whole numbers."""
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component is over {LARGEST / scale:.0f}: its squared distances don't fit in 64 bits")
    return out.astype(np.int64)


def blocks(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """The rows of kept() as blocks: an Arrow batch each, components in the fewest bytes that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(np.asarray(batch.column("embedding").flatten()).reshape(-1, dimensions), scale)
            most = int(np.abs(x).max(initial=0))
            kind = "<i2" if most < 1 << 15 else "<i4"
            # A null id is kept apart by a flag bit in front of the ids.
            ids = batch.column("vec_id")
            none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
            packed = none.tobytes() + np.asarray(ids.fill_null(0), "<i8").tobytes()
            yield pa.RecordBatch.from_pydict({"ids": [packed], "x": [x.astype(kind).tobytes()], "kind": [kind], "cluster": [None], "upper": [None], "lower": [None], "moves": [[]], "scanned": [0]}, schema=_ARROW)

    return vectors.mapInArrow(run, _BLOCK)


def starts(vectors: DataFrame, k: int, dimensions: int, scale: float, seed: int) -> np.ndarray:
    """The first k of kept() vectors by the sha256 of `seed:vec_id`; a null id comes last, ties go by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "embedding").limit(k).collect()  # k rows
    return whole(np.array([r.embedding for r in rows], float).reshape(len(rows), dimensions), scale)


@dataclass(frozen=True)
class Guide:
    """What a round's search needs: centroids, how far each has moved, and for each all centroids by distance from it."""

    centroids: np.ndarray
    moved: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None) -> Guide:
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float))
        between = np.sqrt(np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids]).astype(float))
        # A centroid comes first in its own list, also before others at the same place.
        np.fill_diagonal(between, -1.0)
        order = np.argsort(between, axis=1, kind="stable")
        return cls(centroids, moved, order, np.maximum(np.take_along_axis(between, order, axis=1), 0.0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def all_nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance, and that of the second nearest (-1: none), of every vector by measuring all."""
    least, second, at = np.full(len(x), -1, np.int64), np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    for j, c in enumerate(centroids):
        least, second, at = _better(least, second, at, squared(x, c), j)
    return at, least, second


def _better(least, second, at, d, j):
    """The two least squared distances after one more centroid j (a number or an array); ties go to the smaller number."""
    wins = (least < 0) | (d < least) | ((d == least) & (j < at))
    other = np.where(wins, least, d)
    second = np.where((second < 0) | ((other >= 0) & (other < second)), other, second)
    return np.where(wins, d, least), second, np.where(wins, j, at)


def exponion(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, guide: Guide) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds of vectors after a move of the centroids, and how many distances were measured.

    A vector whose upper bound is under its lower bound, or under half the way from its centroid to the next one, stays.
    Otherwise its distance is measured, and if that doesn't settle it, so are those to the centroids within twice that
    distance, plus the way to the next centroid, of its own: the nearest two are among them. They are a beginning of its
    centroid's sorted list. A radius includes its rim, and bounds must be under, not at, so that ties are all measured.
    """
    k, many = len(guide.centroids), len(guide.centroids) > 1
    upper = upper + guide.moved[at]
    far = guide.moved.argsort()[::-1]
    # The lower bound is of the others: it falls by the largest move among them.
    most = np.where(at == far[0], guide.moved[far[1]], guide.moved[far[0]]) if many else 0.0
    lower = lower - most
    near = guide.apart[:, 1] if many else np.full(k, np.inf)
    safe = np.maximum(lower, near[at] / 2) * (1 - SLACK)
    open_ = np.flatnonzero(upper * (1 + SLACK) >= safe)
    scanned = len(open_)
    upper[open_] = np.sqrt(squared(x[open_], guide.centroids[at[open_]]).astype(float))
    open_ = open_[upper[open_] * (1 + SLACK) >= safe[open_]]
    at = at.copy()
    for a in np.unique(at[open_]) if len(open_) else ():
        rows = open_[at[open_] == a]
        radius = (2 * upper[rows] + near[a]) * (1 + SLACK) + SLACK
        inside = np.searchsorted(guide.apart[a], radius, side="right")
        rows = rows[np.argsort(-inside, kind="stable")]
        inside = np.sort(inside)[::-1]
        least, second, best = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        for place in range(inside[0]):
            n = np.searchsorted(-inside, -place, side="left")  # rows whose ball holds more than `place` centroids
            j = guide.order[a, place]
            scanned += n
            least[:n], second[:n], best[:n] = _better(least[:n], second[:n], best[:n], squared(x[rows[:n]], guide.centroids[j]), j)
        at[rows], upper[rows] = best, np.sqrt(least.astype(float))
        lower[rows] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(float)))
    return at, upper, lower, int(scanned)


def _moves(x: np.ndarray, at: np.ndarray, was: np.ndarray | None) -> list[dict]:
    """What the clusters' counts and sums gain by vectors that came or went."""
    changed = np.arange(len(x)) if was is None else np.flatnonzero(at != was)
    out: dict[int, list] = {}
    for to, sign in ((at, 1), *(((was, -1),) if was is not None else ())):
        for j in np.unique(to[changed]):
            rows = changed[to[changed] == j]
            n, total = out.get(int(j), (0, 0))
            out[int(j)] = (n + sign * len(rows), total + sign * x[rows].sum(axis=0))
    return [{"cluster": j, "n": n, "total": total.tolist()} for j, (n, total) in out.items()]


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """One block after the other, so that only one is held twice."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def assigned(table_: DataFrame, guide: Guide, dimensions: int) -> DataFrame:
    """The blocks after one round's search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                x = np.frombuffer(row["x"], row["kind"]).reshape(-1, dimensions).astype(np.int64)
                if row["cluster"] is None:
                    was = None
                    at, least, second = all_nearest(x, guide.centroids)
                    upper, lower = np.sqrt(least.astype(float)), np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(float)))
                    scanned = len(x) * len(guide.centroids)
                else:
                    was = np.frombuffer(row["cluster"], "<i4").astype(np.int64)
                    at, upper, lower, scanned = exponion(x, was, np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8"), guide)
                yield pa.RecordBatch.from_pylist([row | {"cluster": at.astype("<i4").tobytes(), "upper": upper.astype("<f8").tobytes(), "lower": lower.astype("<f8").tobytes(), "moves": _moves(x, at, was), "scanned": scanned}], schema=_ARROW)

    return table_.mapInArrow(run, _BLOCK)


def _told(table_: DataFrame, dimensions: int) -> list:
    """The sum of all blocks' moves: a row for each cluster."""
    each = table_.select(F.explode("moves").alias("m")).select("m.*")
    return each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dimensions))).alias("total")).collect()


@dataclass(frozen=True)
class Clustered:
    """vec_id, cluster, distance of every vector, the final centroids, and the distances measured in each search."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE, seed: int = SEED) -> Clustered:
    """Clusters of vectors (vec_id, embedding) after so many rounds.

    Vectors of another length, or with a null or non-finite component, are left out; repeated rows and ids are clustered
    each; a null id is kept, and starts a centroid only if there are too few others; ties go to the smaller centroid; of
    fewer than k vectors each starts one; an empty table gives no rows. Other columns are not looked at. Components over
    LARGEST / scale are an error, as squared distances would not fit in a long. k may be some thousands: k lists of k
    centroids go to each task, and k sums of each come back.

    Each round writes the blocks (two bytes a component, where they fit) to the shared folder and deletes those before.
    """
    rows = kept(vectors, dimensions)
    centroids = starts(rows, k, dimensions, scale, seed)
    totals, counts, before, scanned = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), None, []
    now, path = written_at(blocks(rows, dimensions, scale), "blocks")
    for done in range(rounds + 1 if len(centroids) else 0):
        former, (now, path) = path, written_at(assigned(now, Guide.of(centroids, before), dimensions), "blocks")
        dropped(now.sparkSession, former)
        scanned.append(now.agg(F.sum("scanned").alias("n")).first()["n"])
        if done < rounds:
            for r in _told(now, dimensions):
                counts[r.cluster] += r.n
                totals[r.cluster] += np.array(r.total, np.int64)
            before, centroids = centroids, np.where(counts[:, None] > 0, totals // np.maximum(counts, 1)[:, None], centroids)
    final = centroids

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                at, n = np.frombuffer(row["cluster"], "<i4"), len(row["cluster"]) // 4
                x = np.frombuffer(row["x"], row["kind"]).reshape(-1, dimensions).astype(np.int64)
                ids = pa.array(np.frombuffer(row["ids"], "<i8", offset=n), mask=np.frombuffer(row["ids"], np.uint8, n).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(squared(x, final[at]))], ["vec_id", "cluster", "distance"])

    return Clustered(now.select("ids", "x", "kind", "cluster").mapInArrow(spread, "vec_id long, cluster int, distance long"), centroids, scanned)


def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings, with their inertia and centroids."""
    found = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: r.s for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    of = spark.createDataFrame([(j, sums[j], sum(sums.values()), digests[j]) for j in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def _op12_sql() -> str:
    parts = [f"""WITH vec AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v::DOUBLE))) = {DIMENSIONS}),
cmp AS MATERIALIZED (SELECT r, i, floor(embedding[i]::DOUBLE * {SCALE:.0f})::BIGINT AS v FROM (SELECT r, embedding, unnest(range(1, {DIMENSIONS + 1})) AS i FROM vec)),
ini AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), embedding) - 1 AS c FROM vec QUALIFY c < {CENTROIDS}),
cen0 AS MATERIALIZED (SELECT c, i, v FROM ini JOIN cmp USING (r))"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        parts.append(f"dst{k} AS (SELECT r, c, sum((cmp.v - cen{k}.v) * (cmp.v - cen{k}.v))::BIGINT AS d FROM cmp JOIN cen{k} USING (i) GROUP BY r, c)")
        parts.append(f"own{k} AS MATERIALIZED (SELECT r, c, d FROM dst{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if k < ROUNDS:
            parts.append(f"cen{k + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(n.v, o.v) AS v FROM cen{k} o LEFT JOIN (SELECT c, i, (sum(v) - (((sum(v) % count(*)) + count(*)) % count(*)))::BIGINT // count(*) AS v FROM own{k} JOIN cmp USING (r) GROUP BY c, i) n ON o.c = n.c AND o.i = n.i)")
    last = ROUNDS
    parts.append(f"dig AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM cen{last} GROUP BY c)")
    return ",\n".join(parts) + f"\nSELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM own{last} JOIN vec USING (r) JOIN dig USING (c)"


OP12_SQL = _op12_sql()
