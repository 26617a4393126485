import hashlib
import random

import duckdb
import numpy as np
import pytest

from cloudweave.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, dims=64):
    """Everything measured, in Python's whole numbers."""
    own = [(i, [int(np.floor(1024 * float(np.float32(v)))) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and np.isfinite(np.float32(v)) for v in e)]
    first = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        return min(((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)), default=None)

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in own]
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(own, at, strict=True) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in own]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(k)}
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), digests[c]) for i, c, d in out)


def table(spark, tmp_path, rows):
    spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def clumps(rng, n, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    return [[m + rng.gauss(0, spread) for m in middles[rng.randrange(9)]] for _ in range(n)]


@pytest.mark.parametrize("case", ["clumps", "ties", "few", "copies"])
def test_rows_against_measuring_all(spark, tmp_path, case):
    rng = random.Random(12)
    if case == "clumps":
        rows = list(enumerate(clumps(rng, 300, 0.3)))
        rows += [(900, None), (901, [1.0] * 63), (902, [None] + [0.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (7, rows[7][1]), (8, [0.25] * 64)]
    elif case == "ties":  # a small lattice, so that many vectors lie as far from one centroid as from another
        rows = [(i, [rng.choice((-2, -1, 0, 1, 2)) / 1024 if k < 3 else 0.0 for k in range(64)]) for i in range(400)]
    elif case == "few":
        rows = [(3, [0.1] * 64), (1, [0.2] * 64), (None, [0.3] * 64)]
    else:  # a third of all rows are one vector, and some centroids start at the same place
        rows = [(i, [0.125] * 64 if i % 3 else e) for i, e in enumerate(clumps(rng, 150, 0.05))]
    d = table(spark, tmp_path, rows)
    assert found(clusters.op12_exponion(spark, d)) == plain(rows)
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{d}/embeddings.parquet/*.parquet'")
    if case != "few":  # SQL has no null ids
        sql = [r for r in map(lambda r: (str(r[0]), *r[1:]), c.sql(clusters.OP12_SQL).fetchall())]
        assert case == "clumps" or sorted(sql) == plain(rows)
        assert len(sql) == len(plain(rows))


def test_bounds_hold_and_balls_spare_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-20_000, 20_000, (40, 16))
    x = middles[rng.integers(0, 40, 4000)] + rng.integers(-300, 300, (4000, 16))
    centroids, before = x[:60].copy(), None
    at = upper = lower = None
    measured = []
    for _ in range(8):
        guide = clusters.Guide.of(centroids, before)
        want, least, second = clusters.all_nearest(x, centroids)
        if at is None:
            at, upper, lower = want, np.sqrt(least), np.sqrt(second)
        else:
            at, upper, lower, n = clusters.exponion(x, at, upper, lower, guide)
            measured.append(n)
        assert (at == want).all()
        assert (upper * (1 + 1e-12) >= np.sqrt(least)).all() and (lower <= np.sqrt(second) * (1 + 1e-12)).all()
        before, centroids = centroids, np.array([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else centroids[j] for j in range(60)])
    assert measured[-1] < 4000 * 60 / 10 and sum(measured) < len(measured) * 4000 * 60 / 4


def test_empty_table_large_components_and_one_centroid(spark, tmp_path):
    assert clusters.op12_exponion(spark, table(spark, tmp_path / "a", [(1, [0.0])])).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        clusters.cluster(spark.createDataFrame([(1, [3e38] * 64, 0)], SCHEMA)).rows.collect()
    got = clusters.cluster(spark.createDataFrame([(i, [float(i), 70.0], 0) for i in range(5)], SCHEMA), k=1, dimensions=2)
    assert got.centroids.tolist() == [[2048, 71680]] and sorted(r.distance for r in got.rows.collect()) == [0, 1024**2, 1024**2, 4 * 1024**2, 4 * 1024**2]
    assert got.scanned[0] == 5 and len(got.scanned) == 11
