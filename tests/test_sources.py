import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.operators import pack
from cloudweave.sources import ply
from cloudweave.sources import points as src

HEAD = "ply\nformat {} 1.0\ncomment made here\nelement vertex {}\n"
XYZ = "property float x\nproperty float y\nproperty float z\n"


def save(tmp_path, name, *parts):
    path = tmp_path / name
    path.write_bytes(b"".join(p.encode() if isinstance(p, str) else p for p in parts))
    return str(path)


@pytest.fixture(scope="module")
def read(spark):
    ply.register(spark)
    return lambda path, **options: spark.read.format("ply").options(**options).load(path)


def test_ascii_colours_and_types(read, tmp_path):
    p = save(tmp_path, "a.ply", HEAD.format("ascii", 3), XYZ, "property uchar red\nproperty uchar green\nproperty uchar blue\nproperty int extra\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n", "0 0 0 255 0 0 7\n1 2 3 0 255 0 7\n-1.5 2e3 .25 0 0 255 7\n")
    got = read(p).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(0, 0, 0), (1, 2, 3), (-1.5, 2000, 0.25)]
    assert [(r.r, r.g, r.b, r.a) for r in got] == [(1, 0, 0, 1), (0, 1, 0, 1), (0, 0, 1, 1)]


def test_without_colours_all_is_white_and_last_line_may_lack_its_end(read, tmp_path):
    p = save(tmp_path, "w.ply", HEAD.format("ascii", 2), XYZ, "end_header\n1 2 3\n4 5 6")
    assert [(r.x, r.r, r.g, r.b, r.a) for r in read(p).orderBy("point_id").collect()] == [(1, 1, 1, 1, 1), (4, 1, 1, 1, 1)]


def test_aliases_and_normalised_types(read, tmp_path):
    for names in (("r", "g", "b"), ("diffuse_red", "diffuse_green", "diffuse_blue")):
        table = np.array([(1.0, 2.0, 3.0, 65535, 0, 32768)], np.dtype([("x", "<f8"), ("y", "<f4"), ("z", "<f4"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")]))
        p = save(tmp_path, f"{names[0]}.ply", HEAD.format("binary_little_endian", 1), "property double x\nproperty float32 y\nproperty float z\n", *(f"property ushort {n}\n" for n in names), "end_header\n", table.tobytes())
        r = read(p).first()
        assert (r.x, r.y, r.z, r.r, r.g) == (1, 2, 3, 1, 0) and r.b == pytest.approx(32768 / 65535)


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian"])
@pytest.mark.parametrize("rows", [1, 7, 100, 500, 501, 10000])
def test_ranges_cover_every_row_once(tmp_path, kind, rows):
    rng = random.Random(rows)
    points = [(rng.random(), rng.random(), rng.random(), rng.randint(0, 255), 1, 2) for _ in range(500)]
    path = save(tmp_path, f"{kind}{rows}.ply", ply.ply_bytes(points, kind))
    got = [x for part in ply.ranges(path, rows) for b in ply.read_range(part) for x in b.to_pylist()]
    assert [x["point_id"] for x in got] == list(range(500))
    assert all(abs(x["x"] - p[0]) < 1e-6 and x["r"] == p[3] / 255 for x, p in zip(got, points))


@pytest.mark.parametrize(
    "parts, error",
    [
        ((HEAD.format("ascii", 1), "property list uchar int x\n", "end_header\n"), ply.UnsupportedList),
        ((HEAD.format("binary_big_endian", 1), XYZ, "end_header\n"), ply.UnsupportedFormat),
        ((HEAD.format("ascii", 1), "property float x\nproperty float y\n", "end_header\n1 2\n"), ply.MissingProperty),
        ((HEAD.format("ascii", 1), "property quad x\n", "end_header\n"), ply.UnknownType),
        ((HEAD.format("ascii", 3), XYZ, "end_header\n1 2 3\n"), ply.TruncatedBody),
        ((HEAD.format("binary_little_endian", 3), XYZ, "end_header\n", b"\0" * 30), ply.TruncatedBody),
        (("not a ply",), ply.MissingHeader),
    ],
)
def test_header_and_body_errors(tmp_path, parts, error):
    with pytest.raises(error):
        ply.ranges(save(tmp_path, "e.ply", *parts))


def test_bad_value_names_line_and_property(tmp_path):
    path = save(tmp_path, "v.ply", HEAD.format("ascii", 2), XYZ, "end_header\n1 2 3\n4 oops 6\n")
    with pytest.raises(ply.BadValue, match="line 2 .* y"):
        list(ply.read_range(ply.ranges(path)[0]))


def test_several_files_of_which_a_bad_one_is_left_out(read, tmp_path):
    good = [save(tmp_path, f"g{k}.ply", ply.ply_bytes([(k, 0, 0, 1, 2, 3)] * 5)) for k in (1, 2)]
    bad = save(tmp_path, "bad.ply", "nothing")
    assert read(",".join([good[0], bad, good[1]]), skip_bad_files="true").count() == 10
    with pytest.raises(Exception):
        read(f"{good[0]},{bad}").count()
    assert read(bad, skip_bad_files="true").count() == 0


def test_packed_round_trip_is_within_two_steps(spark, read, tmp_path):
    rng = random.Random(5)
    points = [(rng.random() * 4 - 2, rng.random(), rng.random() * 9, 9, 8, 7) for _ in range(500)]
    p = read(save(tmp_path, "r.ply", ply.ply_bytes(points)))
    cloud = pack.pack(src.with_rgba(p), pack.PackConfig(points_per_batch=64, coarse_divisions=4))
    rows = cloud.points.join(cloud.batches, "batch_id")
    from cloudweave.functions import geometry as g

    words = tuple(F.col(f"xyz_{w}") for w in ("low", "med", "high"))
    got = rows.select("point_id", "batch_id", *(g.decode(k, F.col(f"min_{a}"), F.col(f"max_{a}"), words, F.lit(0)).alias(f"d{a}") for k, a in enumerate("xyz")), *(F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz")).collect()
    assert len(got) == 500
    for r in got:
        for k in range(3):
            assert 0 <= np.float32(points[r.point_id][k]) - r[2 + k] + 1e-9 <= 2 * r[5 + k] / 2**30 + 1e-5


def test_cube_grid(spark):
    assert src.cube_grid(spark, 4).count() == 64 and src.cube_grid(spark, 1).count() == 8
    ends = src.cube_grid(spark, 3).agg(F.min("x"), F.max("z"), F.max("rgba")).first()
    assert tuple(ends) == (-0.5, 0.5, 0xFFFFFFFF)


def test_ids_over_several_files_are_unique_if_asked(read, tmp_path):
    for k, kind in enumerate(("ascii", "binary_little_endian")):
        (tmp_path / f"{k}.ply").write_bytes(ply.ply_bytes([(i, k, 0, 1, 2, 3) for i in range(5)], kind))
    paths = ",".join(str(tmp_path / f"{k}.ply") for k in range(2))
    reader = ply.PlyReader({"path": paths, "unique_ids": "true", "range_rows": "2"})
    got = [(y, i, x) for part in reader.partitions() for b in reader.read(part) for x, y, i in zip(*(b.column(c).to_pylist() for c in ("x", "y", "point_id")))]
    assert sorted(got) == [(k, 5 * k + i, i) for k in range(2) for i in range(5)]
    plain = ply.PlyReader({"path": paths})
    assert sorted(i for part in plain.partitions() for b in plain.read(part) for i in b.column("point_id").to_pylist()) == sorted([*range(5)] * 2)
