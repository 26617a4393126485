import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.sources import ply
from cloudweave.sources import points as src

HEAD = "ply\nformat ascii 1.0\n{more}element vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty float w\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"


def ascii_file(path, rows, tail="3 0 1 2\n", more="", end="\n", blank=" ", n=None):
    body = "".join(blank.join(map(str, r)) + end for r in rows)
    path.write_bytes((HEAD.format(n=len(rows) if n is None else n, more=more) + body + tail).encode())
    return str(path)


def made(rng, n):
    return [(*(round(rng.uniform(-9, 9), rng.randint(0, 7)) for _ in range(3)), rng.randrange(256), rng.choice(["nan", "1e3", "-0.5"])) for _ in range(n)]


def want(path, rows, first=0):
    return [(path, first + k, *(float(np.float32(v)) for v in r[:3]), r[3] / 255) for k, r in enumerate(rows)]


def got(df):
    return sorted(tuple(r)[:6] for r in df.collect())


@pytest.mark.parametrize("range_bytes", [7, 40, 333, 1 << 20])
def test_lines_come_once_whatever_the_ranges(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    kinds = [{"end": "\r\n"}, {"blank": "  "}, {"end": " \n"}, {"tail": ""}, {"more": "comment end_header is not here\ncomment x\n"}, {}]
    files = {}
    for k, kind in enumerate(kinds):
        rows = made(rng, rng.randint(1, 25))
        files[ascii_file(tmp_path / f"{k}.ply", rows, **kind)] = rows
    open_end = made(rng, 4)
    path = ascii_file(tmp_path / "open.ply", open_end, tail="")
    (tmp_path / "open.ply").write_bytes((tmp_path / "open.ply").read_bytes()[:-1])
    files[path] = open_end
    binary = [(0.5, -1.25, k, k % 256, 0, 0) for k in range(100)]
    (tmp_path / "b.ply").write_bytes(ply.ply_bytes(binary))
    files[str(tmp_path / "b.ply")] = binary
    (tmp_path / "none.ply").write_bytes(ply.ply_bytes([], "ascii"))
    files[str(tmp_path / "none.ply")] = []
    assert got(ply.load(spark, list(files), range_bytes=range_bytes, rows=17)) == sorted(r for p, rows in files.items() for r in want(p, rows))
    ids, at = [], 0
    for p, rows in files.items():
        ids += want(p, rows, at)
        at += len(rows)
    assert got(ply.load(spark, [f for f in files], unique_ids=True, range_bytes=range_bytes)) == sorted(ids)


def test_a_bad_value_sets_its_file_aside_whole(spark, tmp_path, caplog):
    rng = random.Random(2)
    rows = made(rng, 300)
    good = ascii_file(tmp_path / "good.ply", rows)
    worse = [*rows[:250], ("1.0", "x", "2", "3", "4"), *rows[251:]]
    bad = [
        ascii_file(tmp_path / "value.ply", worse),
        ascii_file(tmp_path / "field.ply", [*rows[:40], (1.0, 2.0)]),
        ascii_file(tmp_path / "short.ply", rows[:5], tail="", n=9),
        ascii_file(tmp_path / "blank.ply", [*rows[:3], ("",), *rows[3:]]),
        str(tmp_path / "missing.ply"),
    ]
    (tmp_path / "cut.ply").write_bytes(ply.ply_bytes([(0.0, 0.0, 0.0, 1, 2, 3)] * 9)[:-1])
    (tmp_path / "not.ply").write_bytes(b"x" * 300_000)
    bad += [str(tmp_path / "cut.ply"), str(tmp_path / "not.ply")]
    with caplog.at_level("WARNING", "cloudweave"):
        assert got(ply.load(spark, [bad[0], good, *bad[1:]], skip_bad_files=True, unique_ids=True, range_bytes=500)) == sorted(want(good, rows))
    assert len(caplog.records) == len(bad)
    for path, error in ((bad[2], ply.TruncatedBody), (bad[5], ply.TruncatedBody), (bad[6], ply.MissingHeader), (bad[4], OSError)):
        with pytest.raises(error):
            ply.load(spark, [good, path])
    with pytest.raises(Exception, match="line 251 of the body has no number for y"):
        ply.load(spark, [bad[0]], range_bytes=500).collect()


def test_long_headers(spark, tmp_path):
    rows = made(random.Random(1), 5)
    path = ascii_file(tmp_path / "long.ply", rows, more="comment " + "c" * 2_000_000 + "\n")
    assert got(ply.load(spark, [path])) == sorted(want(path, rows))
    ply.register(spark)
    assert got(spark.read.format("ply").load(path)) == sorted(want(path, rows))


def test_what_is_saved_is_read(spark, tmp_path):
    points = src.cube_grid(spark, 9)
    told = []
    for kind in ("ascii", "binary_little_endian"):
        files = ply.save(points.repartition(3), str(tmp_path / kind), kind, rows=100).collect()
        assert sum(f.points for f in files) == 729 and max(f.points for f in files) <= 100
        back = ply.load(spark, [f.path for f in files], range_bytes=600)
        told.append(sorted(tuple(r) for r in back.select("x", "y", "z", "r", "g", "b").collect()))
    plain = points.select(*(F.col(a).cast("float").cast("double").alias(a) for a in "xyz"), *((F.shiftright("rgba", s).bitwiseAND(F.lit(255).cast("bigint")) / 255).alias(n) for n, s in (("r", 0), ("g", 8), ("b", 16))))
    assert told[0] == told[1] == sorted(map(tuple, plain.collect()))
