"""python -m cloudweave.cli --ply FILE [--ply FILE ...] --out FOLDER: packs PLY files and renders them from one camera."""

from __future__ import annotations

import argparse
import os


def existing(paths: list[str]) -> list[str]:
    """Paths that are there; of other file systems than the local one all are taken to be."""
    return [p for p in paths if "://" in p or os.path.isfile(p)]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--ply", action="append", default=[], metavar="FILE")
    parser.add_argument("--out", required=True, metavar="FOLDER")
    parser.add_argument("--size", type=int, default=512)
    parser.add_argument("--points-per-batch", type=int, default=10240)
    given = parser.parse_args(args)
    paths = existing(given.ply)
    if not paths:
        parser.error("no PLY file is there")

    from pyspark.sql import SparkSession

    from cloudweave.model import Camera, PackConfig, RasterConfig, look_at, perspective
    from cloudweave.operators import pack
    from cloudweave.operators.scene import Scene
    from cloudweave.sources import ply, points

    spark = SparkSession.builder.getOrCreate()
    scene = Scene(RasterConfig(width=given.size, height=given.size))
    clouds = {p: points.with_rgba(ply.load(spark, [p], skip_bad_files=True)) for p in paths}
    for name, cloud in clouds.items():
        scene.add(name, cloud, packing=PackConfig(points_per_batch=given.points_per_batch))
    b = pack.union_bounds(list(clouds.values())).first()
    if b["min_x"] is None:
        parser.error("no file could be read")
    centre = tuple((b[f"min_{a}"] + b[f"max_{a}"]) / 2 for a in "xyz")
    reach = max(b[f"max_{a}"] - b[f"min_{a}"] for a in "xyz") or 1.0
    camera = Camera(look_at((centre[0], centre[1], centre[2] + 2.4 * reach), centre), perspective(45.0, 1.0, 0.01 * reach, 100.0 * reach))
    scene.render(camera).write.mode("overwrite").parquet(given.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
