"""A scene: named clouds, one configuration, and cached selections."""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.model import IDENTITY, Camera, Cloud, Matrix, PackConfig, RasterConfig
from cloudweave.operators import features, pack, raster, resolve, select
from cloudweave.operators.history import DisplacementHistory
from cloudweave.operators.tables import shared_folder
from cloudweave.operators.versions import Versions
from cloudweave.streaming.sweep import DurableSweep, EvenSizes, SelectCache

#: Images of more pixels are not brought to the driver as a picture.
PICTURE_PIXELS = 1 << 26


class Scene:
    """Clouds by name, in the order in which they were added; packed ones are selected for each camera.

    A cloud that is replaced keeps its name and place, and its generation goes up, so cached selections of it are not
    used again. With lod_points_per_frame packed clouds are swept: each frame of a view selects some batches, as its
    camera sees them, and draws the last complete sweep. folder: where sweeps are kept; a scene on the same folder goes
    on with them.
    """

    def __init__(self, config: RasterConfig = RasterConfig(), folder: str | None = None) -> None:
        self.config = config
        self._folder = folder
        self._clouds: dict[str, Cloud] = {}
        self._packed: dict[str, pack.PackedCloud] = {}
        self._generation: dict[str, int] = {}
        self._seen: dict[str, Camera] = {}
        self._moves: dict[str, Column] = {}
        self._history: DisplacementHistory | None = None
        self.cache = SelectCache()

    def add(self, name: str, points: DataFrame, model: Matrix = IDENTITY, visible: bool = True, packing: PackConfig | None = None) -> None:
        """Adds a cloud, or replaces the one of that name. With packing, points need point_id and are packed now."""
        if packing:
            self._packed[name] = pack.pack(points, packing)
        else:
            self._packed.pop(name, None)
        self._clouds[name] = Cloud(points if "src_idx" in points.columns or "point_id" not in points.columns else points.withColumn("src_idx", F.col("point_id")), model, name, visible)
        self._generation[name] = self._generation.get(name, -1) + 1
        self._forget(name)

    def remove(self, name: str) -> None:
        for table in (self._clouds, self._packed):
            table.pop(name, None)
        self._forget(name)

    def _forget(self, name: str) -> None:
        """Deletes what is kept of a cloud that goes or is replaced."""
        self._moves.pop(name, None)
        self.cache.forget(name)
        if self._history:
            self._history.forget(cloud=name)

    def show(self, name: str, visible: bool) -> None:
        self._clouds[name] = replace(self._clouds[name], visible=visible)

    def move(self, name: str, model: Matrix) -> None:
        """Sets where a cloud stands; where it stood is kept for motion."""
        c = self._clouds[name]
        self._clouds[name] = replace(c, model=model, previous_model=c.model)

    def displace(self, name: str, delta: Column | None) -> None:
        """Sets how a cloud's points move from now on: a struct of dx, dy, dz of each point; None: not at all.

        With motion blur, each view remembers where its last frame had them; a cloud that isn't packed is stored once in
        the buckets of that memory.
        """
        if delta is None:
            self._moves.pop(name, None)
            return
        if name not in self._moves and name not in self._packed and self.config.motion_blur > 0:
            c = self._clouds[name]
            self._clouds[name] = replace(c, points=self._memory(c.points).bucketed(name, c.points))
        self._moves[name] = delta

    def _memory(self, points: DataFrame) -> DisplacementHistory:
        if self._history is None:
            self._history = DisplacementHistory(points.sparkSession)
        return self._history

    def _moved(self, cloud: Cloud, view: str) -> Cloud:
        """A cloud with its displacement of this frame, and, for motion, that of the view's last one."""
        if cloud.name not in self._moves or not self.config.apply_displacement:
            return cloud
        points = features.with_displacement(cloud.points, self._moves[cloud.name])
        if self.config.motion_blur > 0:
            memory = self._memory(points)
            now, points = points, memory.with_former(view, cloud.name, points)
            memory.snapshot(view, cloud.name, now)
        return replace(cloud, points=points)

    def resize(self, width: int, height: int, render_scale: float | None = None) -> None:
        self.config = self.config.but(width=width, height=height, render_scale=render_scale or self.config.render_scale)

    @property
    def clouds(self) -> list[str]:
        return list(self._clouds)

    @property
    def visible_clouds(self) -> list[str]:
        return [n for n, c in self._clouds.items() if c.is_visible]

    def generation(self, name: str) -> int:
        return self._generation[name]

    def selected(self, camera: Camera, view: str = "main") -> list[Cloud]:
        """The visible clouds as they are drawn; selections of packed ones come from the cache where nothing changed, or from
        the last complete sweep."""
        out = []
        for name in self.visible_clouds:
            c = self._clouds[name]
            if name in self._packed and self.config.lod_points_per_frame > 0:
                swept = self.sweep(name, camera, view)
                swept.advance(self.config)
                if (points := swept.front) is None:
                    continue  # a cloud without points
                c = replace(c, points=points)
            elif name in self._packed:
                points = self.cache.get(name, self._generation[name], camera, self.config, c.model, lambda n=name, m=c.model: select.kept_selection(self._packed[n], camera, self.config, m))
                c = replace(c, points=points)
            out.append(c)
        return out

    def sweep(self, name: str, camera: Camera, view: str = "main") -> DurableSweep:
        """A cloud's sweep for a view, as the next frame of this camera goes on with it."""
        packed, model = self._packed[name], self._clouds[name].model
        if self._folder is None:
            self._folder = f"{shared_folder(packed.batches.sparkSession)}/cloudweave/sweeps-{uuid.uuid4().hex}"
        points = packed.batches.agg(F.sum("num_points").alias("n"), F.max(F.when(F.col("num_points") < packed.config.points_per_batch, F.col("new_id"))).alias("short")).first()

        def chosen(first: int, stop: int) -> DataFrame:
            part = replace(packed, batches=packed.batches.where((F.col("new_id") >= first) & (F.col("new_id") < stop)))
            return select.selected_points(part, camera, self.config, model)

        folder = "-".join(zlib.crc32(n.encode()).to_bytes(4, "big").hex() for n in (name, view))
        sizes = EvenSizes(points["n"] or 0, packed.config.points_per_batch, points["short"])
        return DurableSweep(Versions(packed.batches.sparkSession, f"{self._folder}/{folder}"), sizes, chosen, self.config.lod_points_per_frame, f"{name} {self._generation[name]}")

    def render(self, camera: Camera, camera_then: Camera | None = None, view: str = "main") -> DataFrame:
        """The image of a frame; motion is measured from the last frame of the same view, if no other camera is given."""
        then, self._seen[view] = camera_then or self._seen.get(view), camera
        return resolve.render([self._moved(c, view) for c in self.selected(camera, view)], camera, self.config, then)

    def forget(self, view: str = "main") -> None:
        """The next frame of a view has none before it."""
        self._seen.pop(view, None)
        if self._history:
            self._history.forget(view)

    def pick(self, name: str, ndc: tuple[float, float], camera: Camera, radius: int = 10) -> int | None:
        """The src_idx of a cloud's point at a place on screen."""
        cloud = next((c for c in self.selected(camera) if c.name == name), None)
        if cloud is None:
            return None
        winners = raster.nearest_winners(raster.project(cloud.points, camera, self.config, cloud.model), self.config, camera)
        found = resolve.pick(winners, ndc, self.config, radius).first()
        return found["src_idx"] if found else None


def png(image: DataFrame, config: RasterConfig) -> bytes:
    """A picture of an image (8 bits, with alpha); the driver gets at most a row for each of PICTURE_PIXELS pixels."""
    width, height = config.size
    if width * height > PICTURE_PIXELS:
        raise ValueError("the image is too large for a picture")
    rows = resolve.bytes_image(image).select("px", "py", "ri", "gi", "bi", "ai").toPandas()
    pixels = np.zeros((height, width, 4), np.uint8)
    pixels[rows["py"], rows["px"]] = rows[["ri", "gi", "bi", "ai"]]
    raw = b"".join(b"\0" + line.tobytes() for line in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
