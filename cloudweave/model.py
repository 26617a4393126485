"""Configuration, cameras and schemas."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np

#: Column-major 4x4 matrices, as 16 numbers.
Matrix = tuple[float, ...]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)

RAW_POINTS = "point_id bigint, x double, y double, z double, r double, g double, b double, a double"
CHUNK_DELTA = "seq bigint, op string, chunk_id string, depth int, num_points int"


class RenderMode(Enum):
    AVERAGE = "average"
    NEAREST = "nearest"


class PointSize(Enum):
    SCREEN = "screen"
    WORLD = "world"


def _array(m: Matrix) -> np.ndarray:
    return np.array(m, float).reshape(4, 4).T


def _matrix(a: np.ndarray) -> Matrix:
    return tuple(float(v) + 0.0 for v in a.T.reshape(-1))


def multiply(*ms: Matrix) -> Matrix:
    out = np.eye(4)
    for m in ms:
        out = out @ _array(m)
    return _matrix(out)


def inverse(m: Matrix) -> Matrix:
    return _matrix(np.linalg.inv(_array(m)))


def scale_translate(scale: tuple[float, float, float], shift: tuple[float, float, float]) -> Matrix:
    """p * scale + shift."""
    a = np.diag([*scale, 1.0])
    a[:3, 3] = shift
    return _matrix(a)


def perspective(fov_degrees: float, aspect: float, near: float, far: float) -> Matrix:
    """Reverse-Z: the near plane has depth 1, the far plane 0, so a larger depth is nearer."""
    f = 1.0 / math.tan(math.radians(fov_degrees) / 2)
    a = np.zeros((4, 4))
    a[0, 0], a[1, 1] = f / aspect, f
    a[2, 2], a[2, 3], a[3, 2] = near / (far - near), far * near / (far - near), -1.0
    return _matrix(a)


def orthographic(width: float, height: float, near: float, far: float) -> Matrix:
    a = np.diag([2 / width, 2 / height, 1 / (far - near), 1.0])
    a[2, 3] = far / (far - near)
    return _matrix(a)


def look_at(eye: tuple[float, float, float], target: tuple[float, float, float] = (0.0, 0.0, 0.0), up: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> Matrix:
    back = np.array(eye, float) - np.array(target, float)
    back /= np.linalg.norm(back)
    right = np.cross(up, back)
    right /= np.linalg.norm(right)
    a = np.eye(4)
    a[0, :3], a[1, :3], a[2, :3] = right, np.cross(back, right), back
    a[:3, 3] = -a[:3, :3] @ np.array(eye, float)
    return _matrix(a)


@dataclass(frozen=True)
class Camera:
    """A view and a projection. Orthographic projections have 1 as their last number."""

    view: Matrix
    projection: Matrix

    @property
    def is_orthographic(self) -> bool:
        return self.projection[15] == 1.0

    def clip(self, model: Matrix = IDENTITY) -> Matrix:
        return multiply(self.projection, self.view, model)

    @property
    def inverse_projection(self) -> Matrix:
        return inverse(self.projection)


def standard_camera(eye: tuple[float, float, float] = (0.0, 0.0, 2.4), target: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Camera:
    return Camera(look_at(eye, target), perspective(45.0, 1.0, 0.01, 100.0))


@dataclass(frozen=True)
class PackConfig:
    """points_per_batch up to 65535; lod_levels 1 to 8; coarse_divisions at least 1."""

    points_per_batch: int = 10240
    lod_levels: int = 4
    coarse_divisions: int = 64
    shuffle_batches: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.points_per_batch <= 65535:
            raise ValueError("points_per_batch must be 1 to 65535")
        object.__setattr__(self, "lod_levels", min(8, max(1, self.lod_levels)))
        object.__setattr__(self, "coarse_divisions", max(1, self.coarse_divisions))


@dataclass(frozen=True)
class RasterConfig:
    """How selected points become an image; one frozen value for each query."""

    width: int = 256
    height: int = 256
    render_mode: RenderMode = RenderMode.AVERAGE
    depth_tolerance: float = 0.01
    background: tuple[float, float, float] = (0.0, 0.0, 0.0)
    enable_frustum_culling: bool = True
    lod_bias: int = 0
    enable_clod: bool = True
    enable_lod_dither: bool = True
    hole_fill_iterations: int = 0
    colorize_chunks: bool = False
    colorize_overdraw: bool = False
    point_size_mode: PointSize = PointSize.SCREEN
    minimum_point_size: float = 1.0
    maximum_point_size: float = 5.0
    point_size_scale: float = 5.0
    apply_displacement: bool = False
    apply_tint: bool = False
    tint_alpha_is_coverage: bool = False
    writes_scene_depth: bool = True
    motion_blur: float = 0.0
    motion_blur_samples: int = 8
    motion_blur_max_spread: float = 64.0
    #: Accepted and without effect: partial aggregation is always on.
    enable_simd_aggregation: bool = True
    lod_points_per_frame: int = 0
    enable_point_rejection: bool = False
    rejection_cone_threshold: float = 0.5
    point_edge_antialiasing: bool = False
    render_scale: float = 1.0

    @property
    def size(self) -> tuple[int, int]:
        """Width and height in the supersampled image."""
        s = max(1.0, self.render_scale)
        return max(1, int(self.width * s)), max(1, int(self.height * s))

    @property
    def oit(self) -> bool:
        """Whether translucent points are blended without a depth test."""
        return self.motion_blur > 0 or (self.apply_tint and self.tint_alpha_is_coverage)

    def but(self, **changes) -> RasterConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class Cloud:
    """Points of a scene: a DataFrame with x, y, z, rgba, and where the cloud stands in the world."""

    points: object
    model: Matrix = IDENTITY
    name: str = "cloud"
    visible: bool = True
    previous_model: Matrix | None = None
    parents: tuple = field(default_factory=tuple)

    @property
    def is_visible(self) -> bool:
        return self.visible and all(p.is_visible for p in self.parents)
