"""Planes, cameras and rigid transforms as column arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c

Vec = tuple[Column, Column, Column]


def vec(*names) -> Vec:
    return tuple(_c(n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Vec, b: Vec) -> Vec:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def height_above(p: Vec, c: Vec, n: Vec) -> Column:
    return dot(minus(p, c), n)


def mirror(p: Vec, h: Column, n: Vec) -> Vec:
    return (p[0] - h * 2.0 * n[0], p[1] - h * 2.0 * n[1], p[2] - h * 2.0 * n[2])


def project(p: Vec, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pinhole projection to fractional pixel coordinates."""
    return p[0] / p[2] * _c(fx) + _c(cx), p[1] / p[2] * _c(fy) + _c(cy)


def ray(y, x, fx, fy, cx, cy) -> Vec:
    return ((_c(x) - _c(cx)) / _c(fx), (_c(y) - _c(cy)) / _c(fy), F.lit(1.0))


def ray_plane_depth(r: Vec, c: Vec, n: Vec) -> Column:
    slope = dot(r, n)
    return dot(c, n) / F.when(F.abs(slope) < 1e-6, F.lit(1e-6)).otherwise(slope)
