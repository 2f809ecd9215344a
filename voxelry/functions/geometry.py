"""Geometry as column expressions, and the few steps that the driver does once in NumPy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RING, SECTOR = 5.0, math.radians(5.0)


def rotation_to_vertical(normal: tuple[float, float, float]) -> np.ndarray:
    """The rotation that takes ``normal`` to +z, by Rodrigues' formula; half a turn if it points down."""
    a = np.asarray(normal, float) / np.linalg.norm(normal)
    b = np.array([0.0, 0.0, 1.0])
    c = float(a @ b)
    if c > 1 - 1e-10:
        return np.eye(3)
    if c < -1 + 1e-10:
        axis = np.array([1.0, 0.0, 0.0])
        return 2 * np.outer(axis, axis) - np.eye(3)
    v = np.cross(a, b)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def rotated(r: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The three coordinates after rotation; linear, so they stay inside code generation."""
    return tuple(x * F.lit(float(a)) + y * F.lit(float(b)) + z * F.lit(float(c)) for a, b, c in r)


def horizontal_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def ring_bin(x: Column, y: Column) -> Column:
    return F.floor(horizontal_range(x, y) / F.lit(RING)).cast("bigint")


def sector_bin(x: Column, y: Column) -> Column:
    return F.floor((F.atan2(y, x) + F.lit(math.pi)) / F.lit(SECTOR)).cast("bigint")


def float_cell(v: Column, origin: Column, cell: float) -> Column:
    """Cell of a FLOAT coordinate in FLOAT arithmetic, as a 32-bit division gives it."""
    return ((v - origin) / F.lit(float(np.float32(cell)))).cast("float").cast("int")


def finite(c: Column) -> Column:
    """0 for null, NaN and infinite values."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def eigen2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, c]], larger first."""
    mid, off = (a + c) / 2, F.sqrt(F.pow((a - c) / 2, F.lit(2.0)) + b * b)
    return mid + off, mid - off


def axis2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Unit eigenvector of the larger eigenvalue; the longer coordinate axis if b is 0."""
    big, _ = eigen2(a, b, c)
    flat = F.abs(b) < 1e-12
    x = F.when(flat, F.when(a >= c, 1.0).otherwise(0.0)).otherwise(b)
    y = F.when(flat, F.when(a >= c, 0.0).otherwise(1.0)).otherwise(big - a)
    n = F.sqrt(x * x + y * y)
    return x / n, y / n


def affine_colour(v: Column, low: float, high: float) -> Column:
    """Position of a value between two bounds, clipped to 0..1, as colour maps use."""
    return F.least(F.greatest((v - F.lit(low)) / F.lit(high - low), F.lit(0.0)), F.lit(1.0))
