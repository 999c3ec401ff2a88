"""Affine maps as tuples (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f."""

from __future__ import annotations

import math

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def translation(x: float, y: float) -> Matrix:
    return (1.0, 0.0, 0.0, 1.0, x, y)


def scaling(x: float, y: float) -> Matrix:
    return (x, 0.0, 0.0, y, 0.0, 0.0)


def rotation(degrees: float) -> Matrix:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (c, s, -s, c, 0.0, 0.0)


def concat(first: Matrix, then: Matrix) -> Matrix:
    """``first`` applied to a point, then ``then``."""
    a, b, c, d, e, f = first
    g, h, i, j, k, m = then
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m)


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def determinant(m: Matrix) -> float:
    return m[0] * m[3] - m[1] * m[2]


def scale_factor(m: Matrix) -> float:
    return math.sqrt(abs(determinant(m)))


def inverse(m: Matrix) -> Matrix | None:
    d = determinant(m)
    if d == 0:
        return None
    a, b, c, e, x, y = m
    return (e / d, -b / d, -c / d, a / d, (c * y - e * x) / d, (b * x - a * y) / d)


def display(box: tuple[float, float, float, float], turn: int, scale: float = 1.0) -> tuple[Matrix, float, float]:
    """From user space to a screen whose y grows down, with the width and height shown."""
    x0, y0, x1, y1 = box
    w, h = x1 - x0, y1 - y0
    flip = (1.0, 0.0, 0.0, -1.0, -x0, h + y0)
    exact = {0: IDENTITY, 90: (0.0, 1.0, -1.0, 0.0, h, 0.0), 180: (-1.0, 0.0, 0.0, -1.0, w, h), 270: (0.0, -1.0, 1.0, 0.0, 0.0, w)}
    m = concat(concat(flip, exact[turn]), scaling(scale, scale))
    return m, (h if turn % 180 else w) * scale, (w if turn % 180 else h) * scale
