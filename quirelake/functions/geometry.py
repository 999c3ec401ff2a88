"""Affine maps as struct columns (a, b, c, d, e, f), all in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = "abcdef"


def _num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def matrix(*parts: Column | float) -> Column:
    return F.struct(*[_num(p).cast("double").alias(n) for p, n in zip(parts, _PARTS, strict=True)])


def identity() -> Column:
    return matrix(1, 0, 0, 1, 0, 0)


def translation(x: Column | float, y: Column | float) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def scaling(x: Column | float, y: Column | float) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def rotation(degrees: Column | float) -> Column:
    turn = F.radians(_num(degrees))
    return matrix(F.cos(turn), F.sin(turn), -F.sin(turn), F.cos(turn), 0, 0)


def concat(first: Column, then: Column) -> Column:
    """``first`` applied to a point, then ``then``."""
    p, q = first, then
    return matrix(
        p["a"] * q["a"] + p["b"] * q["c"], p["a"] * q["b"] + p["b"] * q["d"], p["c"] * q["a"] + p["d"] * q["c"], p["c"] * q["b"] + p["d"] * q["d"],
        p["e"] * q["a"] + p["f"] * q["c"] + q["e"], p["e"] * q["b"] + p["f"] * q["d"] + q["f"],
    )


def apply(m: Column, x: Column | float, y: Column | float) -> Column:
    x, y = _num(x), _num(y)
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def scale_factor(m: Column) -> Column:
    return F.sqrt(F.abs(determinant(m)))


def inverse(m: Column) -> Column:
    """Null where the determinant is 0."""
    d = determinant(m)
    made = matrix(m["d"] / d, -m["b"] / d, -m["c"] / d, m["a"] / d, (m["c"] * m["f"] - m["d"] * m["e"]) / d, (m["b"] * m["e"] - m["a"] * m["f"]) / d)
    return F.when(d != 0, made)


def to_array(m: Column) -> Column:
    return F.array(*[m[p] for p in _PARTS])


def to_text(m: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(to_array(m), lambda v: F.round(v, 4).cast("string")), " "), F.lit("]"))


def quarter_turn(degrees: Column) -> Column:
    """The nearest quarter turn, halves upwards, from 0 to 270."""
    return F.pmod(F.floor(degrees / 90 + F.lit(0.5)) * 90, F.lit(360)).cast("int")


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle with its corners in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def display(crop_box: Column, rotate: Column, scale: Column | float = 1.0) -> Column:
    """From user space to a screen whose y grows down: struct of matrix, width and height."""
    w, h, s = crop_box["x1"] - crop_box["x0"], crop_box["y1"] - crop_box["y0"], _num(scale)
    x0, y0 = crop_box["x0"], crop_box["y0"]
    # the flipped page at its origin is x - x0, h - (y - y0)
    m = (
        F.when(rotate == 90, matrix(0 * s, s, s, 0 * s, -y0 * s, -x0 * s))
        .when(rotate == 180, matrix(-s, 0 * s, 0 * s, s, (w + x0) * s, -y0 * s))
        .when(rotate == 270, matrix(0 * s, -s, -s, 0 * s, (h + y0) * s, (w + x0) * s))
        .otherwise(matrix(s, 0 * s, 0 * s, -s, -x0 * s, (h + y0) * s))
    )
    swap = rotate.isin(90, 270)
    return F.struct(m.alias("matrix"), (F.when(swap, h).otherwise(w) * s).alias("width"), (F.when(swap, w).otherwise(h) * s).alias("height"))
