"""Stream filters as Arrow functions, for those that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F

from ..kernel import filters as kernel


def _binary(run: Callable[[bytes], bytes]) -> Callable:
    @F.arrow_udf("binary")
    def apply(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else run(x) for x in data.to_pylist()], pa.binary())

    return apply


def flate_decode():
    return _binary(kernel.flate_decode)


def flate_encode(level: int = 6):
    return _binary(lambda d: kernel.flate_encode(d, level))


def ascii85_decode():
    return _binary(kernel.ascii85_decode)


def run_length_decode():
    return _binary(kernel.run_length_decode)


def run_length_encode():
    return _binary(kernel.run_length_encode)


def lzw_decode(early: int = 1):
    return _binary(lambda d: kernel.lzw_decode(d, early))


def predict(predictor: int, colors: int = 1, bits: int = 8, columns: int = 1):
    parms = {"Predictor": predictor, "Colors": colors, "BitsPerComponent": bits, "Columns": columns}
    return _binary(lambda d: kernel.predict(d, parms))
