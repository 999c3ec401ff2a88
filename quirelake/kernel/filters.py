"""Stream filters: bytes to bytes, each by itself, and the chain of a stream's dictionary."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np

#: Short names of filters, and filters whose output is an image.
ALIASES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}
IMAGE_FILTERS = {"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"}


def flate_decode(data: bytes) -> bytes:
    """zlib data; what decodes before damage or a cut is returned, and nothing at all is an error."""
    worker = zlib.decompressobj()
    out = bytearray()
    try:
        out += worker.decompress(data)
        out += worker.flush()
    except zlib.error:
        if not out:
            worker, step = zlib.decompressobj(), 64
            for at in range(0, len(data), step):
                try:
                    out += worker.decompress(data[at : at + step])
                except zlib.error:
                    break
        if not out:
            raise
    return bytes(out)


def flate_encode(data: bytes, level: int = 6) -> bytes:
    return zlib.compress(data, level)


def ascii_hex_decode(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


_NOT_85 = bytes(c for c in range(256) if not 0x21 <= c <= 0x75)


def ascii85_decode(data: bytes) -> bytes:
    """Groups of five at once; data with ``z`` is read digit by digit, as it counts between groups alone."""
    data = data.partition(b"~")[0]
    if b"z" not in data:
        digits = data.translate(None, _NOT_85)
        rest = len(digits) % 5
        if rest == 1:
            digits, rest = digits[:-1], 0
        filled = digits + b"u" * (-len(digits) % 5)
        groups = np.frombuffer(filled, np.uint8).reshape(-1, 5).astype(np.uint64) - np.uint64(0x21)
        values = groups @ np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)
        out = (values & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes()
        return out[: len(out) - 5 + rest] if rest else out
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _base85(group)
                group = []
    if len(group) > 1:
        n = len(group) - 1
        out += _base85(group + [84] * (5 - len(group)))[:n]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    value = 0
    for g in group:
        value = value * 85 + g
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


#: Records of two bytes in a row: a single byte, or a byte that repeats.
_PAIRS = re.compile(rb"(?:[\x00\x81-\xff].)+", re.DOTALL)


def run_length_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (n := data[at]) != 128:
        if 0 < n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif m := _PAIRS.match(data, at):
            pairs = np.frombuffer(m[0], np.uint8).reshape(-1, 2)
            out += np.repeat(pairs[:, 1], np.where(pairs[:, 0] == 0, 1, 257 - pairs[:, 0].astype(np.int64))).tobytes()
            at = m.end()
        else:  # cut behind the first byte of a record
            break
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        out += _literals(data[at : m.start()])
        out += bytes([257 - len(m[0]), m[0][0]])
        at = m.end()
    return bytes(out + _literals(data[at:]) + b"\x80")


def _literals(data: bytes) -> bytes:
    return b"".join(bytes([len(p) - 1]) + p for p in (data[i : i + 128] for i in range(0, len(data), 128)))


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """Variable-width LZW, 9 to 12 bits, most significant bit first."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, at = list(first), 9, 0, 0, 0
    out, before = [], None
    while True:
        if bits < width:
            if bits + 8 * (len(data) - at) < width:
                break
            part = data[at : at + 32]
            held, bits, at = held << 8 * len(part) | int.from_bytes(part, "big"), bits + 8 * len(part), at + len(part)
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code < 256 or code > 257:
            if before is None:
                if code > 255:
                    raise ValueError("LZW code before its entry")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(before + entry[:1])
            elif code == len(table):
                entry = before + before[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            before = entry
            # the decoder's table lags one entry behind the encoder's
            if width < 12 and len(table) + early >= 1 << width:
                width += 1
        elif code == 257:
            break
        else:
            table, width, before = list(first), 9, None
    return b"".join(out)


def predict(data: bytes, parms: dict[str, Any]) -> bytes:
    """Undo the predictor of Flate and LZW parameters."""
    kind = int(parms.get("Predictor") or 1)
    colors, depth, columns = (int(parms.get(k) or d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind <= 1:
        return data
    if kind == 2:
        return tiff_predictor(data, colors, depth, columns)
    return png_predictor(data, colors, depth, columns)


def tiff_predictor(data: bytes, colors: int, depth: int, columns: int) -> bytes:
    """Differences along rows for 8 and 16 bits; other depths stay as they are."""
    if depth not in (8, 16):
        return data
    size = depth // 8
    row = colors * columns * size
    whole = len(data) // row * row if row else 0
    x = np.frombuffer(data[:whole], ">u2" if size == 2 else "u1").reshape(-1, columns, colors)
    out = np.cumsum(x, axis=1, dtype=np.uint64).astype(x.dtype).tobytes()
    return out + data[whole:]


def png_predictor(data: bytes, colors: int, depth: int, columns: int) -> bytes:
    """Row filters None, Sub, Up, Average and Paeth; unknown ones count as None, a cut last row goes."""
    left = max(1, colors * depth // 8)
    row = (colors * depth * columns + 7) // 8
    count = max(0, -(-(len(data) - row) // (row + 1)))
    rows = np.frombuffer(data[: count * (row + 1)], np.uint8).reshape(count, row + 1)
    if count and (rows[:, 0] == 2).all():
        return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8).tobytes()
    above, out = bytearray(row), bytearray()
    for at in range(0, len(data) - row, row + 1):
        kind, now = data[at], bytearray(data[at + 1 : at + 1 + row])
        if kind == 1:
            for i in range(left, row):
                now[i] = (now[i] + now[i - left]) & 0xFF
        elif kind == 2:
            now = bytearray((np.frombuffer(now, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif kind == 3:
            for i in range(row):
                now[i] = (now[i] + ((now[i - left] if i >= left else 0) + above[i]) // 2) & 0xFF
        elif kind == 4:
            for i in range(row):
                a, c = (now[i - left], above[i - left]) if i >= left else (0, 0)
                now[i] = (now[i] + paeth(a, above[i], c)) & 0xFF
        out += now
        above = now
    return bytes(out)


def paeth(a: int, b: int, c: int) -> int:
    """The neighbour nearest to a + b - c: left before above before above left."""
    return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]


def _lzw(data: bytes, parms: dict[str, Any]) -> bytes:
    early = parms.get("EarlyChange")
    return predict(lzw_decode(data, 1 if early is None else int(early)), parms)


DECODERS: dict[str, Callable[[bytes, dict[str, Any]], bytes]] = {
    "FlateDecode": lambda d, p: predict(flate_decode(d), p),
    "LZWDecode": _lzw,
    "ASCIIHexDecode": lambda d, p: ascii_hex_decode(d),
    "ASCII85Decode": lambda d, p: ascii85_decode(d),
    "RunLengthDecode": lambda d, p: run_length_decode(d),
    "Crypt": lambda d, p: d,
}


def decode(data: bytes, filters: list[str], parms: list[dict[str, Any]]) -> tuple[bytes, str | None, str | None]:
    """Run a chain: the bytes, the image codec that ended it, and what went wrong.

    A filter that fails or is not known ends the chain with what there is so far.
    """
    for i, raw in enumerate(filters):
        kind = ALIASES.get(raw, raw)
        if kind in IMAGE_FILTERS:
            return data, kind, None
        if kind not in DECODERS:
            return data, None, f"unknown filter {kind}"
        try:
            data = DECODERS[kind](data, parms[i] if i < len(parms) else {})
        except (ValueError, zlib.error, IndexError) as e:
            return data, None, f"{kind}: {e}"
    return data, None, None
