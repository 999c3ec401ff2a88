"""SentencePiece encoding and decoding of whole texts, with every piece projected to the bytes it came from.

The model's normaliser runs here and records where each normalised byte came from: user-defined symbols first, then the longest
prefix in the compiled character map (a double-array trie with its replacements), else one character as it is; spaces are
collapsed and escaped as the model says. The normalised bytes are cut before space symbols where no piece of the vocabulary
could cross, each distinct part of a slice is segmented once by the sentencepiece library (with a copy of the model that
normalises nothing), and the lengths of pieces in normalised bytes are looked up in the recorded alignment.

``bounds`` has one offset more than there are pieces: piece i covers the bytes bounds[i] .. bounds[i+1] of the UTF-8 text. Of the
byte pieces of one character the last covers it and the others are empty, as in the library.

Cases: null text counts as empty and gives no pieces, bounds [0] and the begin and end ids alone; repeated rows are encoded each; null ids
decode to an empty text, an id outside the vocabulary is an error; other columns pass through, whatever they are called. A text is never cut for
its length: beside the text a slice of ``SLICE_BYTES`` or one longer text is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, list_array, ragged, slices, text_bytes

SPACE = "▁".encode()
#: Types of pieces in the model file (fixed values of its format).
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6


# -- the model file -----------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _to_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def fields(message: bytes) -> Iterator[tuple[int, int, Any]]:
    """(number, wire type, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(message):
        tag, at = _varint(message, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(message, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(message, at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, kind, value


def message(parts: list[tuple[int, int, Any]]) -> bytes:
    """The message of these fields."""
    out = bytearray()
    for number, kind, value in parts:
        out += _to_varint(number << 3 | kind)
        out += _to_varint(value) if kind == 0 else (_to_varint(len(value)) if kind == 2 else b"") + value
    return bytes(out)


def char_map(blob: bytes) -> dict[bytes, bytes]:
    """Sources and replacements of a compiled character map.

    It is the size of a double-array trie, the trie's 32-bit units and null-terminated replacements. The trie is unfolded level by level,
    all labels of all nodes of a level at once.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
    texts = blob[4 + size :]
    shift = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    labels = np.arange(1, 256)
    out: dict[bytes, bytes] = {}
    base, keys = shift(units[:1]), [b""]
    while len(keys):
        child = base[:, None] ^ labels
        inside = child < len(units)
        unit = units[np.where(inside, child, 0)]
        node, label = np.nonzero(inside & ((unit & (1 << 31 | 0xFF)) == labels))
        unit = unit[node, label]
        place = child[node, label] ^ shift(unit)
        keys = [keys[n] + bytes([x]) for n, x in zip(node.tolist(), labels[label].tolist())]
        for k in np.flatnonzero(unit >> 8 & 1).tolist():
            begin = int(units[place[k]] & 0x7FFFFFFF)
            out[keys[k]] = texts[begin : texts.index(b"\0", begin)]
        base = place
    return out


class Model:
    """What a model file says, and the library's segmentation of text that is normalised already."""

    def __init__(self, proto: bytes):
        import sentencepiece

        parts = list(fields(proto))
        pieces = [{n: v for n, _, v in fields(v)} for n, _, v in parts if n == 1]
        kind = np.array([p.get(3, 1) for p in pieces])
        text = [p.get(1, b"") for p in pieces]
        trainer = {n: v for num, _, v in parts if num == 2 for n, _, v in fields(v)}
        rules = {n: v for num, _, v in parts if num == 3 for n, _, v in fields(v)}
        self.prefix, self.collapse, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.fallback = bool(trainer.get(35, 0))
        self.map = char_map(rules.get(2, b""))
        self.symbols = sorted((t for t, k in zip(text, kind) if k == USER_DEFINED), key=len, reverse=True)
        # a byte piece stands for one normalised byte
        self.length = np.where(kind == BYTE, 1, [len(t) for t in text]).astype(np.int64)
        plain = message([(1, 2, b"identity"), (3, 0, 0), (4, 0, 0), (5, 0, 0)])
        own = [(n, w, v) for n, w, v in parts if n != 3] + [(3, 2, plain)]
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=message(own))
        self.bos, self.eos = self.segment.bos_id(), self.segment.eos_id()
        usual = {t for t, k in zip(text, kind) if k in (1, USER_DEFINED, 5)}
        #: Whether no piece goes on from something else to a space symbol, so that parts cut there are segmented alone.
        self.parts = SPACE in usual and not any(SPACE in _spaced(t) for t in usual)
        #: Whether long texts may be cut before a space.
        self.blocks = self.parts and not self.collapse and not self.suffix and all(b" " not in x for x in [*self.map, *self.symbols] if x != b" ")
        heads = np.zeros(1 << 16, bool)
        for source in [*self.map, *self.symbols]:
            if len(source) > 1:
                heads[source[0] << 8 | source[1]] = True
            else:
                heads[source[0] << 8 : (source[0] + 1) << 8] = True
        #: Pairs of bytes that a rule or symbol begins with.
        self.heads = heads
        self.longest = max(map(len, [*self.map, b""]))

    def replaced(self, raw: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, length, replacement) of each prefix that a symbol or the character map takes, from left to right."""
        if not (self.map or self.symbols) or not len(raw):
            return []
        after = np.append(raw[1:], 0).astype(np.int64)
        at = np.flatnonzero(self.heads[raw.astype(np.int64) << 8 | after] & ((raw & 0xC0) != 0x80))
        data, found, free = raw.tobytes(), [], 0
        ends = rows[np.searchsorted(rows, at, "right")].tolist()
        for i, end in zip(at.tolist(), ends):
            if i < free:
                continue
            symbol = next((s for s in self.symbols if data.startswith(s, i, end)), None)
            if symbol is not None:
                found.append((i, len(symbol), symbol))
                free = i + len(symbol)
                continue
            for n in range(min(self.longest, end - i), 0, -1):
                to = self.map.get(data[i : i + n])
                if to is not None:
                    found.append((i, n, to))
                    free = i + n
                    break
        return found


def _spaced(piece: bytes) -> bytes:
    """A piece without the space symbols that it begins with."""
    while piece.startswith(SPACE):
        piece = piece[len(SPACE) :]
    return piece


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


@lru_cache(maxsize=4)
def decoder(path: str) -> Any:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


# -- normalisation ------------------------------------------------------------


def normalise(raw: np.ndarray, rows: np.ndarray, m: Model, front: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of texts that lie one after another, the source offset of each (and of each text's end), and their row bounds.

    ``rows`` are the texts' bounds in ``raw``. Sources are offsets in the row's own text. The second array has one entry more for each row,
    its last: entries of row r begin at bounds[r] + r. ``front`` says whether texts may get the model's space symbol in front.
    """
    count = len(rows) - 1
    place = np.arange(len(raw), dtype=np.int64)
    source = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, place, 0)) if len(raw) else place
    unit = (raw & 0xC0) != 0x80  # where a prefix begins
    stream, bounds = raw, rows.astype(np.int64)
    if edits := m.replaced(raw, rows):
        begin = np.array([e[0] for e in edits])
        length = np.array([e[1] for e in edits])
        to = [e[2] for e in edits]
        size = np.array([len(x) for x in to])
        gone = np.zeros(len(raw) + 1, np.int64)
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + length, -1)
        stays = np.cumsum(gone[:-1]) == 0
        # what stays keeps its place, replacements are put where their source began
        new = np.frombuffer(b"".join(to), np.uint8)
        key = np.concatenate((place[stays], np.repeat(begin, size)))
        order = np.argsort(key, kind="stable")
        first = np.zeros(len(new), bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        stream = np.concatenate((raw[stays], new))[order]
        source = np.concatenate((source[stays], np.repeat(begin, size)))[order]
        unit = np.concatenate((unit[stays], first))[order]
        bounds = np.searchsorted(key[order], rows).astype(np.int64)
    head = rows[:-1].astype(np.int64)
    start = head.copy()  # source of the symbol in front
    stop = rows[1:].astype(np.int64)
    if m.collapse and len(stream):
        space = stream == 32
        row_start = np.zeros(len(stream) + 1, bool)
        row_start[bounds[:-1]] = True
        before = np.ones(len(stream), bool)  # the prefix that a byte is of follows a space or begins the text
        before[1:] = space[:-1]
        before |= row_start[:-1]
        own = np.maximum.accumulate(np.where(unit, np.arange(len(stream)), 0))
        # heading spaces of a prefix: no other byte since it began
        other = np.cumsum(~space)
        heading = space & (other == other[own] - ~space[own])
        drop = heading & before[own]
        keep = ~drop
        kept = np.concatenate(([0], np.cumsum(keep)))
        stream, source, bounds = stream[keep], source[keep], kept[bounds]
        full = bounds[1:] > bounds[:-1]
        start[full] = source[bounds[:-1][full]]
    wide = m.escape
    grow = np.where((stream == 32) & wide, len(SPACE), 1)
    shown = np.repeat(stream, grow)
    origin = np.repeat(source, grow)
    ends = np.concatenate(([0], np.cumsum(grow)))
    bounds = ends[bounds]
    if wide:
        at = (ends[:-1])[stream == 32]
        for k, b in enumerate(SPACE):
            shown[at + k] = b
    mark = np.frombuffer(SPACE if wide else b" ", np.uint8)
    # with spaces collapsed, a text of spaces alone gets no symbol in front
    fronted = (_some(raw, rows, m) if m.collapse else rows[1:] > rows[:-1]) & (m.prefix and front)
    if not m.collapse and not m.suffix:
        extra = np.where(fronted, len(mark), 0)
        new_bounds = bounds + np.concatenate(([0], np.cumsum(extra)))
        out = np.empty(len(shown) + int(extra.sum()), np.uint8)
        where = np.empty(len(out) + count, np.int64)
        shift = np.repeat(new_bounds[1:] - bounds[1:], np.diff(bounds))
        body = np.arange(len(shown)) + shift
        out[body] = shown
        row = np.repeat(np.arange(count), np.diff(bounds))
        where[body + row] = origin - head[row]
        r = np.flatnonzero(fronted)
        for k, b in enumerate(mark):
            out[new_bounds[r] + k] = b
            where[new_bounds[r] + r + k] = 0
        where[new_bounds[1:] + np.arange(count)] = stop - head
        return out, where, new_bounds
    bodies, sources, sizes = [], [], []
    for r in range(count):
        body, origins = shown[bounds[r] : bounds[r + 1]], origin[bounds[r] : bounds[r + 1]]
        end = int(stop[r])
        front = bool(fronted[r])
        if front and not m.suffix:
            body, origins = np.concatenate((mark, body)), np.concatenate((np.full(len(mark), start[r]), origins))
        if m.collapse:
            data, n = body.tobytes(), len(body)
            while n >= len(mark) and data.endswith(mark.tobytes(), 0, n):
                n -= len(mark)
                end = int(origins[n])
            body, origins = body[:n], origins[:n]
        if front and m.suffix:
            body, origins = np.concatenate((body, mark)), np.concatenate((origins, np.full(len(mark), end)))
        bodies.append(body)
        sources.append(np.append(origins, end) - head[r])
        sizes.append(len(body))
    return np.concatenate([np.zeros(0, np.uint8), *bodies]), np.concatenate([np.zeros(0, np.int64), *sources]), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _some(raw: np.ndarray, rows: np.ndarray, m: Model) -> np.ndarray:
    """Whether a text has a prefix that isn't one space."""
    blank = raw == 32
    for i, n, to in m.replaced(raw, rows):
        blank[i : i + n] = to == b" "
    total = np.concatenate(([0], np.cumsum(~blank)))
    return total[rows[1:]] > total[rows[:-1]]


# -- encoding -----------------------------------------------------------------


def _cuts(shown: np.ndarray, bounds: np.ndarray, m: Model) -> np.ndarray:
    """Where parts begin: at each text, and before a space symbol that follows something else."""
    cut = np.zeros(len(shown) + 1, bool)
    if m.parts and len(shown) >= len(SPACE):
        space = np.zeros(len(shown), bool)
        space[: len(shown) - 2] = (shown[:-2] == SPACE[0]) & (shown[1:-1] == SPACE[1]) & (shown[2:] == SPACE[2])
        cut[: len(shown)] = space
        cut[3 : len(shown)] &= ~space[: len(shown) - 3]
    cut[bounds[:-1]] = True
    cut[len(shown)] = False
    return np.append(np.flatnonzero(cut), len(shown))


def _breaks(raw: np.ndarray) -> list[int]:
    """Bounds of blocks of a long text: each begins at a space after an ASCII letter or digit, where there is one."""
    plain = np.zeros(256, bool)
    plain[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    out = [0]
    while len(raw) - out[-1] > SLICE_BYTES:
        a = out[-1] + SLICE_BYTES // 2
        while a < len(raw):
            here = raw[a : a + SLICE_BYTES // 2]
            found = np.flatnonzero((here == 32) & plain[raw[a - 1 : a - 1 + len(here)]])
            if len(found):
                break
            a += len(here)
        if a >= len(raw):
            break
        out.append(a + int(found[-1]))
    return [*out, len(raw)]


def encode_column(text: pa.Array, m: Model) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids of every text without begin and end, and the bounds of its pieces."""
    raw, rows = text_bytes(text)
    if len(rows) != 2 or len(raw) <= SLICE_BYTES or not m.blocks:
        ids, n, bounds = _encoded(raw, rows, m)
        return list_array(pa.array(ids), n), list_array(pa.array(bounds), n + 1)
    at = _breaks(raw)
    ids, bounds = [], [np.zeros(1, np.int32)]
    for k, (a, b) in enumerate(zip(at, at[1:])):
        own, _, ends = _encoded(raw[a:b], np.array([0, b - a]), m, front=k == 0)
        ids.append(own)
        bounds.append(ends[1:] + np.int32(a))
    ids, bounds = np.concatenate(ids), np.concatenate(bounds)
    return list_array(pa.array(ids), np.array([len(ids)])), list_array(pa.array(bounds), np.array([len(bounds)]))


def _encoded(raw: np.ndarray, rows: np.ndarray, m: Model, front: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, how many each has, and the bounds of their pieces (one more than ids for each text)."""
    shown, where, bounds = normalise(raw, rows, m, front)
    count = len(rows) - 1
    if not len(shown):
        return np.zeros(0, np.int32), np.zeros(count, np.int64), where.astype(np.int32)
    at = _cuts(shown, bounds, m)
    parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(shown)).dictionary_encode()
    told = parts.dictionary.to_pylist()
    ids = m.segment.encode(told, num_threads=1)
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
    if m.fallback:
        long = m.length[flat]
    else:  # an unknown piece covers as much as it says
        said = m.segment.encode(told, return_type=str, num_threads=1)
        long = np.fromiter((len(x.encode()) for x in chain.from_iterable(said)), np.int64, int(n.sum()))
    begin = np.cumsum(n) - n
    code = parts.indices.to_numpy(zero_copy_only=False)
    pick = ragged(begin[code], n[code])
    row_ids = np.concatenate(([0], np.cumsum(n[code])))[np.searchsorted(at, bounds)]
    # bounds of pieces: normalised offsets looked up in the alignment, which has one entry more for each row
    ends = np.concatenate(([0], np.cumsum(long[pick])))
    per_row = np.diff(row_ids)
    row = np.repeat(np.arange(count), per_row + 1)
    k = ragged(row_ids[:-1], per_row + 1)
    return flat[pick], per_row, where[ends[k] + row].astype(np.int32)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", bounds: str = "bounds", begin_end: bool = True, digests: bool = False) -> DataFrame:
    """``df`` with the ids of ``text`` (between begin and end ids unless told otherwise) and the byte bounds of its pieces in place of the text.

    ``digests`` adds ``<ids>_sha256`` and ``<bounds>_sha256``, in lowercase hex, of both as little-endian 32-bit integers.
    """
    def coded(b: pa.RecordBatch) -> list[pa.Array]:
        m = model(path)
        found, own = encode_column(b.column("value"), m)
        out = [_framed(found, m.bos, m.eos) if begin_end else found, own]
        return [*out, *map(_sha256, out)] if digests else out

    made = {ids: T.ArrayType(T.IntegerType()), bounds: T.ArrayType(T.IntegerType())}
    if digests:
        made |= {f"{ids}_sha256": T.StringType(), f"{bounds}_sha256": T.StringType()}
    return _mapped(df, text, made, slices, coded)


def _mapped(df: DataFrame, column: str, made: dict[str, T.DataType], parts: Callable, run: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns ``made`` of ``run`` in place of ``column`` and of what has their names; others pass through under plain names."""
    rest = [f for f in df.schema if f.name != column and f.name not in made]
    plain = [f"c{i}" for i in range(len(rest))]
    names = [*plain, *(f"m{i}" for i in range(len(made)))]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [*(f.dataType for f in rest), *made.values()])])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "value"):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], *run(b)], names)

    given = df.select(*[F.col(f"`{f.name}`").alias(c) for f, c in zip(rest, plain)], F.col(f"`{column}`").alias("value"))
    return given.mapInArrow(mapped, schema).select(*[F.col(n).alias(c) for n, c in zip(names, [*(f.name for f in rest), *made])])


def _framed(lists: pa.ListArray, bos: int, eos: int) -> pa.ListArray:
    """Lists with begin and end ids; a model without one of them adds none."""
    head, tail = [i for i in (bos,) if i >= 0], [i for i in (eos,) if i >= 0]
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = n + len(head) + len(tail)
    end = np.cumsum(wide)
    out = np.empty(int(wide.sum()), np.int32)
    inner = np.ones(len(out), bool)
    if head:
        out[end - wide] = head[0]
        inner[end - wide] = False
    if tail:
        out[end - 1] = tail[0]
        inner[end - 1] = False
    out[inner] = lists.flatten().to_numpy(zero_copy_only=False)
    return list_array(pa.array(out), wide)


def spans(df: DataFrame, ids: str = "ids", bounds: str = "bounds", framed: bool = True) -> DataFrame:
    """One row for each piece in place of the lists: ``piece`` (from 0), its ``id``, and the bytes ``begin`` .. ``stop`` of the text."""
    own = F.slice(ids, 2, F.size(ids) - 2) if framed else F.col(ids)
    zipped = F.transform(own, lambda x, i: F.struct(i.alias("piece"), x.alias("id"), F.col(bounds)[i].alias("begin"), F.col(bounds)[i + 1].alias("stop")))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (ids, bounds)]
    return df.select(*rest, F.explode(zipped).alias("_p")).select(*rest, "_p.*")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` stand for in place of the ids."""
    def few(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from (b.slice(at, 64) for at in range(0, b.num_rows, 64))
        pa.default_memory_pool().release_unused()

    def told(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([decoder(path).decode(x.as_py() or []) for x in b.column("value")], pa.string())]

    return _mapped(df, ids, {out: T.StringType()}, few, told)


def _sha256(lists: pa.ListArray) -> pa.Array:
    flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")
    end = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    return pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip([0, *end[:-1].tolist()], end.tolist())], pa.string())
