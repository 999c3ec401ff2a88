"""Shared building blocks: shared-folder tables, vectorised words, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer single text is one slice, worked off in blocks.
SLICE_BYTES = 1 << 20
#: Bytes, and words or windows, that one block of a slice holds: what a block needs beside the slice has a fixed size.
BLOCK_BYTES = 128 << 10
BLOCK_WORDS = 64 << 10


# -- tables in the shared folder --------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a folder of this machine in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="checkpoints-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quirelake-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    Shuffle files behind the table are removed as soon as it is written, so a chain of stored
    tables needs the disk of one step at a time.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` made, once nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def over_key(df: DataFrame, key: str, keep: str, **aggregates: Column) -> DataFrame:
    """Rows of ``df`` whose key has ``aggregates`` over all its rows that satisfy ``keep``, with the aggregates as columns.

    The aggregates are summed up map-side and stored before they are joined back. Both sides of that join are then plain shuffles, which
    Spark splits where a key is frequent, so no task has to take all rows of one.
    """
    per = stored(df.groupBy(key).agg(*[a.alias(c) for c, a in aggregates.items()]).where(keep))
    return df.join(per, key)


def spread(spark: SparkSession) -> int:
    """Partitions for a stage whose cost is Python work rather than bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 2)


# -- slices of Arrow batches -------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes; a longer single row stays whole.

    Workers are reused by later stages, so memory that Arrow holds back is returned at the end of each partition.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and row offsets; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


# -- 64-bit hashes of words and word windows ---------------------------------

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_RADIX = 0xD6E8FEB86659FD93
_INVERSE = pow(_RADIX, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    """base ** 0 .. 2 * BLOCK_BYTES modulo 2**64."""
    out = np.full(2 * BLOCK_BYTES + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_RADIX), _powers(_INVERSE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row of a string column.

    start, end: byte range of each word in ``raw``; first: index of the first word of each
    row (one more entry at the end); hash: 64-bit content hash of each word. Beside these, which take
    16 bytes a word, and two flags a byte, memory is that of one block, however long a text is.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.raw, self.rows = text_bytes(column)
        white = _SPACE[self.raw]
        edge = np.ones(len(white) + 1, bool)  # a word may begin here, and one that ran so far ends
        edge[1:-1] = white[:-1]
        inner = self.rows[1:-1]
        edge[inner] = True
        kind = np.int32 if len(white) < 1 << 31 else np.int64
        self.start = np.flatnonzero(edge[:-1] & ~white).astype(kind)
        edge[:-1] = white
        edge[inner] = True
        self.end = (np.flatnonzero(edge[1:] & ~white) + 1).astype(kind)
        self.first = np.searchsorted(self.start, self.rows)
        self.hash = self._hashed(_LOWER if lower else None)

    def _hashed(self, table: np.ndarray | None) -> np.ndarray:
        """Polynomials over the bytes of each word, by prefix sums within blocks."""
        out = np.zeros(len(self.start), np.uint64)
        seen = lambda a, b: _BYTE[self.raw[a:b] if table is None else table[self.raw[a:b]]]
        long = self.end - self.start > BLOCK_BYTES
        place = self.start // BLOCK_BYTES
        cuts = np.flatnonzero((place[1:] != place[:-1]) | long[1:] | long[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(out)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            if long[a]:
                total, mask = 0, (1 << 64) - 1
                for at in range(lo, hi, BLOCK_BYTES):
                    part = seen(at, min(hi, at + BLOCK_BYTES))
                    total += int((part * _UP[: len(part)]).sum()) * pow(_RADIX, at - lo, 1 << 64)
                out[a] = total & mask
                continue
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(seen(lo, hi) * _UP[: hi - lo], out=total[1:])
            begin = self.start[a:b] - lo
            out[a:b] = (total[self.end[a:b] - lo] - total[begin]) * _DOWN[begin]
        for at in range(0, len(out), BLOCK_WORDS):
            out[at : at + BLOCK_WORDS] = mix(out[at : at + BLOCK_WORDS])
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def parts(self, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Blocks of windows [a, b) by their first word, and the row bounds of the words a .. b + window - 1 that they cover."""
        n = len(self.hash)
        for a in range(0, n, BLOCK_WORDS):
            b, to = min(n, a + BLOCK_WORDS), min(n, a + BLOCK_WORDS + window - 1)
            yield a, b, np.clip(self.first, a, to) - a

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k-word window, by the index of its first word, and whether it stays in its row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.empty(n, np.uint64)
        for at in range(0, n, BLOCK_WORDS):
            m = min(BLOCK_WORDS, n - at)
            total = np.zeros(m, np.uint64)
            for j in range(k):
                total += self.hash[at + j : at + j + m] * np.uint64(pow(_ODD, j + 1, 1 << 64))
            out[at : at + m] = mix(total)
        inside = np.ones(n, bool)
        for b in self.first[1:-1]:
            inside[max(0, b - k + 1) : b] = False
        return out, inside

    def whole(self) -> list[bytes]:
        """Hash of each row's whole word sequence, 128 bits."""
        return [hashlib.blake2b(self.hash[a:b], digest_size=16).digest() for a, b in zip(self.first.tolist(), self.first[1:].tolist())]


def same_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal byte ranges: the group of each, and one member of each group.

    Ranges are grouped by hash; every one is then compared with its group's first member byte by byte, and those that differ from it
    are told apart by their bytes.
    """
    import pandas as pd  # workers of other operators do without

    code, unique = pd.factorize(hashes)
    code = code.astype(np.int64)
    member = np.zeros(len(unique), np.int64)
    member[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    other = np.zeros(len(code), bool)
    for at in range(0, len(code), BLOCK_WORDS):
        own = slice(at, at + BLOCK_WORDS)
        first = member[code[own]]
        size = (end[own] - start[own]).astype(np.int64)
        unlike = size != end[first] - start[first]
        check = np.flatnonzero(~unlike & (first != np.arange(at, at + len(first))))
        for a in range(0, len(check), BLOCK_WORDS // 4):
            k = check[a : a + BLOCK_WORDS // 4]
            n = size[k]
            differ = raw[ragged(start[own][k].astype(np.int64), n)] != raw[ragged(start[first[k]].astype(np.int64), n)]
            if differ.any():
                unlike[k[np.unique(np.repeat(np.arange(len(k)), n)[differ])]] = True
        other[own] = unlike
    if other.any():
        told: dict[tuple[int, bytes], int] = {}
        more = []
        for i in np.flatnonzero(other).tolist():
            key = (int(code[i]), raw[start[i] : end[i]].tobytes())
            if key not in told:
                told[key] = len(member) + len(more)
                more.append(i)
            code[i] = told[key]
        member = np.concatenate((member, np.array(more, np.int64)))
    return code, member


def texts_at(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges as strings."""
    size = (end - start).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(size)))
    data = np.empty(int(bounds[-1]), np.uint8)
    for at in range(0, len(size), BLOCK_WORDS):
        data[bounds[at] : bounds[min(len(size), at + BLOCK_WORDS)]] = raw[ragged(start[at : at + BLOCK_WORDS].astype(np.int64), size[at : at + BLOCK_WORDS])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(data)).cast(pa.string())


def signed(x: np.ndarray) -> pa.Array:
    """uint64 hashes as the long column that Spark has."""
    return pa.array(x.view(np.int64), pa.int64())


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i]+length[i]-1 for every i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(length) - length
    return np.arange(total) + np.repeat(first - ahead, length)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


# -- connected components ----------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from every node of ``edges``: columns node, component.

    Rounds of contraction: every node moves to the neighbour with the smallest mixed key,
    which shrinks chains and stars alike; a node's neighbours are only ever reduced by a
    map-side combined minimum, so a hub is one row a task. Rounds go on until no edge is left.
    Null ends and self links are ignored; nodes without an edge don't appear.
    """
    key = lambda c: F.struct(F.xxhash64(c, F.lit(7)).alias("k"), c.alias("n"))
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(key(F.col("b"))).alias("m"))
        step = stored(step.select(F.col("a").alias("node"), F.least(key(F.col("a")), F.col("m"))["n"].alias("to")))
        if moves is None:
            moves = step
        else:
            then = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            moves = stored(moves.join(then, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = pairs.join(left, "a").join(right, "b").where("x <> y")
        pairs = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if moves is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = moves.groupBy("to").agg(F.min(F.least("node", "to")).alias("component"))
    return moves.join(least, "to").select("node", "component")


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A broadcast of a narrow ``df`` that was counted to have at most ``rows``; otherwise ``df`` itself, for a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df
