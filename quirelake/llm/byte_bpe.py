"""Byte-level BPE encoding and decoding of whole texts.

Texts longer than ``chunk`` characters are cut into overlapping chunks that are pre-tokenised
in parallel. Neighbouring chunks are stitched at the first pre-token boundary that both have in
their overlap: what follows a boundary depends on nothing before it, so from there on both see the
same pre-tokens. Each chunk then encodes the pieces between its two stitches, and the ids of
a text are put together in order. A text whose chunks find no common boundary (one pre-token as
long as an overlap) is encoded in one piece instead. Decoding concatenates the tokens' bytes.

Cases: null text counts as empty and gives an empty list; repeated rows are encoded each; null
ids decode to empty bytes, an id outside the vocabulary is an error; other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, ragged, slices, spread, stored, text_bytes

CHUNK = 32_768
OVERLAP = 512
#: The longest literal of the pattern; a match that starts nearer to a cut may change with more text.
_LOOK = 3
_SLICE = 2 << 20
_WHITE = r"\t-\r \x85\xa0  -     　"


def compiled(pattern: str) -> Any:
    """The pattern with white space spelled out as Unicode has it, whatever library runs it."""
    import regex

    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            if depth:
                if two == r"\S":
                    raise ValueError("\\S inside a class")
                out.append(_WHITE)
            else:
                out.append(f"[{'^' * (two == chr(92) + 'S')}{_WHITE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            depth += (two[0] == "[") - (two[0] == "]")
            out.append(two[0])
            i += 1
    return regex.compile("".join(out))


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of pre-tokens, remembered up to a bounded number of them."""

    LIMIT = 50_000

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.match = compiled(pattern)
        self.one = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            ids = self.one.encode_ordinary(text)
            if len(text) < 64:
                if len(self.known) >= self.LIMIT:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def run(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece, self.match.findall(text))))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class Decoder:
    """The bytes of each id, in arrays."""

    def __init__(self, path: str):
        words = sorted((b, a) for a, b in _ranks(path).items())
        size = words[-1][0] + 1 if words else 0
        self.length = np.full(size, -1, np.int64)
        self.length[[b for b, _ in words]] = [len(a) for _, a in words]
        self.begin = np.zeros(size, np.int64)
        self.begin[[b for b, _ in words]] = np.cumsum([0, *(len(a) for _, a in words)])[:-1]
        self.bytes = np.frombuffer(b"".join(a for _, a in words), np.uint8)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


_ASCII = np.zeros(256, bool)
_ASCII[[0x20, *range(0x09, 0x0E)]] = True
_OTHER_WHITE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def encode_column(text: pa.Array, e: Encoder) -> pa.ListArray:
    """Ids of every text.

    A pre-token never goes on from a character to white space after it, so texts are cut before
    white space that follows something else; each distinct cut piece of the batch is
    pre-tokenised and encoded once. Texts with white space outside ASCII take the plain way.
    """
    odd = pc.fill_null(pc.match_substring_regex(text, _OTHER_WHITE), False)
    if pc.any(odd).as_py():
        plain = odd.to_numpy(zero_copy_only=False)
        lists = [None] * len(text)
        for i in np.flatnonzero(plain):
            lists[i] = e.run(text[int(i)].as_py())
        rest = encode_column(text.filter(pc.invert(odd)), e).to_pylist()
        for i, ids in zip(np.flatnonzero(~plain), rest):
            lists[i] = ids
        return pa.array(lists, pa.list_(pa.int32()))
    raw, rows = text_bytes(text)
    if not len(raw):
        return list_array(pa.array([], pa.int32()), np.zeros(len(text), np.int64))
    white = _ASCII[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = white[1:] & ~white[:-1]
    inner = rows[:-1][rows[:-1] < len(raw)]
    cut[inner] = True
    at = np.append(np.flatnonzero(cut), len(raw))
    parts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
    coded = parts.dictionary_encode()
    ids = [e.run(x) for x in coded.dictionary.to_pylist()]
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))
    begin = np.cumsum(length) - length
    code = coded.indices.to_numpy(zero_copy_only=False)
    per = length[code]
    values = flat[ragged(begin[code], per)]
    bound = np.concatenate(([0], np.cumsum(per)))
    return list_array(pa.array(values), np.diff(bound[np.searchsorted(at, rows)]))


def _bounds(text: str, e: Encoder) -> list[int]:
    """Ends of pre-tokens that more text after the cut would not move.

    None follows white space: how a run of that is split depends on what comes after it.
    """
    spans = [m.span() for m in e.match.finditer(text)]
    return [b for a, b in spans if a + _LOOK <= len(text) and b < len(text) and not text[b - 1].isspace()]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with the list of ids of ``text`` in place of the text."""
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("overlap must be over 0 and at most half of chunk")
    rest = [c for c in df.columns if c not in (text, ids)]
    name = {c: f"c{i}" for i, c in enumerate(rest)}
    base = df.select(F.struct(*[F.col(f"`{c}`").alias(v) for c, v in name.items()]).alias("other") if rest else F.struct(F.lit(1).alias("c")).alias("other"), F.col(f"`{text}`").alias("text"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    other = base.schema["other"].dataType
    schema = T.StructType([T.StructField("other", other), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in slices(batches, limit=_SLICE):
            yield pa.RecordBatch.from_arrays([b.column("other"), encode_column(b.column("text"), e)], ["other", "ids"])

    short = base.where(~long).mapInArrow(whole, schema)

    step = chunk - overlap
    big = stored(base.where(long).withColumn("row", F.monotonically_increasing_id()))  # rows keep their numbers if a task runs again
    cuts = F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(step))
    cuts = F.filter(cuts, lambda s: (s == 0) | (s + overlap < F.char_length("text")))
    parts = big.select("row", "text", F.posexplode(cuts).alias("k", "s"), F.char_length("text").alias("n"))
    parts = parts.select("row", "k", "s", (F.col("s") + chunk >= F.col("n")).alias("last"), F.substring("text", F.col("s") + 1, F.lit(chunk)).alias("text"))
    parts = parts.repartition(spread(df.sparkSession), "row", "k")
    kept = "row long, k int, s int, last boolean, text string, head array<int>, tail array<int>"

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in slices(batches, limit=_SLICE):
            heads, tails = [], []
            for s, t in zip(b.column("s").to_pylist(), b.column("text").to_pylist()):
                sure = _bounds(t, e)
                heads.append([s + x for x in sure if x <= overlap])
                tails.append([s + x for x in sure if x > step])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*b.schema.names, "head", "tail"])

    order = Window.partitionBy("row").orderBy("k")
    tied = parts.mapInArrow(bounds, kept)
    tied = tied.withColumn("stop", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    tied = tied.withColumn("go", F.lag("stop").over(order))
    lost = F.max(F.col("stop").isNull() & ~F.col("last")).over(Window.partitionBy("row"))
    tied = tied.select("row", "k", lost.alias("lost"), "text", (F.coalesce("go", F.lit(0)) - F.col("s")).alias("a"), F.when(F.col("last"), F.char_length("text")).otherwise(F.col("stop") - F.col("s")).alias("b"))
    tied = tied.where("not lost").select("row", "k", F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in slices(batches, limit=_SLICE):
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), encode_column(b.column("text"), e)], ["row", "k", "ids"])

    part_ids = tied.mapInArrow(pieces, "row long, k int, ids array<int>")
    joined = part_ids.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = joined.select("row", F.flatten("parts.ids").alias("ids"))
    stitched = big.select("row", "other", "text").join(joined, "row", "left")
    whole_again = stitched.where("ids is null").select("other", "text").mapInArrow(whole, schema)
    out = short.unionByName(stitched.where("ids is not null").select("other", "ids")).unionByName(whole_again)
    return out.select(*[F.col(f"other.{v}").alias(c) for c, v in name.items()], F.col("ids").alias(ids))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in place of the ids."""
    place = df.columns.index(ids)
    fields = [T.StructField(out, T.BinaryType()) if f.name == ids else f for f in df.schema if f.name != out or f.name == ids]
    df = df.select(*[f"`{f.name}`" if f.name != out or out == ids else f"`{ids}`" for f in fields])
    place = [f.name for f in fields].index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                lists = b.column(place)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(e.length) or (e.length[flat] < 0).any()):
                    raise ValueError("id outside the vocabulary")
                size = e.length[flat]
                data = e.bytes[ragged(e.begin[flat], size)]
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                end = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
                value = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(end.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([value if i == place else c for i, c in enumerate(b.columns)], [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))
