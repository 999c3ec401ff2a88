"""Removal of word windows that an earlier document also has, by recompression.

1. Each document is recompressed for a few rounds (``recompression``); its symbols of two or more words go
   to Spark, which finds the names that several documents share (a count with map-side partial sums).
2. A window is a candidate only if every symbol whose naming it contains is shared, with an earlier
   document for windows to remove, with a later one for windows to keep as first. Long unique text has no candidate.
3. Candidate windows are verified by the hash of all their words: the smallest id of each is
   joined back, and the words that removed windows cover are left out.

Documents with the same words as an earlier one are settled by a 128-bit hash of the whole before all that.
Windows are judged on the input. Windows are compared as 64-bit hashes: two different windows of N
candidates collide with a chance of N * N / 2**65.

Cases: null text has no words; texts with fewer than ``window`` words keep all; rows of a null id are neither
removed from nor compared with; rows of the same id never remove from each other; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, list_array, mix, over_key, signed, sized, slices, stored
from .recompression import Symbols, open_windows

WINDOW = 13
ROUNDS = 2
MIN_WORDS = 2


def _symbols(w: Words, rounds: int, window: int) -> Iterator[tuple[int, int, Symbols, np.ndarray]]:
    """Blocks of windows [a, b) with the symbols of the words they cover, and which of these are told to Spark:
    those of MIN_WORDS words or more that a window can contain.

    What a window contains depends on its words alone, so blocks that overlap by a window give all of it.
    """
    for a, b, first in w.parts(window):
        s = Symbols(w.hash[a : b + window - 1], first, rounds)
        yield a, b, s, (s.end - s.start >= MIN_WORDS) & (s.seen_to - s.seen_from <= window)


class _Lists:
    """The lists of a column, to ask whether names are in the list of a row."""

    def __init__(self, lists: pa.ListArray):
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.salt = mix(np.arange(len(lists), dtype=np.uint64) + np.uint64(1))
        self.known = np.sort(values ^ np.repeat(self.salt, size))

    def has(self, row: np.ndarray, name: np.ndarray) -> np.ndarray:
        asked = name ^ self.salt[row]
        if not len(self.known):
            return np.zeros(len(asked), bool)
        return self.known[np.minimum(np.searchsorted(self.known, asked), len(self.known) - 1)] == asked


def _kept(w: Words, gone: np.ndarray) -> pa.StringArray:
    """Words that are not gone, joined by one space, for each row."""
    take = np.flatnonzero(~gone)
    row = np.searchsorted(w.first, take, "right") - 1
    last = np.ones(len(take), bool)
    last[:-1] = row[1:] != row[:-1]
    start, stop = w.start[take], w.end[take] + ~last
    raw = w.raw.copy()
    raw[w.end[take[~last]]] = 32
    change = np.zeros(len(raw) + 1, np.int8)
    change[start] += 1
    np.subtract.at(change, stop, 1)
    per = np.bincount(row, stop - start, minlength=len(w.first) - 1).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
    return pa.StringArray.from_buffers(len(per), pa.py_buffer(offsets), pa.py_buffer(raw[np.cumsum(change[:-1], dtype=np.int8).view(bool)]))


def _marks(rows: DataFrame, window: int, rounds: int) -> DataFrame | None:
    """What to remove: id, rk, everything (boolean), at (first words of windows); for rows (id, rk, text)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            rows_, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, _, s, told in _symbols(w, rounds, window):
                rows_.append(s.row[told])
                names.append(s.name[told])
            row, name = np.concatenate(rows_), np.concatenate(names)
            by = np.lexsort((name, row))
            row, name = row[by], name[by]
            new = np.ones(len(name), bool)
            new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
            lists = list_array(signed(name[new]), np.bincount(row[new], minlength=b.num_rows))
            whole = w.whole()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rk"), pa.array(w.counts), pa.array(whole, pa.binary()), lists], ["id", "rk", "n", "whole", "names"])

    base = rows.where("id is not null and text is not null").mapInArrow(tell, "id long, rk long, n long, whole binary, names array<long>")
    base = stored(base.where(F.col("n") >= window).withColumn("row", F.monotonically_increasing_id()))
    first = base.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("whole", "rep")
    copies = stored(base.select("id", "rk", "row", "whole").join(first, "whole").where("id > rep").select("id", "rk", "row"))
    again = base.groupBy("id", "rk").agg(F.min("row").alias("one"), F.count("*").alias("c")).where("c > 1").select("id", "rk", "one")
    again = base.select("id", "rk", "row").join(again, ["id", "rk"]).where("row <> one").select("row")
    out = sized(stored(copies.select("row").unionByName(again).distinct()))
    names = base.join(out, "row", "left_anti").select("id", "row", F.explode("names").alias("name"))
    shared = over_key(names, "name", "lo < hi", lo=F.min("id"), hi=F.max("id"))
    hits = shared.groupBy("row").agg(F.collect_list(F.when(F.col("lo") < F.col("id"), F.col("name"))).alias("q"), F.collect_list(F.when(F.col("hi") > F.col("id"), F.col("name"))).alias("s"))
    hits = stored(hits.join(base.select("id", "rk", "row"), "row").drop("row"))
    copies = stored(copies.select("id", "rk").distinct())
    discard(base)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            hashes, inside = w.windows(window)
            role = np.zeros(len(hashes), np.int64)
            shared = [(bit, _Lists(b.column(column))) for bit, column in ((1, "q"), (2, "s"))]
            for lo, hi, s, told in _symbols(w, rounds, window):
                hi = min(hi, len(hashes))
                for bit, lists in shared:
                    good = ~told
                    good[told] = lists.has(s.row[told], s.name[told])
                    if lo < hi:
                        role[lo:hi] += bit * (open_windows(s, good, window, hi - lo) & inside[lo:hi])
            at = np.flatnonzero(role)
            row = np.searchsorted(w.first, at, "right") - 1
            code = (at - w.first[row]) * 4 + role[at]
            per = np.bincount(row, minlength=len(w.first) - 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rk"), list_array(pa.array(code.astype(np.int32)), per), list_array(signed(hashes[at]), per)], ["id", "rk", "code", "win"])

    # a document without a shared symbol still has candidates where a window holds no symbol at all (long runs)
    texts = rows.where("id is not null and text is not null").join(sized(copies), ["id", "rk"], "left_anti")
    found = texts.join(hits, ["id", "rk"], "left").mapInArrow(candidates, "id long, rk long, code array<int>, win array<long>").where("size(code) > 0")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()))
    discard(hits)
    each = found.select("id", "row", F.explode(F.arrays_zip("code", "win")).alias("x")).select("id", "row", F.col("x.code").alias("code"), F.col("x.win").alias("win"))
    of = lambda bit: F.when(F.col("code").bitwiseAND(bit) > 0, F.col("id"))
    seen = over_key(each, "win", "lo < hi", lo=F.min(of(2)), hi=F.max(of(1)))
    gone = seen.where("code & 1 > 0 and lo < id").groupBy("row").agg(F.collect_list(F.shiftright("code", 2)).alias("at"))
    gone = gone.join(found.select("id", "rk", "row"), "row").dropDuplicates(["id", "rk"])
    marks = gone.select("id", "rk", F.lit(False).alias("everything"), "at").unionByName(copies.select("id", "rk", F.lit(True).alias("everything"), F.array().cast("array<int>").alias("at")))
    marks = stored(marks)
    discard(found)
    return marks


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with n_words, n_removed and kept (the words that stay, joined by one space); columns of these names are replaced."""
    df = df.drop("n_words", "n_removed", "kept")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("other"), F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("rk"), F.col(f"`{text}`").alias("text"))
    marks = _marks(rows.select("id", "rk", "text"), window, rounds)
    ids = sized(marks.select("id", "rk"))
    schema = T.StructType([rows.schema["other"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            change = np.zeros(len(w.hash) + window + 1, np.int32)
            if "at" in b.schema.names:
                lists = b.column("at")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                begin = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.first[:-1], size)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + window, -1)
                for r in np.flatnonzero(b.column("everything").to_numpy(zero_copy_only=False)):
                    change[w.first[r]] += 1
                    change[w.first[r + 1]] -= 1
            gone = np.cumsum(change, out=change)[: len(w.hash)] > 0
            lost = np.bincount(np.searchsorted(w.first, np.flatnonzero(gone), "right") - 1, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("other"), pa.array(w.counts), pa.array(lost), _kept(w, gone)], schema.names)

    plain = rows.join(ids, ["id", "rk"], "left_anti").select("other", "text").mapInArrow(remove, schema)
    changed = rows.join(ids, ["id", "rk"], "left_semi").join(marks, ["id", "rk"]).select("other", "text", "everything", "at").mapInArrow(remove, schema)
    out = plain.unionByName(changed)
    return out.select(*[F.col(f"other.`{c}`").alias(c) for c in df.columns], "n_words", "n_removed", "kept")
