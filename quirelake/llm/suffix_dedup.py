"""Repeated passages across documents by sparse suffix arrays.

Suffixes are kept only at content-selected positions: minimisers of word 8-grams, so that every repeat of
``min_words`` words holds one with at least half of it ahead. Suffixes whose first ``HALF`` words occur
once are dropped by a count. The others carry bounded contexts, ``HALF`` more words to the right and as many to the left
(minimisers are never further apart, so the contexts of a long repeat's suffixes overlap):

1. suffixes with equal contexts are one class, counted with map-side partial sums;
2. classes are sorted across the cluster by suffix, and by suffix head and then left context, and neighbours are compared, also
   those on both sides of a partition's border. In the first order a neighbour has the longest match to the right that any class has,
   in the second the longest to the left; each is extended to the other side;
3. no repeat is left out or open where these two longest matches are too short together, or each of the two neighbours makes a repeat.
   Only where neither is so, a repeat may lie in between: for every split of ``min_words`` around the position, classes
   that agree on that much to the left and right meet by hash.

Documents with the same words are settled by a 128-bit hash of the whole first.

Result: for each document the maximal spans of words that lie in a repeat of at least ``min_words`` words,
here or in another document. Cases: null or short texts have no span; rows of a null id are left out; repeated rows
are copies of each other; overlapping repeats are one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, discard, list_array, mix, signed, sized, slices, stored, text_bytes
from .licenses import winnow
from .substring_dedup import _Lists

MIN_WORDS = 50
GRAM = 8


def anchors(w: Words, half: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions with ``half`` words ahead in their row, and the hash of those words."""
    grams, inside = w.windows(gram)
    at = winnow(grams, inside, half + 1)
    ahead, whole = w.windows(half)
    at = at[at < len(ahead)]
    at = at[whole[at]]
    return at, ahead[at]


def _around(w: Words, at: np.ndarray, half: int) -> tuple[pa.Array, pa.Array]:
    """Words before each position, nearest first, and those after its ``half``, four bytes each."""
    short = (w.hash >> np.uint64(32)).astype(">u4")
    row = np.searchsorted(w.first, at, "right") - 1
    left = np.minimum(at - w.first[row], half)
    right = np.minimum(w.first[row + 1] - at - half, half)

    def packed(first: np.ndarray, step: int, size: np.ndarray) -> pa.Array:
        total = int(size.sum())
        index = np.repeat(first, size) + step * (np.arange(total) - np.repeat(np.cumsum(size) - size, size))
        offsets = np.concatenate(([0], np.cumsum(4 * size))).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(short[index])])

    return packed(at - 1, -1, left), packed(at + half, 1, right)


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each span: key, start_word, end_word, n_words, first_id (smallest id known to share part of it)."""
    if min_words < 2 * GRAM:
        raise ValueError(f"min_words must be at least {2 * GRAM}")
    half = min_words // 2
    rest = min_words - half
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("rk"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            at, ahead = anchors(w, half)
            per = np.diff(np.searchsorted(at, w.first))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rk"), pa.array(w.counts), pa.array(w.whole(), pa.binary()), list_array(signed(ahead), per)], ["id", "rk", "n", "whole", "g"])

    base = stored(rows.mapInArrow(tell, "id long, rk long, n long, whole binary, g array<long>").where(F.col("n") >= min_words))
    same = base.groupBy("whole").agg(F.min(F.struct("id", "rk")).alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = stored(base.select("id", "rk", "n", "whole").join(same, "whole").select("id", "rk", "n", F.col("rep.id").alias("rep"), ((F.col("id") == F.col("rep.id")) & (F.col("rk") == F.col("rep.rk"))).alias("is_rep")).distinct())
    dropped = sized(copies.where("not is_rep").select("id", "rk"))
    own = base.select("id", "rk", "g").join(dropped, ["id", "rk"], "left_anti").dropDuplicates(["id", "rk"])
    each = own.select("id", "rk", F.explode("g").alias("g"))
    often = each.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    hits = stored(each.join(stored(often), "g").groupBy("id", "rk").agg(F.collect_set("g").alias("gs")))
    discard(base)

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            at, ahead = anchors(w, half)
            row = np.searchsorted(w.first, at, "right") - 1
            keep = _Lists(b.column("gs")).has(row, ahead)
            at, ahead, row = at[keep], ahead[keep], row[keep]
            left, right = _around(w, at, half)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("rk").take(take), pa.array((at - w.first[row]).astype(np.int32)), signed(ahead), right, left], ["id", "rk", "pos", "g", "r", "l"])

    texts = rows.join(sized(hits.select("id", "rk")), ["id", "rk"], "left_semi").join(dropped, ["id", "rk"], "left_anti")
    found = stored(texts.join(hits, ["id", "rk"]).mapInArrow(context, "id long, rk long, pos int, g long, r binary, l binary").dropDuplicates(["id", "rk", "pos"]).withColumn("class", F.xxhash64("g", "r", "l")))
    discard(hits)
    classes = stored(found.groupBy("g", "r", "l").agg(F.min("id").alias("low"), F.count("*").alias("c"), F.first("class").alias("class")))
    size = lambda c: (F.length(c) / 4).cast("int")
    many = classes.where("c > 1").select("class", size("l").alias("a"), size("r").alias("b"), "low")
    settled, open_ = _sorted(classes, rest)
    # a class that occurs several times with whole contexts reaches as far as any can
    full = many.where((F.col("a") == half) & (F.col("b") == rest)).select("class")
    left = stored(classes.join(open_, "class", "left_semi").join(full, "class", "left_anti"))
    reach = many.where(F.col("a") + F.col("b") >= rest).unionByName(settled)
    if not left.isEmpty():
        others = classes.join(sized(left.select("g").distinct()), "g", "left_semi")
        reach = reach.unionByName(_splits(left, others, rest))
    # every reach is a union of repeats around the same words, so a class needs only the furthest of each side
    # stored, so that both sides of the join by class are plain shuffles, which Spark splits where a class is frequent
    reach = stored(reach.groupBy("class").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.min("low").alias("low")))
    placed = found.select("id", "rk", "pos", "class").join(reach, "class").select("id", "rk", (F.col("pos") - F.col("a")).alias("x"), (F.col("pos") + half + F.col("b")).alias("y"), "low")
    placed = placed.unionByName(copies.select("id", "rk", F.lit(0).alias("x"), F.col("n").cast("int").alias("y"), F.col("rep").alias("low")))
    # overlapping spans of a document are one: a span that begins past all before it begins a new one
    order = Window.partitionBy("id", "rk").orderBy("x", "y", "low")
    before = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("new", F.when(F.coalesce(before, F.lit(-1)) < F.col("x"), 1).otherwise(0)).withColumn("part", F.sum("new").over(order))
    out = placed.groupBy("id", "rk", "part").agg(F.min("x").alias("start_word"), F.max("y").alias("end_word"), F.min("low").alias("low"))
    return out.select(F.col("id").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.least("id", "low").alias("first_id")).distinct()


def _words_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each context, in rows of ``width``, and how many there are."""
    raw, rows = text_bytes(column)
    size = np.diff(rows) // 4
    out = np.zeros((len(size), width), np.uint32)
    out[np.arange(width) < size[:, None]] = raw.view(">u4")
    return out, size


def _sorted(classes: DataFrame, rest: int) -> tuple[DataFrame, DataFrame]:
    """What sorted neighbours settle (class, a, b, low), and the classes (class) that they leave open."""
    right = _neighbours(classes, rest, "r").select("class", F.col("far").alias("b"), F.col("near").alias("a1"), "low")
    left = _neighbours(classes, rest, "l").select("class", F.col("far").alias("a"), F.col("near").alias("b1"), F.col("low").alias("low1"))
    both = stored(right.join(left, "class").where(F.col("a") + F.col("b") >= rest))
    sure_right, sure_left = F.col("a1") + F.col("b") >= rest, F.col("a") + F.col("b1") >= rest
    found = both.select("class", F.when(sure_left, F.col("a")).otherwise(F.col("a1")).alias("a"), F.when(sure_right, F.col("b")).otherwise(F.col("b1")).alias("b"), F.least(F.when(sure_right, F.col("low")), F.when(sure_left, F.col("low1"))).alias("low"), (sure_right | sure_left).alias("any"))
    return found.where("any").drop("any"), both.where(~(sure_right & sure_left)).select("class")


def _neighbours(classes: DataFrame, rest: int, side: str) -> DataFrame:
    """For each class that has another one of its head: class, far (the longest match on ``side``), near (that neighbour's on the
    other side) and low, by both neighbours in the order of head, this side, other side."""
    other = "l" if side == "r" else "r"
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = classes.select("g", side, other, "low", "class").repartitionByRange(parts, "g", side, other).sortWithinPartitions("g", side, other)
    edge = f"class long, far int, near int, low long, border boolean, g long, {side} binary, {other} binary"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                if first is None:
                    first = b.slice(0, 1)
                t = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks().to_batches()[0]
                last = t.slice(t.num_rows - 1)
                yield _compared(t, rest, side, other)
        for b in (first, last):
            if b is not None:
                n = pa.array([None], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("class"), n, n, b.column("low"), pa.array([True]), b.column("g"), b.column(side), b.column(other)], ["class", "far", "near", "low", "border", "g", side, other])

    met = stored(laid.mapInArrow(compare, edge))
    # the first and last class of each partition, which are as many as there are partitions
    ends = met.where("border").select("g", side, other, "low", "class").coalesce(1).sortWithinPartitions("g", side, other)
    across = ends.mapInArrow(compare, edge).where("not border")
    best = F.max(F.struct("far", "near", (-F.col("low")).alias("m")))
    out = met.where("not border").unionByName(across).groupBy("class").agg(best.alias("x"))
    return out.select("class", F.col("x.far").alias("far"), F.col("x.near").alias("near"), (-F.col("x.m")).alias("low"))


def _compared(t: pa.RecordBatch, rest: int, side: str, other: str) -> pa.RecordBatch:
    """Matches of neighbouring rows, for both of them."""
    g, low, name = (t.column(c).to_numpy() for c in ("g", "low", "class"))
    same = np.flatnonzero((g[1:] == g[:-1]) & (name[1:] != name[:-1]))

    def common(column: str) -> np.ndarray:
        words, size = _words_of(t.column(column), max(rest, int(pc.max(pc.binary_length(t.column(column))).as_py() or 0) // 4))
        most = np.minimum(size[same], size[same + 1])
        unlike = (words[same] != words[same + 1]) | (np.arange(words.shape[1]) >= most[:, None])
        return np.where(unlike.any(axis=1), unlike.argmax(axis=1), most).astype(np.int32)

    far, near = common(side), common(other)
    twice = lambda x, y: pa.array(np.concatenate((x, y)))
    n = 2 * len(same)
    empty = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([twice(name[same], name[same + 1]), twice(far, far), twice(near, near), twice(low[same + 1], low[same]), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int64()), empty, empty], ["class", "far", "near", "low", "border", "g", side, other])


def _splits(left: DataFrame, others: DataFrame, rest: int) -> DataFrame:
    """For each split of ``rest`` words before and after: classes in ``left`` that share it with another one.

    Each class is one key a split, a hash of the words that the split takes.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                l_hash, l_size = _prefix_hashes(b.column("l"), rest, 1)
                r_hash, r_size = _prefix_hashes(b.column("r"), rest, 2)
                a = np.arange(rest + 1)
                key = mix(b.column("g").to_numpy().view(np.uint64)[:, None] + mix(l_hash[:, a] + np.uint64(3)) + mix(r_hash[:, rest - a] * np.uint64(5) + a.astype(np.uint64)))
                ok = (l_size[:, None] >= a) & (r_size[:, None] >= rest - a)
                row = pa.array(np.nonzero(ok)[0])
                yield pa.RecordBatch.from_arrays([b.column("class").take(row), b.column("low").take(row), signed(key[ok]), pa.array(np.broadcast_to(a, ok.shape)[ok].astype(np.int32))], ["class", "low", "key", "a"])

    form, pick = "class long, low long, key long, a int", ["class", "low", "g", "l", "r"]
    met = others.select(pick).mapInArrow(keys, form).groupBy("key").agg(F.count("*").alias("n"), F.min("low").alias("low")).where("n > 1").select("key", "low")
    asked = left.select(pick).mapInArrow(keys, form).select("class", "key", "a").join(met, "key")
    return asked.groupBy("class").agg(F.max("a").alias("a"), (rest - F.min("a")).cast("int").alias("b"), F.min("low").alias("low"))


def _prefix_hashes(column: pa.Array, most: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first 0 .. most words of each context, and how many words it has."""
    words, size = _words_of(column, max(int(pc.max(pc.binary_length(column)).as_py() or 0) // 4, most))
    words = words.astype(np.uint64)
    out = np.zeros((len(size), most + 1), np.uint64)
    for k in range(most):
        out[:, k + 1] = mix(out[:, k] + words[:, k] + np.uint64(salt << 40))
    return out, size
