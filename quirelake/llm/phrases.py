"""Phrase collocations: word sequences that stand together more often than their parts alone would.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and identical pieces of a language become one with a
multiplicity. N-grams of the pieces are counted with these weights: a task sums up what its slices have, the sums are dealt by the hash of language and phrase, and each
bucket is grouped by duckdb, which has a fixed memory and spills to scratch files of the task that go when it ends. Lengths are counted level by level: an n-gram is counted only
where all its words, then all its pairs, may be frequent, which bitmaps tell that never miss a frequent one. They have 16 bits a frequent
n-gram up to ``MAX_BITS``; when they are full they let more through and nothing changes in the result.

Parts of candidates are frequent too, so both parts of each cut are asked for by a shuffled join with the counted n-grams, and the answers of a
phrase meet again by its name. Counts and scores are integers or decimals throughout.

Cases: null text counts as empty, null language as ``und``; repeated rows count each; texts without words and empty tables give no
rows; other columns are not returned; a language with fewer phrases than ``top`` has them all. A piece is never cut, however long.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from .common import Words, discard, mix, same_bytes, slices, spread, stored, text_bytes, texts_at

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
UNKNOWN = "und"
#: Bits of the largest bitmap that is sent to all tasks (16 MB).
MAX_BITS = 1 << 27
#: Memory that duckdb may use in a task before it spills.
MEMORY = "200MB"
_SLICE = 4 << 20
_BUCKET = 1 << 15
#: 0 word, 1 blank, 2 end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x09] = 0x20


# -- pieces ----------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (lang, piece, n) of each slice: words joined by one space, and how often the slice has them."""
    for b in slices(batches, limit=_SLICE):
        raw, rows = text_bytes(b.column("text"))
        kind = _KIND[raw]
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = kind[:-1] != 0
        edge[rows] = True
        start = np.flatnonzero((kind == 0) & edge[:-1])
        edge[:-1] = kind != 0
        edge[rows] = True
        end = np.flatnonzero((kind == 0) & edge[1:]) + 1
        if not len(start):
            continue
        row = np.searchsorted(rows, start, "right") - 1
        stops = np.searchsorted(np.flatnonzero(kind == 2), start)
        fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])))
        keep = kind == 0
        keep[end[:-1][~fresh[1:]]] = True  # the blank after a word that another follows in its piece
        text = _LOWER[raw[keep]]
        before = np.concatenate(([0], np.cumsum(keep)))
        bounds = np.append(before[start[fresh]], len(text))
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text))
        told = pa.table({"lang": b.column("lang").take(pa.array(row[fresh])), "piece": pieces}).group_by(["lang", "piece"]).aggregate([([], "count_all")])
        for part in told.select(["lang", "piece", "count_all"]).to_batches():
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), part.column(2)], ["lang", "piece", "n"])


def pieces(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Distinct pieces of each language with their multiplicity: lang, piece, n."""
    own = df.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"))
    return own.mapInArrow(_cut, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


# -- n-grams ----------------------------------------------------------------------


def _marks(words: np.ndarray, langs: np.ndarray, n: int) -> np.ndarray:
    """64-bit marks of the n words that begin at each, with their language; the last n - 1 are of no use."""
    total = langs.copy()
    for j in range(n):
        total[: len(words) - j] += words[j:] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    return mix(total)


def _lang_marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of each row's language in its batch, and a mark of it."""
    coded = column.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    marks = [xxhash.xxh3_64_intdigest(x.encode()) for x in coded.dictionary.to_pylist()]
    return code, np.array(marks, np.uint64)[code]


def _may(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    slot = (marks & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _counter(lengths: list[int], known: int, bits):
    """What a task has of n-grams: lang, phrase, n. ``bits`` is a broadcast bitmap of n-grams of ``known`` words, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for b in slices(batches, "piece", _SLICE):
            w = Words(b.column("piece"))
            per = w.counts
            row = np.repeat(np.arange(len(per)), per)
            lang, lang_mark = _lang_marks(b.column("lang"))
            weight = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            word, _ = same_bytes(w.raw, w.start, w.end, w.hash)
            left = np.repeat(w.first[1:], per) - np.arange(len(row))  # words from here to the piece's end
            sure = _may(table, _marks(w.hash, lang_mark[row], known)) if table is not None else None
            if known in lengths:
                raise ValueError("the bitmap is for shorter n-grams than those counted")
            for n in lengths:
                fit = left >= n
                if sure is not None:
                    for j in range(n - known + 1):
                        fit[: len(fit) - j] &= sure[j:]
                at = np.flatnonzero(fit)
                if not len(at):
                    continue
                code, top = lang[row[at]], int(lang.max()) + 1
                for j in range(n):
                    size = int(word.max()) + 1
                    if top * size >= 1 << 62:
                        code, unique = pd.factorize(code)
                        code, top = code.astype(np.int64), len(unique)
                    code, top = code * size + word[at + j], top * size
                code, unique = pd.factorize(code)
                member = np.zeros(len(unique), np.int64)
                member[code[::-1]] = at[::-1]
                m = weight[row[at]]
                # exact in doubles: a slice has under 2^22 words, so sums of 31-bit halves stay below 2^53
                total = np.bincount(code, m & 0x7FFFFFFF, len(unique)).astype(np.int64) + (np.bincount(code, m >> 31, len(unique)).astype(np.int64) << 31)
                texts = texts_at(w.raw, w.start[member], w.end[member + n - 1])
                yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(row[member])), texts, pa.array(total)], ["lang", "phrase", "n"])
            if lengths[0] == 1:  # all words of each language, under the empty phrase
                told = np.zeros(int(lang.max()) + 1, np.int64)
                np.add.at(told, lang, per * weight)
                code, first = np.unique(lang, return_index=True)
                yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(first)), pa.array([""] * len(first), pa.string()), pa.array(told[code])], ["lang", "phrase", "n"])

    return run


def _bucket(least: int, memory: str = MEMORY):
    """Sums of (lang, phrase, n) rows of one hash bucket by duckdb; those of at least ``least``, and those of the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        scratch = tempfile.mkdtemp(prefix="phrases-")
        try:
            with duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
                con.register("counted", pa.RecordBatchReader.from_batches(first.schema, rest()))
                found = con.sql(f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY lang, phrase HAVING sum(n) >= {int(least)} OR phrase = ''")
                for b in found.to_arrow_reader(100_000):
                    yield b
        finally:
            shutil.rmtree(scratch, ignore_errors=True)
            pa.default_memory_pool().release_unused()

    return run


def _bitmap(frequent: DataFrame, n: int):
    """A broadcast bitmap of the marks of n-grams, and how many bytes it has: 16 bits each, at most ``MAX_BITS``."""
    spark, size = frequent.sparkSession, _BUCKET
    count = frequent.count()
    while size < min(MAX_BITS, 16 * count):
        size *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = Words(b.column("phrase"))
                _, lang = _lang_marks(b.column("lang"))
                marks = _marks(w.hash, np.repeat(lang, w.counts), n)[w.first[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array((marks & np.uint64(size - 1)).astype(np.int64) + 1)], ["slot"])

    told = frequent.select("lang", "phrase").mapInArrow(slots, "slot long")
    told = told.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for k, part in told.collect():
        bits[(k - 1) * _BUCKET // 8 : k * _BUCKET // 8] = np.frombuffer(bytes(part), np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def frequent(df: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> list[DataFrame]:
    """For pieces (lang, piece, n): tables (lang, phrase, n) of the n-grams of 1, 2, and 3 to ``longest`` words with at least ``min_count`` occurrences.

    The first also has the number of all words of each language, as the empty phrase.
    """
    buckets, out, bits, known = spread(df.sparkSession), [], None, 0
    for lengths in [[1], [2], list(range(3, longest + 1))]:
        if not lengths:
            continue
        part = df.mapInArrow(_counter(lengths, known, bits), "lang string, phrase string, n long")
        part = part.repartition(buckets, "lang", "phrase").mapInArrow(_bucket(min_count), "lang string, phrase string, n long")
        out.append(stored(part))
        known = lengths[-1]
        if known <= 2:
            bits = _bitmap(out[-1].where("phrase <> ''"), known)
    return out


# -- collocations ------------------------------------------------------------------


def score(a: Column, both: Column) -> Column:
    """floor(2000000 a / (l + r)), in decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(both))


def mine(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of the phrase and of the two parts of its lowest-scoring cut; n is the number of words of the language. A phrase
    that lies in a longer candidate with at least 80 % of its occurrences is left out.
    """
    source = stored(pieces(df, text, lang))
    counted = frequent(source, min_count, longest)
    discard(source)
    grams = counted[0]
    for more in counted[1:]:
        grams = grams.unionByName(more)
    words = F.split("phrase", " ")
    candidates = stored(counted[1].unionByName(counted[2]) if len(counted) > 2 else counted[1])
    candidates = candidates.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    # both parts of each cut are asked for where the part's count is
    cuts = F.sequence(F.lit(1), F.size("w") - 1)
    part = lambda k, side: F.struct(k.alias("k"), F.lit(side).alias("side"), F.array_join(F.slice("w", 1, k) if side == "l" else F.slice("w", k + 1, F.size("w") - k), " ").alias("part"))
    asked = candidates.select("lang", "phrase", "a", F.inline(F.concat(F.transform(cuts, lambda k: part(k, "l")), F.transform(cuts, lambda k: part(k, "r")))))
    known = grams.where("phrase <> ''").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    told = asked.join(known, ["lang", "part"])
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}")
    met = told.groupBy("lang", "phrase", "a").agg(*[side(k, s) for k in range(1, longest) for s in "lr"])
    options = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(F.col("a"), F.col(f"l{k}") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    lowest = F.least(*options) if len(options) > 1 else options[0]
    scored = met.select("lang", "phrase", "a", lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # the longest way up goes word by word: what lies in a longer candidate lies in one of one word more that occurs at least as often
    inner = F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1))
    over = candidates.where(F.size("w") > 2).select("lang", F.col("a").alias("f"), F.explode(inner).alias("v"))
    over = over.groupBy("lang", F.array_join("v", " ").alias("phrase")).agg(F.max("f").alias("f"))
    own = scored.join(over, ["lang", "phrase"], "left").where(F.col("f").isNull() | (F.col("f").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * 80)).drop("f")
    ranked = ranges.placed(stored(own), ["lang"], [-F.col("score"), -F.col("a"), "phrase"], "rank").where(F.col("rank") <= top)
    total = counted[0].where("phrase = ''").select("lang", F.col("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
