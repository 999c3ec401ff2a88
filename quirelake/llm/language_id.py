"""Language identification by multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams of every labelled row (no sample) into ``2**BITS`` buckets per language;
counts leave the executors as (language, bucket, count) sums, so what reaches the driver is
bounded by buckets x languages whatever the input is. ``predict`` broadcasts the log-probability
matrix, of that same bounded size, and scores Arrow batches in numpy.

Cases: null text or text without a letter gives ``und`` with score 0; an empty model gives
``und`` everywhere; repeated rows are scored each; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, slices

BITS = 15
ORDERS = (1, 2, 3)
ALPHA = 0.1
#: More labels than this are an error, not a silent cut: the matrix must stay small to broadcast.
MAX_LABELS = 512
UNKNOWN = "und"
#: Characters of a long text that are looked at together; n-grams across such a border are left out, in training and scoring alike.
PIECE = 1 << 16
_STEP = 256 << 10


@dataclass
class Model:
    labels: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # (buckets and a row of zeros, labels), float32


def _letters() -> np.ndarray:
    """Per BMP code point: itself when it is a letter, otherwise one common separator."""
    points = np.arange(1 << 16, dtype=np.uint32)
    keep = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    points[~keep] = 32
    return points


_TABLE: list[np.ndarray] = []


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The texts of a batch, long ones cut into pieces of ``PIECE`` characters, a bounded number of bytes at a time.

    Row of each text or piece, and the texts. What a piece needs doesn't grow with the text it is from.
    """
    text = pc.fill_null(batch.column(column), "")
    size = pc.binary_length(text).to_numpy(zero_copy_only=False)
    long = size > 4 * PIECE
    group = np.cumsum(np.where(long, 0, size), dtype=np.int64) // _STEP
    for g in np.unique(group[~long]):
        rows = np.flatnonzero((group == g) & ~long)
        yield rows, text.take(pa.array(rows))
    for r in np.flatnonzero(long).tolist():
        one = text[r].as_py()
        for at in range(0, len(one), PIECE):
            yield np.array([r]), pa.array([one[at : at + PIECE]], pa.string())


def _grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every row, and the offsets of rows; an n-gram stays in its row."""
    if not _TABLE:
        _TABLE.append(_letters())
    low = pc.utf8_lower(text)
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    joined = "\n".join(low.to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 1 << 16, _TABLE[0][np.minimum(points, 0xFFFF)], points)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)  # runs of separators count once
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    keep[offsets[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    points, offsets = points[keep].astype(np.uint64), kept[offsets]
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(points))
    out = np.empty((len(points), len(ORDERS)), np.int32)
    run = np.zeros(len(points), np.uint64)
    for k, order in enumerate(ORDERS):
        ahead = np.zeros(len(points), np.uint64)
        ahead[: len(points) - order + 1] = points[order - 1 :]
        run *= np.uint64(0x100000001B3)
        run += ahead + np.uint64(1)
        bucket = (mix(run + np.uint64(order << 56)) >> np.uint64(64 - BITS)).astype(np.int32)
        out[:, k] = np.where(order <= room, bucket, -1)
    return out, offsets


def fit(df: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Count n-grams of all rows whose text and label are not null."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label")).where("text is not null and label is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            codes = batch.column("label").dictionary_encode()
            code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            for k, name in enumerate(names):
                sums.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))[-1] += int((code == k).sum())
            for rows_, texts in _pieces(batch, 0):
                grams, offsets = _grams(texts)
                which = np.repeat(code[rows_], np.diff(offsets))
                for k in np.unique(code[rows_]).tolist():
                    own = grams[which == k].ravel()
                    sums[names[k]][:-1] += np.bincount(own[own >= 0], minlength=1 << BITS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["label", "bucket", "n"])

    counted = rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    try:
        labels = sorted(r[0] for r in counted.select("label").distinct().limit(MAX_LABELS + 1).collect())
        if len(labels) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
        if not labels:
            return Model([], np.zeros(0), np.zeros((1 << BITS | 1, 0), np.float32))
        found = counted.toArrow()
    finally:
        counted.unpersist()
    matrix = np.zeros(((1 << BITS) + 1, len(labels)))
    where = pc.index_in(found["label"], pa.array(labels)).to_numpy()
    matrix[found["bucket"].to_numpy(), where] = found["n"].to_numpy()
    grams = matrix[:-1] + ALPHA
    log_p = np.vstack([np.log(grams / grams.sum(axis=0)), np.zeros(len(labels))])
    return Model(labels, np.log(matrix[-1] / matrix[-1].sum()), np.asfortranarray(log_p, np.float32))


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the likeliest label and its posterior probability to every row.

    Columns of ``df`` that have these names are replaced.
    """
    df = df.drop(lang, score)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in slices(batches, text):
            column = batch.column(place)
            names = np.full(len(column), UNKNOWN, object)
            scores = np.zeros(len(column))
            has = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if m.labels and has.any():
                total = np.tile(m.prior, (len(column), 1))
                for rows, texts in _pieces(batch, place):
                    grams, offsets = _grams(texts)
                    for k in range(len(ORDERS)):
                        at = grams[:, k]
                        for c in range(len(m.labels)):
                            total[rows, c] += np.add.reduceat(m.log_p[:, c][at], offsets[:-1], dtype=np.float64)
                best = total.argmax(axis=1)
                spread = np.exp(total - total.max(axis=1, keepdims=True))
                names[has] = np.array(m.labels, object)[best[has]]
                scores[has] = (1 / spread.sum(axis=1))[has]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [f.name for f in schema])

    return df.mapInArrow(guess, schema)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows kept from training: crc32 of the id's decimal text, by remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
