"""How far the sources of each language are from each other and from the language, by the terms that they use.

Terms are runs of ASCII letters and bytes from 0x80 on, A-Z lower-cased. A numpy lookup table over the concatenated UTF-8 bytes of a slice finds
where they begin and end, xxhash groups the slices of bytes between, and every slice is compared byte by byte with the one that stands for its
group. What leaves a task are counts of (language, source, term); Spark sums them up. A language keeps the terms of at least ``min_docs``
of its documents.

With count c of a group's N occurrences and V kept terms, p = 1 + floor(10^9 (c + 1) / (N + V)), which is the same whatever the sizes, in
integers. The sum over all kept terms of floor((p - q)^2 / q) between two sources has three kinds of terms. Where both counts are zero the value is a
constant of the pair. Where one is, it depends on the other's count alone: how many terms have a count is a histogram of the source, and it meets the
distinct probabilities of absent terms, not the other sources. Where both are there, blocks of terms by sources in CSR form give all pairs of a row, summed
up by pair with ``np.add.reduceat``.

Cases: null text, language and source count as empty; a group without terms takes part with zero counts; a language without kept
terms has pairs of value 0 and no terms; repeated rows count each; an empty table gives an empty result; other columns are not returned. Values are
64-bit: a sum of squares of p is under (10^9 + 2 V)^2 and stays below 2^63 up to 10^9 kept terms; beyond it Spark's arithmetic is an error, not a wrong value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import same_bytes, sized, slices, stored, text_bytes, texts_at

MIN_DOCS = 3
TOP = 200
ONE = 1_000_000_000
#: Bytes of text that are counted together before their counts leave a task.
_SLICE = 4 << 20
#: Pairs of counts that are looked at together.
_PAIRS = 1 << 19
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- counts --------------------------------------------------------------------


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, begin and end of each term in them, and the row that it is in."""
    raw, rows = text_bytes(column)
    inside = _TERM[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = ~inside[:-1]
    edge[rows] = True
    start = np.flatnonzero(inside & edge[:-1])
    edge[:-1] = ~inside
    edge[rows] = True
    end = np.flatnonzero(inside & edge[1:]) + 1
    return _LOWER[raw], start, end, np.searchsorted(rows, start, "right") - 1


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    data, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice: lang, source, term, n occurrences and docs with the term; the term '' has the documents themselves."""
    for b in slices(batches, limit=_SLICE):
        raw, start, end, row = terms(b.column("text"))
        code, member = same_bytes(raw, start, end, _hashes(raw, start, end))
        lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
        per = len(source.dictionary)
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * per + source.indices.to_numpy(zero_copy_only=False)
        size = len(member) + 1  # the last code stands for the document
        # one key a (document, term), then one a (group, term)
        own, n = np.unique(row * size + code, return_counts=True)
        own = np.concatenate((own, np.arange(len(group)) * size + size - 1))
        n = np.concatenate((n, np.zeros(len(group), np.int64)))
        key = group[own // size] * size + own % size
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            continue
        total, docs = np.add.reduceat(n, first), np.diff(np.append(first, len(key)))
        at, term = key[first] // size, key[first] % size
        texts = pa.concat_arrays([texts_at(raw, start[member], end[member]), pa.array([""], pa.string())])
        columns = [lang.dictionary.take(pa.array(at // per)), source.dictionary.take(pa.array(at % per)), texts.take(pa.array(term)), pa.array(total.astype(np.int64)), pa.array(docs.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) of all documents; the term '' has the number of documents of each group."""
    own = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    told = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return told.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- probabilities and distances -------------------------------------------------


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) for count <= total, by long division in steps of 1000, so that no product passes 64 bits."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = F.pmod(rest * 1000, total)
    return out + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(len(count), np.int64), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms as CSR rows (lang, cells of source, n, total): what pairs of sources that both have a term add beyond the values without it."""
    for b in batches:
        if not b.num_rows:
            continue
        cells = b.column("cells")
        width = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = cells.flatten()
        source = flat.field("source").dictionary_encode()
        lang = b.column("lang").dictionary_encode()
        s = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n, total = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "total"))
        p, zero = _share(n + 1, total), _share(np.ones(len(n), np.int64), total)
        first = np.cumsum(width) - width
        row = np.repeat(np.arange(len(width)), width)
        of_lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        size = len(source.dictionary)
        sums: dict[int, tuple[int, int]] = {}
        # every cell meets all cells of its row; so many cells at once that their pairs fit
        reach = np.cumsum(width[row])
        at = 0
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _PAIRS)))
            per = width[row[at:to]]
            i = np.repeat(np.arange(at, to), per)
            begin = first[row[at:to]]
            ahead = np.cumsum(per) - per
            j = np.arange(len(i)) + np.repeat(begin - ahead, per)
            i, j = i[i != j], j[i != j]
            at = to
            if not len(i):
                continue
            f = lambda x, q: (x - q) * (x - q) // q
            more = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
            key = (of_lang[i] * size + s[i]) * size + s[j]
            order = np.argsort(key, kind="stable")
            key, more = key[order], more[order]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for k, v in zip(key[cut].tolist(), np.add.reduceat(more, cut).tolist()):
                sums[k] = sums.get(k, 0) + v
        keys = np.array(list(sums), np.int64)
        columns = [lang.dictionary.take(pa.array(keys // size // size)), source.dictionary.take(pa.array(keys // size % size)), source.dictionary.take(pa.array(keys % size)), pa.array(list(sums.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "more"])


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language with its distance, all of them. Part ``term``: the terms that the source uses more than its
    language does, the ``top`` most distant ones. Ranks go by value, largest first, then by the item's bytes.
    """
    all_counts = stored(counts(df, text, lang, source))
    # CSR rows: a term of a language with the sources that have it
    cells = F.collect_list(F.struct("source", "n"))
    rows = all_counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), cells.alias("cells"))
    rows = stored(rows.where(F.col("docs") >= min_docs).drop("docs"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_n"))
    flat = rows.select("lang", "term", F.col("n").alias("lang_term_n"), F.inline("cells"))
    per = flat.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("present"))
    groups = all_counts.where("term = ''").select("lang", "source").join(per, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("present", "kept", "lang_n")], (F.coalesce("n", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("total"))
    groups = stored(groups.withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(1).cast("long"), F.col("total")))))
    known = sized(groups.where("kept > 0").select("lang", "source", "total", "kept", "lang_n", "zero"))
    cell = stored(flat.join(known, ["lang", "source"]).select("lang", "term", "source", "n", "total", "lang_term_n", (F.col("lang_n") + F.col("kept")).alias("lang_total")))

    p, q = share(F.col("n") + 1, F.col("total")), share(F.col("lang_term_n") + 1, F.col("lang_total"))
    told = cell.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    told = told.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))
    # the largest of each of 16 parts of a group first, so that no task has to rank a group whole
    some = told.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(16)))
    some = _ranked(some, ["lang", "source", "_part"]).where(F.col("rank") <= top).drop("_part", "rank")
    best = _ranked(some, ["lang", "source"]).where(F.col("rank") <= top)

    csr = cell.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "total")).alias("cells")).select("lang", "cells")
    both = csr.mapInArrow(_met, "lang string, source string, item string, more long").groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    pairs = _pairs(groups, cell).join(both, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", "item", (F.col("value") + F.coalesce("more", F.lit(0))).alias("value"))
    pairs = _ranked(pairs, ["lang", "source"])

    name = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return name(pairs, "pair").unionByName(name(best, "term"))


def _ranked(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item")))


def _pairs(groups: DataFrame, cell: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources as if no term were in both: terms of one, terms of the other, terms of neither."""
    histogram = stored(cell.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("k")).withColumn("p", share(F.col("n") + 1, F.col("total"))))
    absent = groups.where("kept > 0").select("lang", F.col("zero").alias("z")).distinct()
    sums = histogram.join(absent, "lang").groupBy("lang", "source", "z")
    sums = stored(sums.agg(F.sum(F.col("k") * apart(F.col("p"), F.col("z"))).alias("ahead"), F.sum(F.col("k") * apart(F.col("z"), F.col("p"))).alias("behind")))
    one = groups.select("lang", "source", "present", "kept", "zero")
    two = groups.select("lang", F.col("source").alias("item"), F.col("present").alias("other"), F.col("zero").alias("z"))
    pairs = one.join(two, "lang").where("source <> item")
    ahead = sums.select("lang", "source", "z", "ahead")
    behind = sums.select("lang", F.col("source").alias("item"), F.col("z").alias("zero"), "behind")
    pairs = pairs.join(ahead, ["lang", "source", "z"], "left").join(behind, ["lang", "item", "zero"], "left")
    none = F.when(F.col("kept") > 0, (F.col("kept") - F.col("present") - F.col("other")) * apart(F.col("zero"), F.col("z")))
    zero = F.lit(0).cast("long")
    return pairs.select("lang", "source", "item", (F.coalesce("ahead", zero) + F.coalesce("behind", zero) + F.coalesce(none, zero)).alias("value"))
