"""Best-fit packing of token sequences into rows of a fixed length.

``tokenize`` gives each document's ids; ``pieces`` cuts what is longer than the capacity;
``plan`` solves the packing over the histogram of piece lengths alone, so its size depends on
the capacity and never on the number of pieces; ``pack`` deals pieces to the planned places.

The plan is the configuration linear program of bin packing (minimise the bins used, every
length class covered). Its first columns are the configurations of best fit, its first prices the classes' lengths. A
knapsack dynamic program finds the configurations of the largest price, and with them the lower bound that the prices give; columns are
generated, with any number of classes, until the program is solved to a quarter of ``GAP`` or its columns are shown to be the fewest sequences. Fractions are
rounded down and what is left is solved again; what rounding leaves is packed by best fit or by multiplicative weights (prices fall on
classes that are served, the configuration of the largest price is used in part, until every class is covered), whichever needs fewer.

Cases: null text counts as empty; an empty table gives an empty result; repeated rows are packed
each; equal lengths are interchangeable, so ties only permute places; a length of the
capacity fills a sequence alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import compiled
from .common import list_array, ragged, slices, stored, text_bytes

CAPACITY = 4096
_SLICE = 4 << 20
#: The program is solved to a quarter of this share of its lower bound.
GAP = 0.001
#: The knapsack's share of its bound that may be missing; classes that it looks at first.
NEAR, FIRST = 0.002, 64
#: Price starts: a class is worth its share of the capacity to this power, and how sharply prices fall with what is served.
GUESSES = ((1.1, 0.3), (1.0, 1.0), (1.1, 8.0))


# -- tokens -------------------------------------------------------------------


class WordBpe:
    """Ids of a BPE vocabulary file with word ends, as the tokenizers library gives them.

    Only distinct pre-tokens of a batch are merged, all of them at once: each step joins the
    best-ranked (leftmost) pair of every pre-token that still has one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.match = compiled(split + r"|\n")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        if any(t[x] for t in spec.get("added_tokens") or () for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be matched as they are")
        self.added = added
        #: Added tokens are found in the text as it is, before anything else.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        shown = _byte_letters()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        mask = (1 << 21) - 1
        self.mask, self.slot_key, self.slot_rank = mask, np.full(mask + 1, -1, np.int64), np.full(mask + 1, _NONE, np.int32)
        for rank, k in enumerate(key.tolist()):
            at = _slot(k, mask)
            while self.slot_key[at] >= 0 and self.slot_key[at] != k:
                at = (at + 1) & mask
            if self.slot_key[at] < 0:
                self.slot_key[at], self.slot_rank[at] = k, rank
        self.made = made
        self.far = 1
        used = self.slot_key >= 0
        home = _slots(self.slot_key[used], mask)
        self.far = int(((np.flatnonzero(used) - home) & mask).max()) + 1

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number past all ranks."""
        key = a.astype(np.int64) * self.size + b
        at = _slots(key, self.mask)
        out = np.where(self.slot_key[at] == key, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.slot_key[at] >= 0))
        for step in range(1, self.far):
            if not len(open_):
                break
            now = (at[open_] + step) & self.mask
            hit = self.slot_key[now] == key[open_]
            out[open_[hit]] = self.slot_rank[now[hit]]
            open_ = open_[~hit & (self.slot_key[now] >= 0)]
        return out

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has; words are not empty."""
        raw, rows = text_bytes(words)
        size = np.diff(rows)
        counts = np.zeros(len(size), np.int64)
        found = []
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            width = int(size[order[at]])
            to = int(np.searchsorted(size[order], max(width + width // 3, 4), "right"))
            to = min(to, at + max(1, 4_000_000 // max(int(size[order[to - 1]]), 1)))
            own = order[at:to]
            ids, n = self._merge(raw, rows[own], size[own])
            counts[own] = n
            found.append((own, ids))
            at = to
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for own, ids in found:
            flat[ragged(first[own], counts[own])] = ids
        return flat, counts

    def _merge(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(size), int(size.max())
        column = np.arange(width)
        inside = column[None, :] < size[:, None]
        table = np.full((n, width), -1, np.int32)
        table[inside] = self.inner[raw[ragged(start, size)]]
        table[np.arange(n), size - 1] = self.final[raw[start + size - 1]]
        left = size.copy()
        rank = np.full((n, max(width - 1, 1)), _NONE, np.int32)
        if width > 1:
            both = inside[:, 1:]
            rank[both] = self.rank(table[:, :-1][both], table[:, 1:][both])
        done_ids, live = np.full((n, width), -1, np.int32), np.arange(n)
        while len(live):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(live)), best]
            more = value != _NONE
            if not more.all():
                out = ~more
                done_ids[live[out], : table.shape[1]] = table[out]
                live, table, rank, best, value = live[more], table[more], rank[more], best[more], value[more]
                if not len(live):
                    break
            row = np.arange(len(live))
            table[row, best] = self.made[value]
            left[live] -= 1
            keep_t = np.ones(table.shape, bool)
            keep_t[row, best + 1] = False
            keep_r = np.ones(rank.shape, bool)
            keep_r[row, best] = False
            table = table[keep_t].reshape(len(live), -1)
            rank = rank[keep_r].reshape(len(live), -1) if rank.shape[1] > 1 else np.full((len(live), 1), _NONE, np.int32)
            for side in (best - 1, best):
                ok = (side >= 0) & (side + 1 < left[live])
                r, c = row[ok], side[ok]
                rank[r, c] = self.rank(table[r, c], table[r, c + 1])
            if rank.shape[1] > 1 or table.shape[1] > 1:
                past = best >= left[live] - 1
                rank[row[past], np.minimum(best[past], rank.shape[1] - 1)] = np.where(best[past] < rank.shape[1], _NONE, rank[row[past], np.minimum(best[past], rank.shape[1] - 1)])
        return done_ids[done_ids >= 0], left

    def __call__(self, text: pa.Array) -> pa.ListArray:
        """Ids of every text; null counts as empty, added tokens inside a text are ids of their own."""
        text = pc.fill_null(text, "")
        odd = np.zeros(len(text), bool)
        for content in self.added:
            odd |= pc.match_substring(text, content).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(text)
        parts = [self.split.split(t) for t in text.filter(pa.array(odd)).to_pylist()]  # text, token, text, ...
        between = iter(self._plain(pa.array([x for p in parts for x in p[::2]], pa.string())).to_pylist())
        with_tokens = [[i for k, x in enumerate(p) for i in ([self.added[x]] if k % 2 else next(between))] for p in parts]
        both = pa.concat_arrays([self._plain(text.filter(pa.array(~odd))), pa.array(with_tokens, pa.list_(pa.int32()))])
        place = np.empty(len(text), np.int64)
        place[~odd], place[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
        return both.take(pa.array(place))

    def _plain(self, text: pa.Array) -> pa.ListArray:
        split = pc.ascii_split_whitespace(text)
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        tokens, word_tokens = self._latin(coded.dictionary) or self._any(coded.dictionary)
        found = tokens.dictionary_encode()
        which = found.indices.to_numpy(zero_copy_only=False)
        flat, per = self.merge(found.dictionary) if len(found.dictionary) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        begin = np.cumsum(per) - per
        size = per[which]
        ids = flat[ragged(begin[which], size)]
        bound = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(word_tokens)))]
        n = np.diff(bound)[code]
        values = ids[ragged(bound[:-1][code], n)]
        bound = np.concatenate(([0], np.cumsum(n)))
        return list_array(pa.array(values, pa.int32()), np.diff(bound[split.offsets.to_numpy() - split.offsets[0].as_py()]))

    def _any(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of normalised words, and how many each word has, by the pattern itself."""
        joined = "\n".join(words.to_pylist())
        joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower()
        found = np.array(self.match.findall(joined), object)
        breaks = found == "\n"
        per = np.bincount(np.cumsum(breaks)[~breaks], minlength=len(words)) if len(found) else np.zeros(len(words), np.int64)
        return pa.array(found[~breaks], pa.string()), per

    def _latin(self, words: pa.Array) -> tuple[pa.Array, np.ndarray] | None:
        """The same from the bytes of words without code points past U+00FF; None if there are others."""
        raw, rows = text_bytes(words)
        if len(raw) and raw.max() >= 0xC4:
            return None
        lead = raw >= 0xC2
        after = np.zeros(len(raw), bool)
        after[1:] = lead[:-1]
        raw = _LOWER[raw]
        upper = np.flatnonzero(after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97))
        upper = upper[raw[upper - 1] == 0xC3]
        raw[upper] += 0x20
        point = raw.astype(np.int64)
        at = np.flatnonzero(lead)
        point[at] = (point[at] & 3) << 6 | point[at + 1] & 0x3F
        kind = _KIND[point]
        kind[after] = kind[np.flatnonzero(after) - 1]
        start = np.ones(len(raw) + 1, bool)
        start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start[:-1][rows[:-1][rows[:-1] < len(raw)]] = True
        for i in np.flatnonzero((raw == 39) & start[:-1]).tolist():
            stop = int(rows[np.searchsorted(rows, i, "right")])
            rest = raw[i + 1 : min(i + 3, stop)].tobytes()
            long = 1 if rest[:1] in (b"s", b"t", b"m", b"d") else 2 if rest in (b"re", b"ve", b"ll") else 0
            if long:
                start[i + 1] = False
                start[i + 1 + long] = True
        start[:-1][after] = False
        begin = np.flatnonzero(start)
        white = kind[np.minimum(begin[:-1], len(raw) - 1)] == 0 if len(raw) else np.zeros(0, bool)
        per = np.diff(np.searchsorted(begin, rows))
        tokens = pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(raw))
        if white.any():
            tokens = tokens.filter(pa.array(~white))
            per = np.diff(np.concatenate(([0], np.cumsum(~white)))[np.searchsorted(begin, rows)])
        return tokens, per


def _kinds() -> np.ndarray:
    """Of code points up to U+00FF: 0 white space, 1 letter, 2 number, 3 other."""
    shape = {"L": 1, "N": 2}
    kinds = np.array([shape.get(unicodedata.category(chr(c))[0], 3) for c in range(256)], np.int8)
    kinds[[0x20, *range(0x09, 0x0E), 0x85, 0xA0]] = 0
    return kinds


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NONE = np.iinfo(np.int32).max


def _slots(key: np.ndarray, mask: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64) & mask


def _slot(key: int, mask: int) -> int:
    return ((key * 0x9E3779B97F4A7C15) % (1 << 64) >> 43) & mask


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def tokenize(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` in place of the text."""
    place = df.columns.index(text)
    schema = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType())) if i == place else f for i, f in enumerate(df.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_bpe(path)
        for b in slices(batches, text, _SLICE):
            yield pa.RecordBatch.from_arrays([t(c) if i == place else c for i, c in enumerate(b.columns)], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def _cut(key: pa.Array, lists: pa.ListArray, end: int | None, capacity: int) -> list[pa.Array]:
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    if end is not None:
        flat = np.insert(flat, np.cumsum(n), end).astype("<u4")
        n = n + 1
    count = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    length = np.minimum(capacity, n[row] - start)
    begin = (np.cumsum(n) - n)[row] + start
    crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(begin.tolist(), length.tolist())]
    ids = list_array(pa.array(flat.view(np.int32)), length)
    return [key.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), ids]


def pieces(df: DataFrame, key: str = "doc_id", ids: str = "ids", end: int | None = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: key, piece, start, length, ids_crc32 and the ids.

    ``end`` is put after each document's ids; null ids count as none.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([rows.schema["key"], *_PIECE, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(_cut(b.column("key"), b.column("ids"), end, capacity), schema.names)

    return rows.mapInArrow(run, schema)


def text_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = 1, capacity: int = CAPACITY) -> DataFrame:
    """``tokenize`` and ``pieces`` in one pass over the texts, without the ids themselves."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["key"], *_PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_bpe(path)
        for b in slices(batches, "text", _SLICE):
            yield pa.RecordBatch.from_arrays(_cut(b.column("key"), t(b.column("text")), end, capacity)[:-1], schema.names)

    return rows.mapInArrow(run, schema)


_PIECE = [T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]


# -- plan ---------------------------------------------------------------------


def _price(size: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic program over capacity: how many of each class fill it at the largest worth.

    The classes of most worth for their size and the shortest come first. Copies are split into powers of two, so no class
    is used beyond its supply. The program looks at every class, and ends early within ``NEAR`` of the bound that fractions of copies give.
    """
    k = len(size)
    order = np.argsort(-worth / size, kind="stable")
    whole = np.cumsum(size[order] * most[order])
    full = int(np.searchsorted(whole, capacity, "right"))
    bound = float((worth[order[:full]] * most[order[:full]]).sum())
    if full < k:
        bound += (capacity - (whole[full - 1] if full else 0)) * float(worth[order[full]] / size[order[full]])
    n = min(k, FIRST)
    head = np.stack([order[:n], np.argsort(size, kind="stable")[:n]], axis=1).ravel()
    head = head[np.sort(np.unique(head, return_index=True)[1])][:n]
    turns = np.concatenate([head, order[~np.isin(order, head)]])
    best, taken = np.zeros(capacity + 1), []
    for t, i in enumerate(turns.tolist()):
        if t % 8 == 0 and best[-1] >= (1 - NEAR) * bound:
            break
        room, copies = int(min(most[i], capacity // size[i])), 1
        while room > 0:
            use = min(copies, room)
            w = int(size[i]) * use
            with_it = best[: capacity + 1 - w] + worth[i] * use
            won = with_it > best[w:] + 1e-15
            taken.append((i, use, w, won))
            best[w:] = np.where(won, with_it, best[w:])
            room -= use
            copies *= 2
    count, at = np.zeros(k, np.int64), int(best.argmax())
    for i, use, w, won in reversed(taken):
        if at >= w and won[at - w]:
            count[i] += use
            at -= w
    return count


def lower_bound(size: np.ndarray, count: np.ndarray, worth: np.ndarray, capacity: int) -> float:
    """Sequences that any plan needs, by the prices ``worth`` of the classes: what all pieces are worth, in the dearest fill of one.

    The dearest fill is found by a dynamic program over all classes, each without limit.
    """
    price = np.full(capacity + 1, -np.inf)
    price[size] = worth
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max(best[room - 1], (best[:room][::-1] + price[1 : room + 1]).max())
    return float((worth * count).sum() / best[-1])


def _best_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations for what is left: longest first, then the longest that still fits, repeated while it can be."""
    left, out, on = left.copy(), [], np.flatnonzero(left)
    while len(on):
        own, room, k, used = size[on], capacity, len(on), []
        while (k := int(np.searchsorted(own[:k], room, "right")) - 1) >= 0:
            n = min(int(left[on[k]]), room // int(own[k]))
            used.append((int(on[k]), n))
            room -= n * int(own[k])
        times = min(int(left[i]) // n for i, n in used)
        config = np.zeros(len(size), np.int64)
        for i, n in used:
            config[i] = n
            left[i] -= n * times
        out.append((config, times))
        on = on[left[on] > 0]
    return out


def plan(length: np.ndarray, count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Configurations (copies of each length class, times used) that cover the histogram exactly.

    length: distinct lengths, ascending; count: pieces of each. The plan with the fewest sequences counts.
    """
    return solved(length, count, capacity)[0]


def solved(length: np.ndarray, count: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[np.ndarray, int]], int]:
    """``plan``, and a lower bound of what any plan needs."""
    length, count = np.asarray(length, np.int64), np.asarray(count, np.int64)
    if not len(length):
        return [], 0
    best, bound = _whole(length, count, capacity)
    return best, int(np.ceil(bound - 1e-6))


def _fills(length: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The dearest fill of every room, by a dynamic program over all classes, each without limit: its worth, and the class put in last (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(length, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := int(fits[room]):
            all_ = best[room - length[:n]] + worth[:n]
            i = int(all_.argmax())
            if all_[i] > best[room]:
                best[room], last[room] = all_[i], i
    return best, last


def _filled(length: np.ndarray, last: np.ndarray, room: int, first: int) -> np.ndarray:
    """The configuration of ``_fills`` for a room, with one of class ``first`` beside it."""
    out = np.zeros(len(length), np.int64)
    out[first] += 1
    while room > 0:
        i = int(last[room])
        if i < 0:
            room -= 1
        else:
            out[i] += 1
            room -= int(length[i])
    return out


def _generated(length: np.ndarray, count: np.ndarray, capacity: int, first: list[tuple[np.ndarray, int]], gap: float = GAP / 4) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The configuration program by column generation: fractional uses that cover every class, and its lower bound.

    ``first`` is a plan in whole uses, whose configurations are the first columns. Configurations are priced between the prices of the simplex basis and
    those of the best bound so far (at first the lengths), which keeps prices from swinging; the dynamic program gives, for each class, the dearest configuration
    that holds it. It ends where ``first`` is shown to be the fewest sequences, where uses are within ``gap`` of the bound, or where no configuration is worth more than a sequence.
    """
    m, known, center = len(length), _bins(first), length / capacity
    best, last = _fills(length, center, capacity)
    bound, center = float(center @ count) / float(best[-1]), center / best[-1]
    if known <= np.ceil(bound - 1e-6):
        return [(a, float(t)) for a, t in first], bound
    need = count * (1 + 1e-7 * np.random.default_rng(0).random(m))  # tells apart bases that tie
    one = capacity // length
    pool, seen, n = np.zeros((4 * m + 1024, m), np.float32), set(), 0
    basis, cost, inverse, pivots = np.diag(one).astype(float), np.ones(m), np.diag(1.0 / one), 0
    x = inverse @ need

    def keep(a: np.ndarray) -> None:
        nonlocal pool, n
        if (key := a.astype(np.int16).tobytes()) not in seen:
            seen.add(key)
            if n == len(pool):
                pool = np.concatenate([pool, np.zeros_like(pool)])
            pool[n], n = a, n + 1

    def afresh() -> None:
        inverse[:] = np.linalg.inv(basis)
        x[:] = np.maximum(inverse @ need, 0)

    def enter(a: np.ndarray, c: float) -> bool:
        nonlocal pivots
        on = np.flatnonzero(a)
        way = inverse[:, on] @ a[on]
        up = np.flatnonzero(way > 1e-9)
        if c - cost @ way > -1e-9 or not len(up):
            return False
        r = up[(x[up] / way[up]).argmin()]
        step = x[r] / way[r]
        x[:] = np.maximum(x - step * way, 0)
        row, hit = inverse[r] / way[r], np.flatnonzero(way)
        inverse[hit] -= way[hit, None] * row
        inverse[r], x[r], cost[r], basis[:, r], pivots = row, step, c, a, pivots + 1
        if pivots % 200 == 0:
            afresh()
        return True

    def priced() -> np.ndarray:
        """Prices of the classes where no column that is known is worth more than a sequence."""
        while True:
            worth = cost @ inverse
            over, low = pool[:n] @ worth.astype(np.float32) - 1, int(worth.argmin())
            if worth[low] < -1e-9 and -worth[low] > over.max() and enter(-np.eye(1, m, low)[0], 0.0):  # more than the count of a class may be covered
                continue
            turns = [i for i in np.argsort(-over)[:8].tolist() if over[i] > 1e-5]
            if not sum([enter(pool[i].astype(float), 1.0) for i in turns]):
                return np.maximum(worth, 0)

    for i in range(m):
        keep(np.eye(1, m, i)[0] * one[i])
    for a, _ in first:
        keep(a)
    while known > np.ceil(bound - 1e-6):
        worth, before = priced(), n
        if float(cost @ x) <= bound * (1 + gap):
            break
        for share in (0.9, 0.6, 0.3, 0.0):
            mix = share * center + (1 - share) * worth
            best, last = _fills(length, mix, capacity)
            if (low := float(mix @ count) / max(float(best[-1]), 1e-12)) > bound:
                bound, center = low, mix / best[-1]
            each = mix + best[capacity - length]
            for i in np.argsort(-each, kind="stable")[: max(20, m // 8)].tolist():
                config = _filled(length, last, capacity - int(length[i]), i)
                if config @ worth > 1 + 1e-6:
                    keep(config)
            if n > before:
                break
        if n == before:
            break
    if known <= np.ceil(bound - 1e-6):
        return [(a, float(t)) for a, t in first], bound
    afresh()
    uses = [(basis[:, j].astype(np.int64), float(x[j])) for j in range(m) if cost[j] and x[j] > 1e-9]
    return sorted(uses, key=lambda k: -(k[1] % 1)), bound


def _whole(length: np.ndarray, count: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], float]:
    """``_generated`` in whole uses, and its lower bound: rounded down, then what is left is solved again, and the uses with the largest rests are rounded up.

    Whatever is left at some step may also be packed by best fit or by the weights of ``_rounded``; the plan with the fewest sequences counts.
    """
    left, out, bound, best = count.copy(), [], 0.0, None
    while True:
        on = np.flatnonzero(left)
        if not len(on):
            return min([p for p in (best, out) if p is not None], key=_bins), bound
        rest = _best_fit(length[on], left[on], capacity)
        uses, low = _generated(length[on], left[on], capacity, rest, 10 * GAP if bound else GAP / 4)
        bound = bound or low
        ends = [rest]
        if out and _bins(rest) > np.ceil(low - 1e-6):
            ends += [_rounded(length[on], left[on], capacity, *guess) for guess in GUESSES[:1]]
        end = min(ends, key=_bins)
        made = out + [(_spread(c, on, len(length)), t) for c, t in end]
        best = made if best is None or _bins(made) < _bins(best) else best
        if _bins(best) <= np.ceil(bound - 1e-6) or _bins(end) <= np.ceil(low - 1e-6):
            return best, bound
        before, rests = int(left.sum()), 0
        for down in (True, False):
            for config, use in uses:
                whole = int(use + 1e-6) if down else int(use % 1 > 0.5 or rests == 0)
                used = config > 0
                whole = min(whole, int((left[on][used] // config[used]).min()))
                rests += whole if not down else 0
                if whole:
                    full = _spread(config, on, len(length))
                    left -= full * whole
                    out.append((full, whole))
        if int(left.sum()) == before:
            return best, bound


def _spread(config: np.ndarray, on: np.ndarray, n: int) -> np.ndarray:
    """A configuration of some classes as one of all."""
    full = np.zeros(n, np.int64)
    full[on] = config
    return full


def _bins(made: list[tuple[np.ndarray, int]]) -> int:
    return sum(t for _, t in made)


def _fractional(length: np.ndarray, count: np.ndarray, capacity: int, bent: float, sharp: float) -> list[tuple[np.ndarray, float]]:
    """Fractional uses of configurations that together cover every class.

    Each round prices the classes, finds the configuration of the largest price and uses it until one of its classes is served by
    a further ``step`` of its count, or one piece, which bounds the width; the price of a class falls by the exponential of the share
    of it that is served. It ends when every class is covered.
    """
    step = min(0.25, max(0.02, len(length) / 2000))
    left, share, uses, chunk = count.astype(float), (length / capacity) ** bent, {}, np.maximum(1.0, step * count)
    while True:
        open_ = np.flatnonzero(left)
        if not len(open_):
            break
        weight = share * np.exp(-sharp * (1 - left / count))
        most = np.minimum(np.maximum(left[open_], 1).astype(np.int64), capacity // length[open_])
        own = _price(length[open_], weight[open_], most, capacity)
        on, n = open_[own > 0], own[own > 0]
        times = float((np.minimum(left[on], chunk[on]) / n).min())
        left[on] -= n * times
        left[left < 1e-9 * count] = 0
        key = (on.tobytes(), n.tobytes())
        uses[key] = uses.get(key, 0.0) + times
    out = []
    for (on, n), times in sorted(uses.items(), key=lambda x: -x[1]):
        config = np.zeros(len(length), np.int64)
        config[np.frombuffer(on, np.int64)] = np.frombuffer(n, np.int64)
        out.append((config, times))
    return out


def _rounded(length: np.ndarray, count: np.ndarray, capacity: int, bent: float, sharp: float) -> list[tuple[np.ndarray, int]]:
    """A fractional solution rounded down, then one of what that leaves, rounded along its running sum; best fit takes the rest."""
    left, out = count.copy(), []
    for down in (True, False):
        on, run = np.flatnonzero(left), 0.0
        for config, uses in _fractional(length[on], left[on], capacity, bent, sharp):
            whole = int(uses + 1e-9) if down else int(run + uses + 0.5) - int(run + 0.5)
            run += uses
            used = config > 0
            whole = min(whole, int((left[on][used] // config[used]).min()))
            if whole:
                full = np.zeros(len(length), np.int64)
                full[on] = config
                left -= full * whole
                out.append((full, whole))
    return out + _best_fit(length, left, capacity)


# -- places -------------------------------------------------------------------


def pack(df: DataFrame, capacity: int = CAPACITY, length: str = "length", order: list[str] | None = None) -> DataFrame:
    """Give every row its sequence_id and offset, with ``length`` ids of at most ``capacity``.

    Rows are ranked within their length in two levels (hash bucket, then row), so no length, however
    common, meets in one task. The plan is a table of at most one row for each used length and
    configuration. ``order`` names columns that tell rows apart; by default all.
    """
    spark, order = df.sparkSession, order or [c for c in df.columns if c != length]
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(_buckets(df))))
    counts = rows.groupBy(length, "_b").agg(F.count("*").alias("_n"))
    counts = stored(counts)
    hist = counts.groupBy(length).agg(F.sum("_n").alias("n")).where(f"`{length}` is not null").toArrow().sort_by(length)
    sizes, n = hist[length].to_numpy(), hist["n"].to_numpy()
    if len(sizes) and (sizes[0] < 1 or sizes[-1] > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    slots = _slot_table(sizes, plan(sizes, n, capacity))
    base = F.sum("_n").over(Window.partitionBy(length).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(length, "_b", F.coalesce(base, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(length, "_b").orderBy(*[F.col(f"`{c}`") for c in order])) - 1
    ranked = rows.withColumn("_r", rank).join(before, [length, "_b"]).withColumn("_r", F.col("_r") + F.col("_before"))
    shared = spark.sparkContext.broadcast(slots)
    place = df.columns.index(length)
    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = ranked.select(*[F.col(f"`{c}`") for c in df.columns], "_r")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first, per, bin0, at0 = shared.value
        for b in batches:
            size = b.column(place).to_numpy(zero_copy_only=False)
            r = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            j = np.searchsorted(head, _slot_key(size, r), "right") - 1
            within = r - first[j]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bin0[j] + within // per[j]), pa.array(at0[j] + within % per[j] * size)], [f.name for f in schema])

    return out.mapInArrow(deal, schema)


def _buckets(df: DataFrame) -> int:
    return max(256, 4 * df.rdd.getNumPartitions())


def _slot_key(size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (np.asarray(size, np.int64) << 48) + np.asarray(rank, np.int64)


def _slot_table(sizes: np.ndarray, configs: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
    """Where the ranks of each length start in each configuration: sorted key, rank, copies, first bin, offset."""
    given = np.zeros(len(sizes), np.int64)
    key, first, per, bin0, at0, bins = [], [], [], [], [], 0
    for config, times in configs:
        at = 0
        for i in np.flatnonzero(config):
            key.append((int(sizes[i]) << 48) + int(given[i]))
            first.append(int(given[i]))
            per.append(int(config[i]))
            bin0.append(bins)
            at0.append(at)
            at += int(config[i] * sizes[i])
            given[i] += config[i] * times
        bins += times
    table = [np.array(x, np.int64) for x in (key, first, per, bin0, at0)]
    by = np.argsort(table[0])
    return tuple(x[by] for x in table)
