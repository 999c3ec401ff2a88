"""Searching the bytes of large files in ranges, all at once, for what lies outside of strings and comments.

Whether a byte is inside a string depends on everything before it, so every range is scanned for all states that it may begin in: outside, in a
comment, and in a string of each depth, with or without an escape pending. What a range does to the state is small: a string of depth d ends
where the parentheses first fall d below their start, deeper ones go on with a changed depth. These summaries, one row a range, are put
together in order for each file; then every range knows the state that it begins in and is scanned for matches alone. Two shuffles of ranges, and no task has more of a file than a range.

Cases: null and empty contents have no matches; a string or comment that doesn't end runs to the file's end; a closing parenthesis outside of a string is
nothing; other columns are not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes in a range.
SPLIT = 4 << 20
#: Bytes before a match that say which object it begins.
_BEHIND = 64
#: Matches that leave as one Arrow batch.
_MATCHES = 8192
_SPECIAL, _IN_STRING, _LINE_END = re.compile(rb"[(%]"), re.compile(rb"[\\()]"), re.compile(rb"[\r\n]")
#: A state is twice (0 in a comment, 1 outside, 1 + d in a string of depth d), and one more where the next byte is escaped.
_COMMENT, _OUTSIDE = 0, 2


class _Range:
    """The bytes of a range, and what scans of it from several states have in common."""

    def __init__(self, data: bytes, end: int):
        self.data, self.end = data, end
        self.after: dict[int, int] = {}

    def string(self, at: int, depth: int) -> tuple[int, int]:
        """From inside a string: where it ends and 0, or the end and the state there."""
        while (m := _IN_STRING.search(self.data, at, self.end)) is not None:
            c, at = m[0], m.end()
            if c == b"\\":
                at += 1
                if at > self.end:
                    return self.end, 2 * (depth + 1) + 1
            elif c == b"(":
                depth += 1
            else:
                depth -= 1
                if not depth:
                    return at, 0
        return self.end, 2 * (depth + 1)

    def outside(self, at: int, found: list[tuple[int, int]] | None = None) -> int:
        """The state at the end from outside at ``at``; ``found`` is given the stretches outside. Ways that meet are gone once."""
        way = []
        while True:
            m = _SPECIAL.search(self.data, at, self.end)
            stop = m.start() if m else self.end
            if found is not None:
                found.append((at, stop))
            elif stop in self.after:
                out = self.after[stop]
                break
            way.append(stop)
            if m is None:
                out = _OUTSIDE
                break
            if m[0] == b"%":
                line = _LINE_END.search(self.data, stop, self.end)
                if line is None:
                    out = _COMMENT
                    break
                at = line.start()
            else:
                at, state = self.string(stop + 1, 1)
                if state:
                    out = state
                    break
        self.after.update((x, out) for x in way)
        return out

    def closes(self, skip: int) -> tuple[list[int], int, int]:
        """For strings of depth 1, 2, ..: the state at the end where they end; the change of depth of deeper ones, and whether an escape is pending for them."""
        at, low, depth, out = skip, 0, 0, []
        while (m := _IN_STRING.search(self.data, at, self.end)) is not None:
            at = m.end()
            if m[0] == b"\\":
                at += 1
                if at > self.end:
                    return out, depth, 1
            else:
                depth += 1 if m[0] == b"(" else -1
                if depth < low:
                    low = depth
                    out.append(self.outside(at))
        return out, depth, 0

    def stretches(self, state: int) -> list[tuple[int, int]]:
        """What is outside, from this state on."""
        found: list[tuple[int, int]] = []
        at = state & 1
        if state >> 1 == 0:
            line = _LINE_END.search(self.data, 0, self.end)
            if line is not None:
                self.outside(line.start(), found)
        elif state >> 1 == 1:
            self.outside(0, found)
        else:
            stop, rest = self.string(at, (state >> 1) - 1)
            if not rest:
                self.outside(stop, found)
        return found


def _summary(data: bytes) -> tuple:
    r = _Range(data, len(data))
    line = _LINE_END.search(data)
    return (r.outside(0), r.outside(line.start()) if line else _COMMENT, *r.closes(0), *r.closes(1))


def ranges(contents: DataFrame, split: int = SPLIT, behind: int = 0, ahead: int = 0) -> DataFrame:
    """file_id, k, start, lead, data: bytes of range k with up to ``behind`` and ``ahead`` more; ``lead`` is how many come before ``start``."""
    size = F.octet_length("content")
    cut = contents.where(size > 0).select("file_id", "content", F.posexplode(F.sequence(F.lit(0), size - 1, F.lit(split))).alias("k", "start"))
    lead = F.least(F.lit(behind), F.col("start"))
    out = cut.select("file_id", "k", "start", lead.alias("lead"), F.substring("content", F.col("start") - lead + 1, lead + split + ahead).alias("data"))
    return out.repartition("file_id", "k")


def entry_states(contents: DataFrame, split: int = SPLIT) -> DataFrame:
    """The state that each range begins in: file_id, k, state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 512) for at in range(0, b.num_rows, 512)):
                rows = [_summary(x.as_py()) for x in part.column("data")]
                yield pa.RecordBatch.from_arrays([part.column("file_id"), part.column("k"), *[pa.array(v, t) for v, t in zip(zip(*rows), _TYPES)]], ["file_id", "k", *_NAMES])

    told = ranges(contents, split).select("file_id", "k", "data").mapInArrow(run, "file_id string, k int, " + ", ".join(f"{n} {t}" for n, t in zip(_NAMES, _DDL)))
    listed = told.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("k", *_NAMES)), lambda x, y: x["k"] - y["k"]).alias("parts"))

    def step(acc: Column, p: Column) -> Column:
        s, depth = acc["state"], F.shiftright(acc["state"], 1) - 1
        skip = s.bitwiseAND(1)
        closes = F.when(skip == 1, p["closes_e"]).otherwise(p["closes"])
        on = 2 * (depth + 1 + F.when(skip == 1, p["net_e"]).otherwise(p["net"])) + F.when(skip == 1, p["skip_e"]).otherwise(p["skip"])
        after = F.when(depth == 0, p["outside"]).when(depth < 0, p["comment"]).when(depth <= F.size(closes), F.try_element_at(closes, depth)).otherwise(on)
        return F.struct(after.cast("int").alias("state"), F.array_append(acc["out"], s).alias("out"))

    begin = F.struct(F.lit(_OUTSIDE).alias("state"), F.array().cast("array<int>").alias("out"))
    return listed.select("file_id", F.posexplode(F.aggregate("parts", begin, step, lambda a: a["out"])).alias("k", "state"))


_NAMES = ["outside", "comment", "closes", "net", "skip", "closes_e", "net_e", "skip_e"]
_DDL = ["int", "int", "array<int>", "int", "int", "array<int>", "int", "int"]
_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32()]


def find_outside(contents: DataFrame, needle: bytes, split: int = SPLIT) -> DataFrame:
    """Where ``needle`` begins outside of strings and comments in each file (file_id, content): file_id, at, and the bytes before it (``before``)."""
    if not needle or re.search(rb"[()%]", needle):
        raise ValueError("a needle has bytes, and none of ( ) %")
    own = ranges(contents, split, _BEHIND, len(needle) - 1).join(entry_states(contents, split), ["file_id", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, behind = [], [], []
        for b in batches:
            for i in range(b.num_rows):
                lead, start, data = b.column("lead")[i].as_py(), b.column("start")[i].as_py(), b.column("data")[i].as_py()
                body = data[lead:]
                places = []
                for a, stop in _Range(body, min(split, len(body))).stretches(b.column("state")[i].as_py()):
                    while (a := body.find(needle, a, min(stop + len(needle) - 1, len(body)))) >= 0:
                        places.append(a)
                        a += 1
                for lo in range(0, len(places), _MATCHES):
                    some = places[lo : lo + _MATCHES]
                    ids += [b.column("file_id")[i].as_py()] * len(some)
                    at += [start + p for p in some]
                    behind += [data[max(0, lead + p - _BEHIND) : lead + p] for p in some]
                    if len(ids) >= _MATCHES:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(behind, pa.binary())], ["file_id", "at", "before"])
                        ids, at, behind = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(behind, pa.binary())], ["file_id", "at", "before"])

    return own.select("file_id", "start", "lead", "data", "state").mapInArrow(run, "file_id string, at long, before binary")


def find_objects(contents: DataFrame, split: int = SPLIT) -> DataFrame:
    """Where objects begin (``N G obj``) outside of strings and comments: file_id, obj_num, gen, offset."""
    head = F.regexp_extract_all(F.decode("before", "ISO-8859-1"), F.lit(r"(?:^|[\x00\t\n\x0c\r ()<>\[\]{}/%])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+$"), F.lit(0))
    text = F.ltrim(F.try_element_at(head, F.lit(1)), F.lit("\0\t\n\f\r ()<>[]{}/%"))
    found = find_outside(contents, b"obj", split).select("file_id", "at", text.alias("h")).where("h is not null")
    part = lambda k: F.regexp_extract("h", r"^(\d+)[\x00\t\n\x0c\r ]+(\d+)", k)
    return found.select("file_id", part(1).try_cast("long").alias("obj_num"), part(2).try_cast("int").alias("gen"), (F.col("at") - F.char_length("h")).alias("offset"))
