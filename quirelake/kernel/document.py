"""One PDF file: its index of objects, and lookups through it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

from . import filters
from .scan import Scanner
from .values import Keyword, Name, PdfError, Ref, Shared, Stream, name, number, text

FREE, OFFSET, PACKED = 0, 1, 2
MAX_DEPTH = 64
_HEADER = re.compile(rb"%PDF-(\d+\.\d+)")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![A-Za-z0-9])")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+([nf])")
_STREAM = re.compile(rb"stream(\r\n|\n|\r)?")
_STREAM_END = re.compile(rb"[\x00\t\n\x0c\r ]*endstream")
#: Dictionaries of these sizes in bytes are kept, up to this number, for files that have the same.
_KEEP_FROM, _KEEP_TO, _KEPT = 256, 16_384, 512
_kept: dict[Any, Shared] = {}
_INDEX_KEYS = {"Prev", "XRefStm", "W", "Index", "Length", "Filter", "DecodeParms", "Type"}


class Entry(NamedTuple):
    """Where an object is: an offset, or a container stream and place in it. section: 0 for the newest index."""

    type: int
    offset: int = 0
    gen: int = 0
    container: int = 0
    index: int = 0
    section: int = 0


class Page(NamedTuple):
    num: int
    order: tuple[int, ...]
    dict: dict[str, Any]
    inherited: dict[str, Any]


class PdfFile:
    """Index, trailer and repairs are read at once; objects when they are asked for."""

    def __init__(self, data: bytes):
        self.data = bytes(data)
        self.entries: dict[int, Entry] = {}
        self.trailer: dict[str, Any] = {}
        self.sections: list[int] = []
        self.repairs: list[tuple[str, str]] = []
        self._objects: dict[int, Any] = {}
        self._packed: dict[int, dict[int, Any]] = {}
        self._busy: set[int] = set()
        self._rebuilt = False
        m = _HEADER.search(self.data[:1024])
        self.version = m[1].decode() if m else "unknown"
        self.startxref = self._last_startxref()
        if self.startxref >= 0:
            self._chain()
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            self._rebuild("no catalog")
        self.size = max([int(number(self.trailer.get("Size"), 0)), *(n + 1 for n in self.entries)])
        self.encrypted = self.trailer.get("Encrypt") is not None
        crypt = self.resolve(self.trailer.get("Encrypt"))
        self.encryption_filter = name(crypt.get("Filter")) if isinstance(crypt, dict) else None

    # -- the index ----------------------------------------------------------

    def _last_startxref(self) -> int:
        found = re.findall(rb"startxref[\x00\t\n\x0c\r ]*(\d+)", self.data[-2048:])
        return int(found[-1]) if found else -1

    def _chain(self) -> None:
        at: float | None = self.startxref
        while at is not None and int(at) not in self.sections:
            seq = len(self.sections)
            self.sections.append(int(at))
            try:
                found, trailer = self._section(int(at), seq)
            except (PdfError, ValueError, IndexError) as e:
                self.repairs.append(("bad-section", f"{int(at)}: {e}"))
                break
            for num, entry in found.items():
                self.entries.setdefault(num, entry)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            at = number(trailer.get("Prev"))

    def _section(self, at: int, seq: int) -> tuple[dict[int, Entry], dict[str, Any]]:
        s = Scanner(self.data, at)
        s.gap()
        if self.data[s.at : s.at + 4] != b"xref":
            return self._stream_section(at, seq)
        s.at += 4
        found: dict[int, Entry] = {}
        while True:
            start = s.token()
            if start == b"trailer":
                break
            count = s.token()
            if not isinstance(start, int) or not isinstance(count, int) or isinstance(start, Keyword):
                raise PdfError("index without trailer")
            for num in range(start, start + count):
                m = _ENTRY.match(self.data, s.at)
                if not m:
                    break
                s.at = m.end()
                used = m[3] == b"n"
                found.setdefault(num, Entry(OFFSET if used else FREE, int(m[1]) if used else 0, int(m[2]), section=seq))
        trailer = s.value()
        if not isinstance(trailer, dict):
            raise PdfError("trailer is no dictionary")
        hybrid = number(trailer.get("XRefStm"))
        if hybrid is not None:
            try:
                extra, _ = self._stream_section(int(hybrid), seq)
            except (PdfError, ValueError, IndexError) as e:
                self.repairs.append(("bad-section", f"{int(hybrid)}: {e}"))
                extra = {}
            for num, entry in extra.items():
                if num not in found or found[num].type == FREE:
                    found[num] = entry
        return found, trailer

    def _stream_section(self, at: int, seq: int) -> tuple[dict[int, Entry], dict[str, Any]]:
        _, value = self._indirect(at, None)
        if not isinstance(value, Stream):
            raise PdfError("no index there")
        d = value.dict
        widths = [int(w) for w in d.get("W") or []]
        if len(widths) < 3 or min(widths) < 0:
            raise PdfError("index stream without widths")
        data, _, problem = self.decode(value)
        if problem:
            raise PdfError(problem)
        size = int(number(d.get("Size"), 0))
        ranges = d.get("Index") or [0, size]
        found, at, step = {}, 0, sum(widths)
        for start, count in zip(ranges[::2], ranges[1::2]):
            for num in range(int(start), int(start) + int(count)):
                if at + step > len(data):
                    break
                fields = []
                for w in widths[:3]:
                    fields.append(int.from_bytes(data[at : at + w], "big"))
                    at += w
                at += sum(widths[3:])
                kind = fields[0] if widths[0] else OFFSET
                if kind == OFFSET:
                    found.setdefault(num, Entry(OFFSET, fields[1], fields[2], section=seq))
                elif kind == PACKED:
                    found.setdefault(num, Entry(PACKED, container=fields[1], index=fields[2], section=seq))
                elif kind == FREE:
                    found.setdefault(num, Entry(FREE, gen=fields[2], section=seq))
        return found, d

    def _rebuild(self, why: str) -> None:
        """Index by looking for ``N G obj`` everywhere; the last of a number counts."""
        if self._rebuilt:
            return
        self._rebuilt = True
        self.repairs.append(("rebuilt-xref", why))
        self._objects.clear()
        self._packed.clear()
        found = {int(m[1]): Entry(OFFSET, m.start(), int(m[2])) for m in _OBJECT.finditer(self.data)}
        self.entries = found
        containers = []
        trailer: dict[str, Any] = {}
        catalog = None
        for num in sorted(found, key=lambda n: found[n].offset):
            value = self.get(num)
            d = value.dict if isinstance(value, Stream) else value
            kind = name(d.get("Type")) if isinstance(d, dict) else None
            if kind == "ObjStm":
                containers.append(num)
            elif kind == "XRef":
                trailer |= {k: v for k, v in d.items() if k not in _INDEX_KEYS}
            elif kind == "Catalog":
                catalog = num
        for num in containers:
            for i, inner in enumerate(self._unpack(num)):
                if inner not in found:
                    self.entries[inner] = Entry(PACKED, container=num, index=i)
                    value = self.get(inner)
                    if isinstance(value, dict) and name(value.get("Type")) == "Catalog":
                        catalog = inner
        for m in re.finditer(rb"trailer", self.data):
            value = Scanner(self.data, m.end()).value()
            if isinstance(value, dict):
                trailer |= {k: v for k, v in value.items() if k not in _INDEX_KEYS}
        self.trailer = {**self.trailer, **trailer}
        if not isinstance(self.resolve(self.trailer.get("Root")), dict) and catalog is not None:
            self.trailer["Root"] = Ref(catalog, self.entries[catalog].gen)

    # -- objects --------------------------------------------------------------

    def get(self, num: int) -> Any:
        """The object of a number; null where it's free or missing."""
        if num in self._objects:
            return self._objects[num]
        entry = self.entries.get(num)
        if entry is None or entry.type == FREE or num in self._busy:
            return None
        self._busy.add(num)
        try:
            value = self._fetch(num, entry)
        except (PdfError, ValueError, IndexError):
            if self._rebuilt:
                value = None
            else:
                self._rebuild(f"object {num} isn't where the index says")
                self._busy.discard(num)
                return self.get(num)
        finally:
            self._busy.discard(num)
        self._objects[num] = value
        return value

    def _fetch(self, num: int, entry: Entry) -> Any:
        if entry.type == PACKED:
            inner = self._unpack(entry.container)
            if num not in inner:
                raise PdfError(f"{num} isn't in {entry.container}")
            return inner[num]
        return self._indirect(entry.offset, num)[1]

    def _indirect(self, at: int, num: int | None) -> tuple[int, Any]:
        s = Scanner(self.data, at)
        m = _OBJECT.match(self.data, s.gap())
        if not m or num is not None and int(m[1]) != num:
            raise PdfError(f"no object {num} at {at}")
        s.at = m.end()
        stop = self.data.find(b"endobj", s.at, s.at + _KEEP_TO)
        body = self.data[s.at : stop + 7] if stop - s.at >= _KEEP_FROM else None
        if body is not None and (kept := _kept.get(body)) is not None:
            return int(m[1]), kept
        value = s.value()
        if isinstance(value, Keyword):
            return int(m[1]), None
        if isinstance(value, dict):
            after = _STREAM.match(self.data, s.gap())
            if after:
                return int(m[1]), Stream(value, self._body(int(m[1]), value, after.end()))
            if s.at == stop and body is not None:
                value = _keep(body, value)
        return int(m[1]), value

    def _body(self, num: int, d: dict[str, Any], at: int) -> bytes:
        """Raw bytes: the stated length if ``endstream`` follows it, otherwise up to ``endstream``."""
        length = number(self.resolve(d.get("Length")))
        if length is not None and 0 <= length and at + length <= len(self.data):
            end = at + int(length)
            if _STREAM_END.match(self.data, end):
                return self.data[at:end]
        end = self.data.find(b"endstream", at)
        if end < 0:
            end = self.data.find(b"endobj", at)
            end = len(self.data) if end < 0 else end
        stop = end
        if self.data[stop - 1 : stop] == b"\n" and stop > at:
            stop -= 1
        if self.data[stop - 1 : stop] == b"\r" and stop > at:
            stop -= 1
        self.repairs.append(("stream-length", f"object {num}: {stop - at} bytes"))
        return self.data[at:stop]

    def _unpack(self, num: int) -> dict[int, Any]:
        """Objects of an object stream by number, in order."""
        if num not in self._packed:
            stream = self.get(num)
            inner: dict[int, Any] = {}
            if isinstance(stream, Stream):
                data, _, _ = self.decode(stream)
                s = Scanner(data)
                count, first = int(number(self.resolve(stream.dict.get("N")), 0)), int(number(self.resolve(stream.dict.get("First")), 0))
                heads = []
                for _ in range(count):
                    a, b = s.token(), s.token()
                    if not isinstance(a, int) or not isinstance(b, int):
                        break
                    heads.append((a, b))
                ends = sorted({b for _, b in heads})
                after = dict(zip(ends, ends[1:]))
                for a, b in heads:
                    last = b not in after
                    body = data[first + b : len(data) if last else first + after[b]]
                    key = (body, last) if _KEEP_FROM <= len(body) <= _KEEP_TO else None
                    if key is not None and (kept := _kept.get(key)) is not None:
                        inner[a] = kept
                        continue
                    s = Scanner(data, first + b)
                    value = s.value()
                    if key is not None and isinstance(value, dict) and s.at <= first + b + len(body):
                        value = _keep(key, value)
                    inner[a] = None if isinstance(value, Keyword) else value
            self._packed[num] = inner
        return self._packed[num]

    def resolve(self, value: Any) -> Any:
        """What a reference, or a chain of up to 64, stands for."""
        for _ in range(MAX_DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def dict(self, value: Any) -> dict[str, Any]:
        value = self.resolve(value)
        return value if isinstance(value, dict) else {}

    def filters_of(self, stream: Stream) -> list[str]:
        raw = self.resolve(stream.dict.get("Filter"))
        return [name(self.resolve(f)) or "unknown" for f in (raw if isinstance(raw, list) else [] if raw is None else [raw])]

    def decode(self, stream: Stream) -> tuple[bytes, str | None, str | None]:
        """Decoded bytes, the image codec that is left, and what went wrong."""
        raw = self.resolve(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        parms = [{k: self.resolve(v) for k, v in self.dict(p).items()} for p in (raw if isinstance(raw, list) else [raw])]
        return filters.decode(stream.raw, self.filters_of(stream), parms)

    def stream_data(self, num: int, stream: Stream) -> tuple[bytes, str | None]:
        data, codec, problem = self.decode(stream)
        if problem and ("filter", f"object {num}: {problem}") not in self.repairs:
            self.repairs.append(("filter", f"object {num}: {problem}"))
        return data, codec

    # -- documents ------------------------------------------------------------

    @property
    def catalog(self) -> dict[str, Any]:
        return self.dict(self.trailer.get("Root"))

    @property
    def info(self) -> dict[str, Any]:
        return self.dict(self.trailer.get("Info"))

    def pages(self) -> list[Page]:
        """Pages in reading order, each with the attributes that it has or inherits."""
        out: list[Page] = []
        seen: set[int] = set()

        def walk(ref: Any, order: tuple[int, ...], above: dict[str, Any]) -> None:
            if isinstance(ref, Ref):
                if ref.num in seen:
                    return
                seen.add(ref.num)
            node = self.resolve(ref)
            if not isinstance(node, dict) or len(order) > MAX_DEPTH:
                return
            here = dict(above)
            for key in ("Resources", "MediaBox", "CropBox", "Rotate"):
                value = self.resolve(node.get(key))
                if value is not None:
                    here[key] = [self.resolve(v) for v in value] if isinstance(value, list) else value
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list):
                for i, kid in enumerate(kids):
                    walk(kid, (*order, i), here)
            elif order or name(node.get("Type")) == "Page":
                out.append(Page(ref.num if isinstance(ref, Ref) else 0, order, node, here))

        walk(self.catalog.get("Pages"), (), {})
        return out

    def contents(self, page: Page) -> bytes:
        """Decoded content streams of a page; parts of an array are kept apart by a line feed."""
        value = page.dict.get("Contents")
        num = value.num if isinstance(value, Ref) else 0
        value = self.resolve(value)
        if isinstance(value, Stream):
            return self.stream_data(num, value)[0]
        parts = []
        for item in value if isinstance(value, list) else []:
            stream = self.resolve(item)
            if isinstance(stream, Stream):
                parts.append(self.stream_data(item.num if isinstance(item, Ref) else 0, stream)[0] + b"\n")
        return b"".join(parts)

    def outline(self, pages: list[Page]) -> Iterator[tuple[tuple[int, ...], str, int | None]]:
        """Bookmarks depth first: path of places, title, page index."""
        index = {p.num: i for i, p in reversed(list(enumerate(pages))) if p.num}

        def target(item: dict[str, Any]) -> int | None:
            dest = item.get("Dest")
            if dest is None:
                dest = self.dict(item.get("A")).get("D")
            dest = self.resolve(dest)
            if isinstance(dest, dict):
                if isinstance(dest.get("D"), Ref) and dest["D"].num in index:
                    return index[dest["D"].num]
                dest = self.resolve(dest.get("D"))
            first = dest[0] if isinstance(dest, list) and dest else None
            return index.get(first.num) if isinstance(first, Ref) else None

        seen: set[int] = set()

        def walk(ref: Any, path: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], str, int | None]]:
            place = 0
            while len(path) <= 32:
                if isinstance(ref, Ref):
                    if ref.num in seen:
                        return
                    seen.add(ref.num)
                item = self.resolve(ref)
                if not isinstance(item, dict):
                    return
                title = self.resolve(item.get("Title"))
                yield (*path, place), text(title) if isinstance(title, bytes) else "", target(item)
                yield from walk(item.get("First"), (*path, place))
                ref, place = item.get("Next"), place + 1

        return walk(self.dict(self.catalog.get("Outlines")).get("First"), ())

    def page_labels(self) -> list[tuple[int, str | None, str | None, int]]:
        """Rules (from index, style, prefix, start) by index."""
        out: list[tuple[int, str | None, str | None, int]] = []
        seen: set[int] = set()

        def walk(ref: Any, depth: int) -> None:
            if depth > 32 or isinstance(ref, Ref) and ref.num in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref.num)
            node = self.dict(ref)
            nums = self.resolve(node.get("Nums"))
            for a, b in zip(nums[::2], nums[1::2]) if isinstance(nums, list) else ():
                first, rule = number(self.resolve(a)), self.resolve(b)
                if first is not None and isinstance(rule, dict):
                    prefix = self.resolve(rule.get("P"))
                    out.append((int(first), name(rule.get("S")), text(prefix) if isinstance(prefix, bytes) else None, int(number(self.resolve(rule.get("St")), 1))))
            for kid in self.resolve(node.get("Kids")) or []:
                walk(kid, depth + 1)

        walk(self.catalog.get("PageLabels"), 0)
        return sorted(out, key=lambda r: r[0])

    def numbers(self) -> list[int]:
        """Numbers of objects that are in use."""
        return sorted(n for n, e in self.entries.items() if n and e.type != FREE)


def _refers(value: Any) -> bool:
    if isinstance(value, dict):
        value = list(value.values())
    return isinstance(value, Ref) or isinstance(value, list) and any(map(_refers, value))


def _keep(key: Any, value: dict[str, Any]) -> dict[str, Any]:
    """The dictionary, kept for other files unless it refers to something in its own."""
    if _refers(value):
        return value
    if len(_kept) >= _KEPT:
        _kept.pop(next(iter(_kept)))
    _kept[key] = out = Shared(value)
    return out


def box(value: Any) -> tuple[float, float, float, float] | None:
    """A rectangle with its corners in order; what isn't a number counts as 0."""
    if not isinstance(value, list) or len(value) < 4:
        return None
    x0, y0, x1, y1 = (float(number(v, 0)) for v in value[:4])
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


def quarter_turn(value: Any) -> int:
    """The nearest quarter turn, halves upwards, from 0 to 270."""
    return int((float(number(value, 0)) / 90 + 0.5) // 1 * 90) % 360


def kind_of(value: Any) -> tuple[str, str | None]:
    """dict, stream, array, null or scalar, and the Type of the first two."""
    if isinstance(value, Stream):
        return "stream", name(value.dict.get("Type"))
    if isinstance(value, dict):
        return "dict", name(value.get("Type"))
    return ("array" if isinstance(value, list) else "null" if value is None else "scalar"), None


__all__ = ["Entry", "FREE", "Name", "OFFSET", "PACKED", "Page", "PdfFile", "box", "kind_of", "quarter_turn"]
