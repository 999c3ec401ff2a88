"""Writing values, operations and whole files."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from .content import Operation
from .document import PdfFile
from .filters import flate_encode
from .values import Name, Ref, Stream

_DELIMITED = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")
_BINARY_COMMENT = b"%\xe2\xe3\xcf\xd3\n"
_REBUILT = {"Prev", "XRefStm", "Type", "W", "Index", "Length", "Filter", "DecodeParms", "Size"}


def format_number(value: float) -> str:
    """At most six decimals, no exponent, no minus zero; what isn't finite is 0."""
    if isinstance(value, int):
        return str(int(value))
    if value != value or value in (float("inf"), float("-inf")):
        return "0"
    if value == int(value):
        return str(int(value))
    out = f"{value:.6f}".rstrip("0").rstrip(".")
    return "0" if out == "-0" else out


def format_name(value: str) -> bytes:
    return b"/" + _DELIMITED.sub(lambda m: b"#%02X" % m[0][0], value.encode("latin-1", "replace"))


def format_string(value: bytes) -> bytes:
    """A literal string; bytes that don't print are octal."""
    def escaped(m: re.Match) -> bytes:
        c = m[0]
        return b"\\" + c if c in b"()\\" else {b"\n": b"\\n", b"\r": b"\\r", b"\t": b"\\t"}.get(c) or b"\\%03o" % c[0]

    return b"(" + re.sub(rb"[()\\]|[^ -~]", escaped, value) + b")"


def format_hex(value: bytes) -> bytes:
    return b"<" + value.hex().upper().encode() + b">"


def format_value(value: Any, compress: bool = False) -> bytes:
    if value is None:
        return b"null"
    if value is True or value is False:
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, (int, float)):
        return format_number(value).encode()
    if isinstance(value, Name):
        return format_name(value)
    if isinstance(value, (bytes, bytearray)):
        return format_string(bytes(value))
    if isinstance(value, (list, tuple)):
        return b"[" + b" ".join(format_value(v) for v in value) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join(b" " + format_name(k) + b" " + format_value(v) for k, v in value.items()) + b" >>"
    if isinstance(value, Stream):
        d, raw = dict(value.dict), value.raw
        if compress and d.get("Filter") is None and len(packed := flate_encode(raw)) < len(raw):
            raw, d["Filter"] = packed, Name("FlateDecode")
            d.pop("DecodeParms", None)
        d["Length"] = len(raw)
        return format_value(d) + b"\nstream\n" + raw + b"\nendstream"
    raise TypeError(f"no PDF value: {type(value).__name__}")


def format_object(num: int, gen: int, value: Any, compress: bool = False) -> bytes:
    return b"%d %d obj\n" % (num, gen) + format_value(value, compress) + b"\nendobj\n"


def format_operations(ops: Iterable[Operation]) -> bytes:
    lines = []
    for op, operands, image in ops:
        lines.append(image if image is not None else b" ".join([*(format_value(v) for v in operands), op.encode("latin-1")]))
    return b"\n".join(lines) + b"\n"


def subsections(numbers: Iterable[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, count)."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and n == sum(out[-1]):
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((n, 1))
    return out


class Writer:
    """Changed objects over a source file, or a new file without one."""

    def __init__(self, source: PdfFile | None = None):
        self.source = source
        self.changed: dict[int, tuple[int, Any]] = {}
        self.overrides: dict[str, Any] = {}
        self._next = source.size if source else 1

    def alloc(self) -> Ref:
        self._next += 1
        return Ref(self._next - 1, 0)

    def set(self, ref: Ref, value: Any) -> Ref:
        self.changed[ref.num] = (ref.gen, value)
        return ref

    def add(self, value: Any) -> Ref:
        return self.set(self.alloc(), value)

    def owns(self, num: int) -> bool:
        return num in self.changed

    def get(self, num: int) -> Any:
        if num in self.changed:
            return self.changed[num][1]
        return self.source.get(num) if self.source else None

    def resolve(self, value: Any) -> Any:
        for _ in range(64):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def save(self, incremental: bool | None = None, compress: bool = False) -> bytes:
        """The whole file, or the source with what changed appended."""
        incremental = self.source is not None if incremental is None else incremental
        if incremental and self.source is None:
            raise ValueError("an appended save needs a source")
        out = bytearray()
        objects = {n: v for n, v in self.changed.items()}
        if incremental:
            out += self.source.data
            if objects and not out.endswith((b"\n", b"\r")):
                out += b"\n"
            if not objects and not self.overrides:
                return bytes(out)
        else:
            version = self.source.version if self.source and self.source.version != "unknown" else "1.7"
            out += f"%PDF-{version}\n".encode() + _BINARY_COMMENT
            for n in self.source.numbers() if self.source else ():
                if n not in objects and not self._structural(value := self.source.get(n)):
                    objects[n] = (self.source.entries[n].gen, value)
        if not objects:
            raise ValueError("nothing to write")
        offsets = {}
        for n in sorted(objects):
            gen, value = objects[n]
            offsets[n] = (len(out), gen)
            out += format_object(n, gen, value, compress)
        start = len(out)
        out += b"xref\n"
        lines = {n: b"%010d %05d n\r\n" % place for n, place in offsets.items()}
        if not incremental:
            lines[0] = b"0000000000 65535 f\r\n"
        for first, count in subsections(lines):
            out += b"%d %d\n" % (first, count) + b"".join(lines[n] for n in range(first, first + count))
        trailer = {k: v for k, v in (self.source.trailer if self.source else {}).items() if k not in _REBUILT} | self.overrides
        trailer["Size"] = max([max(objects) + 1, self.source.size if self.source else 0])
        if incremental and self.source.startxref > 0 and not self.source._rebuilt:
            trailer["Prev"] = self.source.startxref
        elif incremental:
            # without a sound index behind it, the new one lists everything
            return Writer._rewrite(self, compress)
        out += b"trailer\n" + format_value(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start
        return bytes(out)

    def _rewrite(self, compress: bool) -> bytes:
        return self.save(incremental=False, compress=compress)

    @staticmethod
    def _structural(value: Any) -> bool:
        """Containers of objects and indexes: their contents are written by themselves."""
        return isinstance(value, Stream) and value.dict.get("Type") in ("ObjStm", "XRef")
