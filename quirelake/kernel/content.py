"""Content streams: operations, and the text that they show."""

from __future__ import annotations

import math
import re
from typing import Any, NamedTuple

import numpy as np

from . import matrix as mx
from .document import Page, PdfFile
from .fonts import Font
from .scan import CLOSE_DICT, END, Scanner
from .values import Keyword, Name, Shared, number

MAX_OPERANDS = 64
_IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")


class Operation(NamedTuple):
    op: str
    operands: list[Any]
    inline_image: bytes | None = None


def operations(data: bytes) -> list[Operation]:
    """Operators with the operands before them; the bytes from ``BI`` to ``EI`` are one operation."""
    s, out, held = Scanner(data), [], []
    while True:
        value = s.value()
        if not isinstance(value, Keyword):
            held.append(value)
            if len(held) > MAX_OPERANDS:
                held = []
            continue
        if value == END:
            return out
        if value in (b"]", b"}", b"{", b")", b">") or value == CLOSE_DICT:
            continue
        if value == b"BI":
            m = _IMAGE_END.search(data, s.at)
            stop = m.end() if m else len(data)
            out.append(Operation("BI", [], data[s.at - 2 : stop]))
            s.at = stop
        else:
            out.append(Operation(value.decode("latin-1"), held))
        held = []


class State:
    """What ``q`` saves: the page matrix, font and text settings."""

    __slots__ = ("ctm", "font", "font_name", "size", "char", "word", "scale", "leading", "rise", "mode")

    def __init__(self, ctm: mx.Matrix):
        self.ctm, self.font, self.font_name = ctm, None, None
        self.size, self.char, self.word, self.scale, self.leading, self.rise, self.mode = 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0

    def copy(self) -> State:
        other = State.__new__(State)
        for k in self.__slots__:
            setattr(other, k, getattr(self, k))
        return other


class Run(NamedTuple):
    """Text of one shown string. starts, xs, ys and widths are of its glyphs."""

    text: str
    x: float
    y: float
    width: float
    height: float
    angle: float
    font_name: str
    font_size: float
    ctm: mx.Matrix
    starts: np.ndarray
    xs: np.ndarray
    ys: np.ndarray
    widths: np.ndarray


def _decoded(font: Font, data: bytes) -> tuple[str, list[str] | None]:
    """The text of a string, and the parts that its codes give, where these may not be its characters."""
    if isinstance(font, Font) and (whole := font.by_byte(data)) is not None:
        return whole, None
    parts = [font.text(c) for c in font.codes(data)]
    return "".join(parts), parts


def _advances(font: Font, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a string and their widths."""
    if isinstance(font, Font) and not font.two_byte:
        codes = np.frombuffer(data, np.uint8)
        return codes, font.tables()[1][codes]
    codes = font.codes(data)
    return np.array(codes), np.array([font.width(c) for c in codes])


def runs(ops: list[Operation], fonts: dict[str, Font], base: mx.Matrix = mx.IDENTITY) -> list[Run]:
    """Shown strings in order. Strings without text are not returned, but move the text on."""
    out: list[Run] = []
    state, saved = State(base), []
    line = place = mx.IDENTITY

    def numbers(args: list[Any], n: int) -> list[float] | None:
        found = [number(a) for a in args[:n]]
        return found if len(found) == n and None not in found else None

    def down(x: float, y: float) -> mx.Matrix:
        return mx.concat(mx.translation(x, y), line)

    def show(data: Any) -> None:
        nonlocal place
        font: Font | None = state.font
        if not isinstance(data, bytes) or font is None:
            return
        text, parts = _decoded(font, data)
        codes, step = _advances(font, data)
        step = step * state.size + state.char
        if state.word and not font.two_byte:
            step[codes == 32] += state.word
        at = np.zeros(len(step) + 1)
        np.cumsum(step * state.scale, out=at[1:])
        total = float(at[-1])
        if text:
            m = mx.concat(place, state.ctm)
            xs, ys = m[0] * at + (m[2] * state.rise + m[4]), m[1] * at + (m[3] * state.rise + m[5])
            dx, dy = float(xs[-1] - xs[0]), float(ys[-1] - ys[0])
            height = state.size * state.scale * math.hypot(place[2], place[3]) * mx.scale_factor(state.ctm)
            starts = np.arange(len(text)) if parts is None or len(text) == len(parts) and "" not in parts else np.cumsum([0, *map(len, parts)])[:-1]
            out.append(Run(text, float(xs[0]), float(ys[0]), math.hypot(dx, dy), height, math.atan2(dy, dx) if dx or dy else 0.0, state.font_name or "", state.size, state.ctm, starts, xs[:-1], ys[:-1], np.hypot(np.diff(xs), np.diff(ys))))
        place = mx.concat(mx.translation(total, 0.0), place)

    for op, args, _ in ops:
        if op == "q":
            saved.append(state.copy())
        elif op == "Q":
            if saved:
                state = saved.pop()
        elif op == "cm":
            if (m := numbers(args, 6)) is not None:
                state.ctm = mx.concat(tuple(m), state.ctm)
        elif op == "BT":
            line = place = mx.IDENTITY
        elif op == "Tf":
            if args and isinstance(args[0], Name):
                state.font_name, state.font = str(args[0]), fonts.get(str(args[0]))
                if len(args) > 1 and (size := number(args[1])) is not None:
                    state.size = size
        elif op in ("Tc", "Tw", "TL", "Ts", "Tz", "Tr"):
            if (v := numbers(args, 1)) is not None:
                if op == "Tz":
                    state.scale = v[0] / 100
                elif op == "Tr":
                    state.mode = int(v[0])
                else:
                    setattr(state, {"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise"}[op], v[0])
        elif op == "Tm":
            if (m := numbers(args, 6)) is not None:
                line = place = tuple(m)
        elif op in ("Td", "TD"):
            if (v := numbers(args, 2)) is not None:
                if op == "TD":
                    state.leading = -v[1]
                line = place = down(*v)
        elif op == "T*":
            line = place = down(0.0, -state.leading)
        elif op == "Tj":
            show(args[0] if args else None)
        elif op == "TJ":
            for item in args[0] if args and isinstance(args[0], list) else []:
                if isinstance(item, bytes):
                    show(item)
                elif number(item) is not None:
                    place = mx.concat(mx.translation(-item / 1000 * state.size * state.scale, 0.0), place)
        elif op == "'":
            line = place = down(0.0, -state.leading)
            show(args[0] if args else None)
        elif op == '"':
            if len(args) >= 3 and (v := numbers(args, 2)) is not None:
                state.word, state.char = v
            line = place = down(0.0, -state.leading)
            show(args[2] if len(args) >= 3 else None)
    return out


def shown(ops: list[Operation], fonts: dict[str, Font]) -> list[str]:
    """The texts of ``runs`` alone, without where they are."""
    out: list[str] = []
    font, saved = None, []
    for op, args, _ in ops:
        if op == "q":
            saved.append(font)
        elif op == "Q":
            font = saved.pop() if saved else font
        elif op == "Tf":
            if args and isinstance(args[0], Name):
                font = fonts.get(str(args[0]))
        elif font is not None and op in ("Tj", "'", '"', "TJ"):
            if op == "TJ":
                data = args[0] if args and isinstance(args[0], list) else []
            else:
                data = args[2:3] if op == '"' else args[:1]
            out += [t for x in data if isinstance(x, bytes) and (t := _decoded(font, x)[0])]
    return out


#: Operators that start a new line of text.
LINE_BREAKS = {"Td", "TD", "T*", "'", '"', "Tm"}


def breaks_line(op: str) -> bool:
    return op in LINE_BREAKS


class PageFonts(dict):
    """Fonts of a page by resource name, made when asked for; the same dictionary is made once a file."""

    def __init__(self, pdf: PdfFile, page: Page, cache: dict[int, Font]):
        super().__init__()
        self.pdf, self.cache = pdf, cache
        self.found = pdf.dict(pdf.dict(page.inherited.get("Resources")).get("Font"))

    def get(self, key: str, default: Any = None) -> Font | None:
        if key not in self:
            d = self.pdf.resolve(self.found.get(key))
            if not isinstance(d, dict):
                return default
            made, at = (d.made, "font") if isinstance(d, Shared) else (self.cache, id(d))
            if at not in made:
                made[at] = Font(self.pdf, d)
            self[key] = made[at]
        return self[key]

    def names(self) -> list[str]:
        return list(self.found)
