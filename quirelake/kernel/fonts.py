"""Fonts: how wide a character code is, and what text it stands for."""

from __future__ import annotations

import codecs
import re
import unicodedata
from functools import lru_cache
from typing import Any

import numpy as np

from .document import PdfFile
from .scan import CLOSE_LIST, END, OPEN_LIST, Scanner
from .values import Keyword, Name, Stream, name, number

#: Glyph names that no rule below gives, from the public glyph list.
_NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©",
    "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²",
    "threesuperior": "³", "onesuperior": "¹", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º",
    "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷",
    "AE": "Æ", "ae": "æ", "Eth": "Ð", "eth": "ð", "Oslash": "Ø", "oslash": "ø", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "OE": "Œ", "oe": "œ",
    "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚",
    "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰",
    "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ",
    "Omega": "Ω", "pi": "π", "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "infinity": "∞", "integral": "∫",
    "approxequal": "≈", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "lozenge": "◊", "nbspace": " ", "sfthyphen": "­",
}
_MARKS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
#: Codes of the standard encoding past ASCII, and the two that differ in it, by glyph name.
_STANDARD = {
    0x27: "quoteright", 0x60: "quoteleft", 0xA1: "exclamdown", 0xA2: "cent", 0xA3: "sterling", 0xA4: "fraction", 0xA5: "yen", 0xA6: "florin", 0xA7: "section",
    0xA8: "currency", 0xA9: "quotesingle", 0xAA: "quotedblleft", 0xAB: "guillemotleft", 0xAC: "guilsinglleft", 0xAD: "guilsinglright", 0xAE: "fi", 0xAF: "fl",
    0xB1: "endash", 0xB2: "dagger", 0xB3: "daggerdbl", 0xB4: "periodcentered", 0xB6: "paragraph", 0xB7: "bullet", 0xB8: "quotesinglbase", 0xB9: "quotedblbase",
    0xBA: "quotedblright", 0xBB: "guillemotright", 0xBC: "ellipsis", 0xBD: "perthousand", 0xBF: "questiondown", 0xC1: "grave", 0xC2: "acute", 0xC3: "circumflex",
    0xC4: "tilde", 0xC5: "macron", 0xC6: "breve", 0xC7: "dotaccent", 0xC8: "dieresis", 0xCA: "ring", 0xCB: "cedilla", 0xCD: "hungarumlaut", 0xCE: "ogonek",
    0xCF: "caron", 0xD0: "emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash", 0xE9: "Oslash", 0xEA: "OE", 0xEB: "ordmasculine", 0xF1: "ae",
    0xF5: "dotlessi", 0xF8: "lslash", 0xF9: "oslash", 0xFA: "oe", 0xFB: "germandbls",
}


@lru_cache(maxsize=4096)
def glyph_text(glyph: str) -> str:
    """Text of a glyph name; empty where it's not known."""
    glyph = glyph.partition(".")[0]
    if "_" in glyph:
        return "".join(map(glyph_text, glyph.split("_")))
    if glyph in _NAMES:
        return _NAMES[glyph]
    if len(glyph) == 1 and glyph.isalpha():
        return glyph
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)", glyph) or re.fullmatch(r"u([0-9A-F]{4,6})", glyph)
    if m:
        digits = m[1]
        points = [int(digits[i : i + 4], 16) for i in range(0, len(digits), 4)] if glyph.startswith("uni") else [int(digits, 16)]
        return "".join(chr(p) for p in points if p < 0x110000 and not 0xD800 <= p < 0xE000)
    mark = _MARKS.get(glyph[1:])
    if mark and glyph[0].isascii() and glyph[0].isalpha():
        made = unicodedata.normalize("NFC", glyph[0] + mark)
        return made if len(made) == 1 else ""
    return ""


@lru_cache(maxsize=8)
def encoding(kind: str) -> dict[int, str]:
    """Text by code for a predefined encoding."""
    if kind in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if kind == "WinAnsiEncoding" else "mac_roman"
        out = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256) if c != 127}
        if kind == "WinAnsiEncoding":  # unused codes show a bullet
            out = {c: t or "•" for c, t in out.items()}
        return out
    out = {c: chr(c) for c in range(32, 127)}
    return out | {c: _NAMES[g] for c, g in _STANDARD.items()}


def parse_cmap(data: bytes) -> dict[int, str]:
    """Text by code from the bfchar and bfrange blocks of a ToUnicode map."""
    out: dict[int, str] = {}
    s, held = Scanner(data), []

    def show(value: bytes) -> str:
        return value.decode("utf-16-be", "ignore") if len(value) > 1 else value.decode("latin-1")

    while (token := s.token()) != END or not isinstance(token, Keyword):
        if isinstance(token, Keyword) and token in (b"beginbfchar", b"beginbfrange"):
            held = []
        elif isinstance(token, Keyword) and token == b"endbfchar":
            for code, value in zip(held[::2], held[1::2]):
                if isinstance(code, bytes) and isinstance(value, (bytes, Name)):
                    out[int.from_bytes(code, "big")] = glyph_text(value) if isinstance(value, Name) else show(value)
            held = []
        elif isinstance(token, Keyword) and token == b"endbfrange":
            for low, high, value in zip(held[::3], held[1::3], held[2::3]):
                if not isinstance(low, bytes) or not isinstance(high, bytes):
                    continue
                a, b = int.from_bytes(low, "big"), min(int.from_bytes(high, "big"), int.from_bytes(low, "big") + 0xFFFF)
                for k, code in enumerate(range(a, b + 1)):
                    if isinstance(value, list):
                        if k < len(value) and isinstance(value[k], bytes):
                            out[code] = show(value[k])
                    elif isinstance(value, bytes) and value:
                        last = int.from_bytes(value[-2:], "big") + k
                        out[code] = show(value[:-2] + last.to_bytes(2, "big")) if last < 0x10000 else ""
            held = []
        elif isinstance(token, Keyword) and token == OPEN_LIST:
            items = []
            while (item := s.token()) != CLOSE_LIST and item != END:
                items.append(item)
            held.append(items)
        else:
            held.append(token)
    return out


class Font:
    """A font resource. ``text`` and ``width`` (in units of the font size) are by code."""

    def __init__(self, pdf: PdfFile, d: dict[str, Any]):
        self.subtype, self.base_font = name(pdf.resolve(d.get("Subtype"))), name(pdf.resolve(d.get("BaseFont")))
        self.two_byte = self.subtype == "Type0"
        self.to_unicode: dict[int, str] = {}
        stream = pdf.resolve(d.get("ToUnicode"))
        if isinstance(stream, Stream):
            self.to_unicode = parse_cmap(pdf.decode(stream)[0])
        self.first_char = 0
        self.widths: dict[int, float] = {}
        self.default_width = 0.0
        self.differences: dict[int, str] = {}
        self.base: dict[int, str] = {}
        if self.two_byte:
            kids = pdf.resolve(d.get("DescendantFonts"))
            self._composite(pdf, pdf.dict(kids[0]) if isinstance(kids, list) and kids else {})
        else:
            self._simple(pdf, d)
        self._text: dict[int, str] = {}
        self._table: tuple[str, np.ndarray] | None = None

    def _simple(self, pdf: PdfFile, d: dict[str, Any]) -> None:
        unit = 0.001
        matrix = pdf.resolve(d.get("FontMatrix"))
        if self.subtype == "Type3" and isinstance(matrix, list) and matrix:
            unit = abs(float(number(pdf.resolve(matrix[0]), 0.001)))
        self.first_char = int(number(pdf.resolve(d.get("FirstChar")), 0))
        widths = pdf.resolve(d.get("Widths"))
        for i, w in enumerate(widths if isinstance(widths, list) else []):
            self.widths[self.first_char + i] = float(number(pdf.resolve(w), 0)) * unit
        self.default_width = float(number(pdf.resolve(pdf.dict(d.get("FontDescriptor")).get("MissingWidth")), 0)) * unit
        coded = pdf.resolve(d.get("Encoding"))
        base = coded if isinstance(coded, Name) else pdf.resolve(coded.get("BaseEncoding")) if isinstance(coded, dict) else None
        symbolic = re.search(r"Symbol|Dingbats", self.base_font or "") is not None
        self.base = encoding(str(base)) if isinstance(base, Name) else {} if symbolic else encoding("StandardEncoding")
        at = 0
        changes = pdf.resolve(coded.get("Differences")) if isinstance(coded, dict) else None
        for item in changes if isinstance(changes, list) else []:
            item = pdf.resolve(item)
            if isinstance(item, Name):
                self.differences[at] = str(item)
                at += 1
            elif number(item) is not None:
                at = int(item)

    def _composite(self, pdf: PdfFile, d: dict[str, Any]) -> None:
        self.default_width = float(number(pdf.resolve(d.get("DW")), 1000)) / 1000
        items = [pdf.resolve(x) for x in pdf.resolve(d.get("W")) or []]
        at = 0
        while at + 1 < len(items):
            first = int(number(items[at], 0))
            if isinstance(items[at + 1], list):
                for i, w in enumerate(items[at + 1]):
                    self.widths[first + i] = float(number(pdf.resolve(w), 0)) / 1000
                at += 2
            elif at + 2 < len(items):
                for code in range(first, min(int(number(items[at + 1], 0)), first + 0xFFFF) + 1):
                    self.widths[code] = float(number(items[at + 2], 0)) / 1000
                at += 3
            else:
                break

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default_width)

    def text(self, code: int) -> str:
        out = self._text.get(code)
        if out is None:
            out = self._text[code] = self._look(code)
        return out

    def _look(self, code: int) -> str:
        if code in self.to_unicode:
            return self.to_unicode[code]
        if self.two_byte:
            return ""
        if code in self.differences:
            return glyph_text(self.differences[code])
        return self.base.get(code, chr(code) if 32 <= code < 127 else "")

    def codes(self, data: bytes) -> list[int]:
        """Codes of a string: two bytes each for composite fonts (an odd last byte is its high half)."""
        if not self.two_byte:
            return list(data)
        data = data + b"\0" * (len(data) % 2)
        return np.frombuffer(data, ">u2").tolist()

    def tables(self) -> tuple[str, np.ndarray]:
        """Text and width of each code of a simple font; what isn't one character is left to ``text``."""
        if self._table is None:
            one = [t if len(t := self.text(c)) == 1 else "\ufffe" for c in range(256)]
            self._table = "".join(one), np.array([self.width(c) for c in range(256)])
        return self._table

    def by_byte(self, data: bytes) -> str | None:
        """The text of a string whose bytes are a character each; null where they aren't."""
        if self.two_byte:
            return None
        try:
            return codecs.charmap_decode(data, "strict", self.tables()[0])[0]
        except UnicodeDecodeError:
            return None

    def mapped_codes(self) -> list[int]:
        return sorted({*self.to_unicode, *self.differences, *self.widths, *self.base})
