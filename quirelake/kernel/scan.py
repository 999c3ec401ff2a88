"""From bytes to values: tokens by regular expressions, values by recursive descent."""

from __future__ import annotations

import re
from typing import Any

from .values import Keyword, Name, Ref

_GAP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
#: What a token begins with: name, string, dictionary, its end, other delimiter, hexadecimal string, word.
_TOKEN = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*+(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(\()|(<<)|(>>)|([\[\]{})>])|(<)|([^\x00\t\n\x0c\r ()<>\[\]{}/%]+))?")
_NUMBER = re.compile(rb"[+-]*(\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"[\x00\t\n\x0c\r ]+(\d{1,10})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_STRING_STOP = re.compile(rb"[()\\\r]")
#: A string without strings in it, and arrays of whole numbers or of references alone.
_SIMPLE = re.compile(rb"((?:[^()\\\r]++|\\[^\r])*+)\)")
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
_WHOLE = re.compile(rb"[\t\n\x0c\r ]*+(\d{1,18}(?:[\t\n\x0c\r ]++\d{1,18})*+)[\t\n\x0c\r ]*+\]")
_REFERENCES = re.compile(rb"[\t\n\x0c\r ]*+((?:\d{1,10}[\t\n\x0c\r ]++\d{1,10}[\t\n\x0c\r ]++R(?:[\t\n\x0c\r ]++|(?=\])))++)\]")
_HASH = re.compile(rb"#([0-9A-Fa-f]{2})")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\x0c"}

END = Keyword(b"")
OPEN_DICT, CLOSE_DICT, OPEN_LIST, CLOSE_LIST = Keyword(b"<<"), Keyword(b">>"), Keyword(b"["), Keyword(b"]")
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
_UNESCAPED = {bytes([c]): bytes([c]) for c in range(256)} | {bytes([c]): v for c, v in _ESCAPES.items()} | {b"\n": b"", b"\r": b""}
_UNESCAPED |= {format(v, f"0{n}o").encode(): bytes([v & 0xFF]) for n in (1, 2, 3) for v in range(8**n)}
_DELIMITERS = {bytes([c]): Keyword(bytes([c])) for c in b"[]{})>"}


def to_number(word: bytes) -> float | int | None:
    """A lenient number; the sign is the one right before the first digit."""
    m = _NUMBER.match(word)
    if not m:
        return None
    digits = m[1]
    value = float(digits) if b"." in digits else int(digits)
    return -value if word[m.start(1) - 1 : m.start(1)] == b"-" else value


class Scanner:
    """A place in a buffer."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def gap(self) -> int:
        self.at = _GAP.match(self.data, self.at).end()
        return self.at

    def token(self) -> Any:
        """The next token: a number, Name, bytes or Keyword; END past the last."""
        m = _TOKEN.match(self.data, self.at)
        kind, self.at = m.lastindex, m.end()
        if kind == 7:
            word = m[7]
            if word.isdigit():
                return int(word)
            if word[0] in b"0123456789+-." and (value := to_number(word)) is not None:
                return value
            return Keyword(word)
        if kind == 1:
            word = m[1]
            return Name((_HASH.sub(lambda h: bytes([int(h[1], 16)]), word) if b"#" in word else word).decode("latin-1"))
        if kind == 2:
            return self._literal(self.at)
        if kind == 3:
            return OPEN_DICT
        if kind == 4:
            return CLOSE_DICT
        if kind == 6:
            return self._hex(self.at)
        return END if kind is None else _DELIMITERS[m[5]]

    def _literal(self, at: int) -> bytes:
        if m := _SIMPLE.match(self.data, at):
            self.at = m.end()
            return _ESCAPE.sub(lambda e: _UNESCAPED[e[1]], m[1]) if b"\\" in m[1] else m[1]
        data, out, depth = self.data, [], 1
        while True:
            m = _STRING_STOP.search(data, at)
            if not m:
                out.append(data[at:])
                self.at = len(data)
                break
            out.append(data[at : m.start()])
            at, c = m.end(), data[m.start()]
            if c == 0x28:
                depth += 1
                out.append(b"(")
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at
                    break
                out.append(b")")
            elif c == 0x0D:  # any line end reads as a line feed
                out.append(b"\n")
                at += data[at : at + 1] == b"\n"
            else:
                octal = _OCTAL.match(data, at)
                if octal:
                    out.append(bytes([int(octal[0], 8) & 0xFF]))
                    at = octal.end()
                elif data[at : at + 2] == b"\r\n":
                    at += 2
                elif data[at : at + 1] in (b"\n", b"\r"):
                    at += 1
                elif at < len(data):
                    out.append(_ESCAPES.get(data[at], data[at : at + 1]))
                    at += 1
        return b"".join(out)

    def _hex(self, at: int) -> bytes:
        end = self.data.find(b">", at)
        end = len(self.data) if end < 0 else end
        self.at = end + 1
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[at:end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def value(self, depth: int = 0) -> Any:
        """The next value; a Keyword where there is none."""
        token = self.token()
        if isinstance(token, int) and not isinstance(token, bool) and token >= 0:
            m = _REFERENCE.match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(token, int(m[1]))
            return token
        if not isinstance(token, Keyword) or depth > 200:
            return token
        if token == OPEN_LIST:
            if m := _WHOLE.match(self.data, self.at):
                self.at = m.end()
                return list(map(int, m[1].split()))
            if m := _REFERENCES.match(self.data, self.at):
                self.at = m.end()
                words = m[1].split()
                return [Ref(int(a), int(b)) for a, b in zip(words[::3], words[1::3])]
            out = []
            while True:
                item = self.value(depth + 1)
                if isinstance(item, Keyword):
                    if item == CLOSE_LIST or item == END:
                        return out
                    if item in (b"endobj", b"endstream", b"obj"):
                        self.at -= len(item)
                        return out
                    continue
                out.append(item)
        if token == OPEN_DICT:
            found: dict[str, Any] = {}
            while True:
                key = self.value(depth + 1)
                if isinstance(key, Keyword):
                    if key == CLOSE_DICT or key == END:
                        return found
                    if key in (b"endobj", b"endstream", b"stream"):
                        self.at -= len(key)
                        return found
                    continue
                if not isinstance(key, Name):
                    continue  # a stray value: what follows may still be pairs
                before = self.at
                item = self.value(depth + 1)
                if isinstance(item, Keyword):
                    if item == CLOSE_DICT:
                        self.at = before
                    item = None
                found.setdefault(str(key), item)
        if bytes(token) in _CONSTANTS:
            return _CONSTANTS[bytes(token)]
        return token
