"""PDF values as Python ones.

null, booleans, numbers, arrays and dictionaries are None, bool, int or float, list and dict (keys without
the slash); strings are bytes. Names, references and streams have the types below.
"""

from __future__ import annotations

from typing import Any, NamedTuple


class Name(str):
    """A name without its slash."""

    __slots__ = ()


class Keyword(bytes):
    """A bare word: an operator, or the likes of ``obj`` and ``endstream``."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    """A dictionary with bytes that are still encoded."""

    __slots__ = ("dict", "raw")

    def __init__(self, dict_: dict[str, Any], raw: bytes):
        self.dict, self.raw = dict_, raw


class Shared(dict):
    """A dictionary without references, the same object for all files that have its bytes; ``made`` keeps what follows from it."""

    __slots__ = ("made",)

    def __init__(self, *args):
        super().__init__(*args)
        self.made: dict[str, Any] = {}

    def __copy__(self) -> dict[str, Any]:
        return dict(self)


class PdfError(ValueError):
    """The bytes at some place aren't what they should be."""


def latin1(data: bytes) -> str:
    return bytes(data).decode("latin-1")


def text(data: bytes) -> str:
    """A text string: UTF-16BE after a byte order mark, otherwise one character a byte."""
    data = bytes(data)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def number(value: Any, default: float | None = None) -> float | None:
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def name(value: Any) -> str | None:
    return str(value) if isinstance(value, Name) else None
