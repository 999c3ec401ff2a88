"""Page edits over a file: a list of steps in, bytes out. The source is never changed in place."""

from __future__ import annotations

import copy
from typing import Any

from .content import Operation, operations
from .document import MAX_DEPTH, PdfFile, box, quarter_turn
from .scan import Scanner
from .values import Name, Ref, Stream, number
from .writer import Writer, format_operations

_INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class _Node:
    """A page or a node of the page tree, with the tree as it will be saved."""

    def __init__(self, ref: Ref, d: dict[str, Any], parent: _Node | None):
        self.ref, self.dict, self.parent, self.kids = ref, d, parent, None

    def pages(self) -> list[_Node]:
        return [self] if self.kids is None else [p for k in self.kids for p in k.pages()]


class Editor:
    """Steps change a copy of the page tree; ``save`` writes it."""

    def __init__(self, pdf: PdfFile):
        self.pdf, self.writer = pdf, Writer(pdf)
        self._seen: set[int] = set()
        root = pdf.catalog.get("Pages")
        self.root = self._read(root, None, 0) or _Node(self.writer.alloc(), {"Type": Name("Pages")}, None)
        if self.root.kids is None:
            self.root.kids = []
        self.tree_changed = False

    def _read(self, ref: Any, parent: _Node | None, depth: int) -> _Node | None:
        d = self.pdf.resolve(ref)
        if not isinstance(d, dict) or depth > MAX_DEPTH or isinstance(ref, Ref) and ref.num in self._seen:
            return None
        if isinstance(ref, Ref):
            self._seen.add(ref.num)
        else:  # a page belongs in the tree by reference
            ref, self.tree_changed = self.writer.alloc(), True
        node = _Node(ref, copy.copy(d), parent)
        kids = self.pdf.resolve(d.get("Kids"))
        if isinstance(kids, list):
            node.kids = [k for k in (self._read(x, node, depth + 1) for x in kids) if k]
        return node

    # -- lookups ------------------------------------------------------------

    def page(self, index: int) -> _Node | None:
        pages = self.root.pages()
        return pages[index] if 0 <= index < len(pages) else None

    def inherited(self, node: _Node | None, key: str) -> Any:
        while node is not None:
            value = self.writer.resolve(node.dict.get(key))
            if value is not None:
                return [self.writer.resolve(v) for v in value] if isinstance(value, list) else value
            node = node.parent
        return None

    def _put(self, node: _Node) -> None:
        self.writer.set(node.ref, node.dict)

    def _keep_inherited(self, node: _Node) -> None:
        """A page that changes parents holds on to what it had from the old ones."""
        for key in _INHERITED:
            if key not in node.dict and (value := self.inherited(node, key)) is not None:
                node.dict[key] = value

    def _insert(self, at: int, node: _Node) -> None:
        pages = self.root.pages()
        at = max(0, min(at, len(pages)))
        if at < len(pages):
            parent = pages[at].parent
            place = parent.kids.index(pages[at])
        else:
            parent = pages[-1].parent if pages else self.root
            place = parent.kids.index(pages[-1]) + 1 if pages else 0
        parent.kids.insert(place, node)
        node.parent, node.dict["Parent"] = parent, parent.ref
        self._put(node)
        self.tree_changed = True

    # -- steps --------------------------------------------------------------

    def insert_blank(self, at: int, width: float = 595.28, height: float = 841.89) -> None:
        content = self.writer.add(Stream({}, b"\n"))
        d = {"Type": Name("Page"), "MediaBox": [0, 0, width, height], "Resources": {}, "Contents": content}
        self._insert(at, _Node(self.writer.alloc(), d, None))

    def insert_copy(self, at: int, source: int) -> None:
        """A copy that shares contents and resources; a blank page where there is no such source."""
        page = self.page(source)
        if page is None:
            self.insert_blank(at)
            return
        d = {k: v for k, v in page.dict.items() if k != "Parent"}
        for key in _INHERITED:
            if key not in d and (value := self.inherited(page, key)) is not None:
                d[key] = value
        self._insert(at, _Node(self.writer.alloc(), d, None))

    def remove(self, indices: list[int]) -> int:
        pages = self.root.pages()
        gone = [pages[i] for i in set(indices) if 0 <= i < len(pages)]
        for page in gone:
            page.parent.kids.remove(page)
        self.tree_changed |= bool(gone)
        return len(gone)

    def move(self, source: int, to: int) -> None:
        page = self.page(source)
        count = len(self.root.pages())
        to = max(0, min(to, count - 1))
        if page is None or to == source:
            return
        self._keep_inherited(page)
        page.parent.kids.remove(page)
        self._insert(to, page)

    def set_rotation(self, index: int, degrees: float) -> None:
        self.set_inherited(index, "Rotate", quarter_turn(degrees))

    def set_inherited(self, index: int, key: str, value: Any) -> None:
        """Set a key on the page itself, over any ancestor."""
        page = self.page(index)
        if page is not None:
            page.dict[key] = value
            self._put(page)

    def set_content(self, index: int, data: bytes) -> None:
        page = self.page(index)
        if page is not None:
            page.dict["Contents"] = self.writer.add(Stream({}, data))
            self._put(page)

    def content(self, index: int) -> bytes:
        page = self.page(index)
        value = self.writer.resolve(page.dict.get("Contents")) if page else None
        streams = [value] if isinstance(value, Stream) else [self.writer.resolve(v) for v in value or []]
        return b"\n".join(self.pdf.decode(s)[0] for s in streams if isinstance(s, Stream))

    def set_box(self, index: int, key: str, new: tuple[float, float, float, float], scale_content: bool = False) -> None:
        page = self.page(index)
        if page is None:
            return
        old = box(self.inherited(page, key)) or box(self.inherited(page, "MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        page.dict[key] = list(new)
        self._put(page)
        if scale_content:
            s = min((new[2] - new[0]) / ((old[2] - old[0]) or 1), (new[3] - new[1]) / ((old[3] - old[1]) or 1))
            ops = operations(self.content(index))
            ops = [Operation("q", []), Operation("cm", [s, 0, 0, s, -new[0], -new[1]]), *ops, Operation("Q", [])]
            self.set_content(index, format_operations(ops))

    # -- saving -------------------------------------------------------------

    def _finish(self, node: _Node) -> int:
        """Kids, Count and Parent from the leaves up."""
        if node.kids is None:
            if node.parent is not None and node.dict.get("Parent") != node.parent.ref:
                node.dict["Parent"] = node.parent.ref
                self._put(node)
            return 1
        count = sum(self._finish(k) for k in node.kids)
        node.dict = {**node.dict, "Type": Name("Pages"), "Kids": [k.ref for k in node.kids], "Count": count}
        if node.parent is not None:
            node.dict["Parent"] = node.parent.ref
        self._put(node)
        return count

    def save(self, incremental: bool = True, compress: bool = False) -> bytes:
        if self.tree_changed:
            self._finish(self.root)
            if self.pdf.catalog.get("Pages") != self.root.ref and isinstance(self.pdf.trailer.get("Root"), Ref):
                self.writer.set(self.pdf.trailer["Root"], {**self.pdf.catalog, "Pages": self.root.ref})
        return self.writer.save(incremental, compress)


def _value(value: float | None, syntax: str | None) -> Any:
    """A number, or the object that PDF syntax (a name, string, array, dictionary or reference) stands for."""
    if syntax is not None:
        return Scanner(syntax.encode("latin-1")).value()
    return int(value) if number(value) is not None and float(value).is_integer() else value


def apply_edits(data: bytes, steps: list[dict[str, Any]], incremental: bool = True, compress: bool = False) -> bytes:
    """Steps in order, each with ``op`` and its arguments; unknown ones are errors."""
    pdf = PdfFile(data)
    if pdf.encrypted:
        raise ValueError("an encrypted file can't be edited")
    e = Editor(pdf)
    for step in steps:
        op = step["op"]
        arg = lambda k, d=None: d if step.get(k) is None else step[k]  # noqa: B023, E731
        if op == "insert_blank":
            e.insert_blank(arg("at", 0), arg("width", 595.28), arg("height", 841.89))
        elif op == "insert_copy":
            e.insert_copy(arg("at", 0), arg("page", 0))
        elif op == "remove":
            e.remove(list(arg("pages", [])) or [arg("page", -1)])
        elif op == "move":
            e.move(arg("page", -1), arg("at", 0))
        elif op == "rotate":
            e.set_rotation(arg("page", -1), arg("degrees", 0))
        elif op == "set_box":
            e.set_box(arg("page", -1), arg("key", "MediaBox"), tuple(arg("box")), bool(arg("scale_content", False)))
        elif op == "set_content":
            e.set_content(arg("page", -1), bytes(arg("content", b"")))
        elif op == "set_inherited":
            e.set_inherited(arg("page", -1), arg("key"), _value(arg("value"), arg("syntax")))
        elif op == "set_trailer":
            e.writer.overrides[arg("key")] = _value(arg("value"), arg("syntax"))
        else:
            raise ValueError(f"unknown edit {op}")
    return e.save(incremental, compress)
