"""A PDF builder of its own for tests and queries: it shares no code with the kernel.

A file has one page for each list of lines. Text is set in a fixed-width font of 600 units with
``/Differences`` for what WinAnsi shares with Latin-1, at 10 points from (72, 720) down by 12.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

WIDTH, SIZE, LEFT, TOP, LEADING = 600, 10, 72, 720, 12


_LITERAL = [b"\\" + bytes([c]) if c in b"()\\" else bytes([c]) if 32 <= c < 127 else b"\\%03o" % c for c in range(256)]
_ESCAPED = re.compile(rb"[^ -'*-\[\]-~]")


def literal(text: str) -> bytes:
    return b"(" + _ESCAPED.sub(lambda m: _LITERAL[m[0][0]], text.encode("latin-1")) + b")"


def page_content(lines: list[str]) -> bytes:
    body = [b"BT", b"/F1 %d Tf" % SIZE, b"%d TL" % LEADING, b"1 0 0 1 %d %d Tm" % (LEFT, TOP)]
    for i, line in enumerate(lines):
        body.append((literal(line) + b" Tj") if not i else (b"T* " + literal(line) + b" Tj"))
    return b"\n".join([*body, b"ET"])


def operator_content(lines: list[str]) -> bytes:
    """Lines shown with other text operators in turn, each from its own origin; between them an inline image that looks like text."""
    body = [b"BT", b"/F1 %d Tf" % SIZE, b"ET", b"q BI /W 4 /H 1 /BPC 8 /CS /G ID (EI) EI Q", b"BT"]
    for k, line in enumerate(lines):
        t = literal(line)
        shown = [
            t + b" Tj",
            b"1.5 Tc " + t + b" Tj 0 Tc",
            b"2 Tw " + t + b" Tj 0 Tw",
            b"50 Tz " + t + b" Tj 100 Tz",
            b"3 Ts 10 -5 Td [-500 " + t + b" 200] TJ 0 Ts",
            b"12 TL " + t + b" '",
            b"12 TL 1 2 " + t + b' " 0 Tw 0 Tc',
            b"3 Tr 5 -6 TD " + t + b" Tj 0 Tr",
        ]
        body += [b"1 0 0 1 %d %d Tm" % (LEFT, TOP - LEADING * k), shown[k % len(shown)]]
    return b"\n".join([*body, b"ET"])


def composite_content(lines: list[str]) -> bytes:
    """Lines in two-byte codes, as hexadecimal strings."""
    body = [b"BT", b"/F1 %d Tf" % SIZE, b"%d TL" % LEADING, b"1 0 0 1 %d %d Tm" % (LEFT, TOP)]
    body += [b"<" + line.encode("utf-16-be").hex().encode() + b"> Tj T*" for line in lines]
    return b"\n".join([*body, b"ET"])


#: A ToUnicode map with single codes, a range that counts up and a range with a list.
TO_UNICODE = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap
1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0020> <0020> <0021> <0021> endbfchar
2 beginbfrange <0022> <00FD> <0022> <00FE> <00FF> [<00FE> <00FF>] endbfrange
endcmap end end"""


def ascii85(data: bytes) -> bytes:
    n = np.frombuffer(data + b"\0" * (-len(data) % 4), ">u4").astype(np.int64)
    digits = (n[:, None] // 85 ** np.arange(4, -1, -1) % 85 + 33).astype(np.uint8)
    rest = len(data) % 4
    whole = n[:-1] if rest else n
    if (whole == 0).any():
        out = b"".join(b"z" if not v else d.tobytes() for v, d in zip(whole.tolist(), digits))
    else:
        out = digits[: len(whole)].tobytes()
    return out + (digits[-1, : rest + 1].tobytes() if rest else b"") + b"~>"


def lzw(data: bytes, early: int = 1) -> bytes:
    table, width, bits, held = {}, 9, 9, 256
    size, word, out = 258, -1, bytearray()
    for c in data:
        if word < 0:
            word = c
            continue
        longer = word << 8 | c
        if longer in table:
            word = table[longer]
            continue
        held, bits = held << width | word, bits + width
        table[longer] = size
        size += 1
        if size + early > 1 << width and width < 12:
            width += 1
        if size >= 4094:
            held, bits = held << width | 256, bits + width
            table, width, size = {}, 9, 258
        word = c
        if bits > 512:
            bits -= (whole := bits & ~7)
            out += (held >> bits).to_bytes(whole >> 3, "big")
            held &= (1 << bits) - 1
    if word >= 0:
        held, bits = held << width | word, bits + width
        size += 1
        if size + early > 1 << width and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    return bytes(out) + (held << (-bits & 7)).to_bytes(bits + 7 >> 3, "big")


def run_length(data: bytes) -> bytes:
    """Single bytes and repeats of up to 100, two bytes each."""
    x = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(np.diff(x, prepend=x[:1] ^ 1)) if len(x) else np.zeros(0, np.int64)
    each = np.diff(first, append=len(x))
    parts = -(-each // 100)
    size = np.full(parts.sum(), 100)
    if len(size):
        size[np.cumsum(parts) - 1] = each - (parts - 1) * 100
    out = np.stack([np.where(size == 1, 0, 257 - size).astype(np.uint8), np.repeat(x[first], parts)], axis=1)
    return out.tobytes() + b"\x80"


def png_up(data: bytes, columns: int) -> bytes:
    rows = np.frombuffer(data + b" " * (-len(data) % columns), np.uint8).reshape(-1, columns)
    up = rows - np.concatenate([np.zeros((1, columns), np.uint8), rows[:-1]])
    return np.concatenate([np.full((len(rows), 1), 2, np.uint8), up], axis=1).tobytes()


def packed(data: bytes, how: str) -> tuple[bytes, bytes]:
    """Dictionary entries and encoded bytes for a filter by name: flate, hex, a85, rl, lzw, png, chain or plain."""
    if how == "flate":
        return b"/Filter /FlateDecode ", zlib.compress(data)
    if how == "hex":
        return b"/Filter /ASCIIHexDecode ", data.hex().encode() + b">"
    if how == "a85":
        return b"/Filter /ASCII85Decode ", ascii85(data)
    if how == "rl":
        return b"/Filter /RunLengthDecode ", run_length(data)
    if how == "lzw":
        return b"/Filter /LZWDecode ", lzw(data)
    if how == "png":
        return b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 32 >> ", zlib.compress(png_up(data, 32))
    if how == "chain":
        return b"/Filter [/ASCII85Decode /FlateDecode] ", ascii85(zlib.compress(data))
    return b"", data


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /LastChar 255 /Widths [%s] /Encoding << /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [128 %s] >> >>" % (
    b" ".join([b"%d" % WIDTH] * 224),
    b" ".join(b"/uni%04X" % c for c in range(128, 256)),
)


def objects(pages: list[list[str]], how: str = "plain", labels: bytes = b"", titles: list[str] | None = None, rotate: int = 0, nested: bool = False, content=page_content, composite: bool = False, tree: bool = False, info: str | None = None) -> dict[int, bytes]:
    """Object bodies by number: 1 catalog, 2 page tree, 3 font, then two for each page, then bookmarks and inner nodes."""
    out: dict[int, bytes] = {3: FONT}
    n = len(pages)
    page_num = [4 + 2 * i for i in range(n)]
    extra = 4 + 2 * n
    kids, parents = page_num, [2] * n
    if nested and n > 1:
        half = [page_num[: n // 2], page_num[n // 2 :]]
        kids = [extra, extra + 1]
        for k, own in zip(kids, half):
            out[k] = b"<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] >>" % (len(own), b" ".join(b"%d 0 R" % p for p in own))
        parents = [extra] * len(half[0]) + [extra + 1] * len(half[1])
        extra += 2
    turn = b" /Rotate %d" % rotate if rotate else b""
    out[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >>%s >>" % (n, b" ".join(b"%d 0 R" % k for k in kids), turn)
    for i, lines in enumerate(pages):
        entries, data = packed(content(lines), how)
        out[page_num[i]] = b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (parents[i], page_num[i] + 1)
        out[page_num[i] + 1] = b"<< %s/Length %d >>\nstream\n" % (entries, len(data)) + data + b"\nendstream"
    outline = b""
    if titles:
        outline = b" /Outlines %d 0 R" % extra
        out[extra] = b"<< /Type /Outlines /First %d 0 R /Last %d 0 R /Count %d >>" % (extra + 1, extra + len(titles), len(titles))
        if tree:  # the first bookmark holds the second, which holds the third
            out[extra] = b"<< /Type /Outlines /First %d 0 R /Last %d 0 R /Count 1 >>" % (extra + 1, extra + 1)
        for i, title in enumerate(titles):
            if tree:
                more = b" /First %d 0 R /Last %d 0 R /Count 1" % (extra + 2 + i, extra + 2 + i) if i + 1 < len(titles) else b""
                out[extra + 1 + i] = b"<< /Title %s /Parent %d 0 R /A << /S /GoTo /D [%d 0 R /Fit] >>%s >>" % (literal(title), extra + i, page_num[min(i, n - 1)], more)
                continue
            after = b" /Next %d 0 R" % (extra + 2 + i) if i + 1 < len(titles) else b""
            out[extra + 1 + i] = b"<< /Title %s /Parent %d 0 R /Dest [%d 0 R /Fit]%s >>" % (literal(title), extra, page_num[min(i, n - 1)], after)
    if composite:
        last = max(*out, extra)
        entries, data = packed(TO_UNICODE, "flate")
        out[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (last + 1, last + 2)
        out[last + 1] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Wide /DW 500 /W [32 [600 600] 34 255 600] >>"
        out[last + 2] = b"<< %s/Length %d >>\nstream\n" % (entries, len(data)) + data + b"\nendstream"
    if info is not None:
        out[max(out) + 1] = b"<< /Title %s /Producer (builder) >>" % literal(info)
    out[1] = b"<< /Type /Catalog /Pages 2 0 R%s%s >>" % (outline, b" /PageLabels << /Nums [%s] >>" % labels if labels else b"")
    return out


def classic(found: dict[int, bytes], shift: int = 0, cut: bool = False) -> bytes:
    """A file with a plain index; ``shift`` falsifies its offsets, ``cut`` leaves the index and trailer out."""
    out = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    at = {}
    for num in sorted(found):
        at[num] = len(out)
        out += b"%d 0 obj\n" % num + found[num] + b"\nendobj\n"
    if cut:
        return bytes(out)
    start, size = len(out), max(found) + 1
    named = b" /Info %d 0 R" % (size - 1) if b"/Producer (builder)" in found[size - 1] else b""
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for num in range(1, size):
        out += b"%010d 00000 n \n" % (at[num] + shift) if num in at else b"0000000000 00001 f \n"
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (size, named, start))


def append(base: bytes, changes: dict[int, bytes], size: int) -> bytes:
    """A later revision after ``base``."""
    before = int(base.rpartition(b"startxref")[2].split()[0])
    out, at = bytearray(base), {}
    for num, body in sorted(changes.items()):
        at[num] = len(out)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, a) for n, a in sorted(at.items()))
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (size, before, start))


def with_object_streams(found: dict[int, bytes]) -> bytes:
    """Objects that aren't streams in one object stream, with an index stream."""
    loose = {n: b for n, b in found.items() if b"\nstream\n" not in b}
    holder, index = max(found) + 1, max(found) + 2
    heads, body = [], bytearray()
    for num in sorted(loose):
        heads.append(b"%d %d" % (num, len(body)))
        body += loose[num] + b"\n"
    head = b" ".join(heads) + b" "
    data = zlib.compress(head + bytes(body))
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    at = {}
    for num in sorted(set(found) - set(loose)):
        at[num] = len(out)
        out += b"%d 0 obj\n" % num + found[num] + b"\nendobj\n"
    at[holder] = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (holder, len(loose), len(head), len(data)) + data + b"\nendstream\nendobj\n"
    start = at[index] = len(out)
    rows = bytearray(b"\0" + bytes(4) + b"\xff\xff")
    place = {num: i for i, num in enumerate(sorted(loose))}
    for num in range(1, index + 1):
        if num in place:
            rows += b"\2" + holder.to_bytes(4, "big") + place[num].to_bytes(2, "big")
        elif num in at:
            rows += b"\1" + at[num].to_bytes(4, "big") + b"\0\0"
        else:
            rows += b"\0" + bytes(6)
    return bytes(out + b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Length %d >>\nstream\n" % (index, index + 1, len(rows)) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % start)


def document(text: str, how: str = "plain", form: str = "classic", one_page_a_line: bool = False, **more) -> bytes:
    """A file for a text: form is classic, objstm, shifted, cut, revised (twice) or nested."""
    lines = text.split("\n")
    pages = [[line] for line in lines] if one_page_a_line else [lines]
    found = objects(pages, how, nested=form == "nested", **more)
    if form == "objstm":
        return with_object_streams(found)
    if form == "shifted":
        return classic(found, shift=5000)
    if form == "cut":
        return classic(found, cut=True)
    if form == "revised":
        base = classic({**found, 5: b"<< /Length 3 >>\nstream\nq Q\nendstream"})
        size = max(found) + 1
        once = append(base, {5: b"<< /Length 22 >>\nstream\nBT (to be replaced) ET \nendstream"}, size)
        return append(once, {5: found[5]}, size)
    return classic(found)
