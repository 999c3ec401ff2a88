"""The kernel alone: lexing, filters, indexes, fonts, text state, edits and saves."""

import math
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.fixtures import builder as b
from quirelake.kernel import content, edits, filters, matrix
from quirelake.kernel.document import PdfFile, box, quarter_turn
from quirelake.kernel.fonts import Font, encoding, glyph_text, parse_cmap
from quirelake.kernel.scan import Scanner, to_number
from quirelake.kernel.values import Name, Ref, Stream, text
from quirelake.kernel.writer import Writer, format_hex, format_number, format_value, subsections


def texts(data):
    pdf = PdfFile(data)
    cache = {}
    return ["".join(r.text for r in content.runs(content.operations(pdf.contents(p)), content.PageFonts(pdf, p, cache))) for p in pdf.pages()]


def raw_pdf(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    out, at = bytearray(b"%PDF-1.6\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in at.items())
    return bytes(out + b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF" % (max(at) + 1, trailer, start))


@pytest.mark.parametrize("word, value", [(b"12", 12), (b"-3.5", -3.5), (b"+7", 7), (b".5", 0.5), (b"--5", -5), (b"4.", 4.0), (b"-.25", -0.25), (b"1.2.3", 1.2)])
def test_numbers(word, value):
    assert to_number(word) == value


def test_tokens_and_values():
    s = Scanner(rb"% note" b"\n" rb"<< /A#42 (a\(b\)\101\n(c)) /R 3 0 R /H <48 6> /L [1 -2.5 true null /N] >>")
    assert s.value() == {"AB": b"a(b)A\n(c)", "R": Ref(3, 0), "H": b"H`", "L": [1, -2.5, True, None, "N"]}


def test_string_line_ends_and_octal():
    assert Scanner(b"(a\r\nb\rc\\\r\nd\\501)").value() == b"a\nb\ncdA"


def test_dictionary_goes_on_after_a_stray_value():
    assert Scanner(b"<< /A 1 7 /B 2 >>").value() == {"A": 1, "B": 2}


def test_text_strings():
    assert text(b"\xfe\xff\x00h\x20\xac") == "h€" and text(b"caf\xe9") == "café"


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_filters_round_trip(data):
    assert filters.ascii85_decode(b.ascii85(data)) == data
    assert filters.lzw_decode(b.lzw(data)) == data
    assert filters.lzw_decode(b.lzw(data, 0), 0) == data
    assert filters.run_length_decode(b.run_length(data)) == data
    assert filters.run_length_decode(filters.run_length_encode(data)) == data
    assert filters.flate_decode(filters.flate_encode(data)) == data
    assert filters.ascii_hex_decode(data.hex().encode() + b">") == data


def test_lzw_known_vector():
    # the example of the format's description: 45 45 45 45 45 65 45 45 45 66
    assert filters.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_lzw_over_width_changes():
    data = bytes(i * 7919 % 256 for i in range(9000))
    assert filters.lzw_decode(b.lzw(data)) == data


def test_png_predictors():
    rows = [b"\x01" + bytes([1, 1, 1]), b"\x02" + bytes([1, 1, 1]), b"\x03" + bytes([10, 0, 0]), b"\x04" + bytes([1, 1, 1]), b"\x09" + bytes([5, 6, 7]), b"\x00\x01"]
    out = filters.png_predictor(b"".join(rows), 1, 8, 3)
    assert list(out) == [1, 2, 3, 2, 3, 4, 11, 7, 5, 12, 8, 6, 5, 6, 7]


def test_tiff_predictor():
    assert list(filters.tiff_predictor(bytes([1, 1, 1, 255]), 1, 8, 4)) == [1, 2, 3, 2]
    assert list(filters.tiff_predictor(bytes([1, 2, 1, 2]), 2, 8, 2)) == [1, 2, 2, 4]
    assert filters.tiff_predictor(b"\x00\xff\x00\x01", 1, 16, 2) == b"\x00\xff\x01\x00"
    assert filters.tiff_predictor(b"\xaa", 1, 1, 8) == b"\xaa"


def test_filter_chain_stops_at_images_and_errors():
    assert filters.decode(b"x", ["DCT"], []) == (b"x", "DCTDecode", None)
    data, _, problem = filters.decode(b"zz", ["FlateDecode", "ASCIIHexDecode"], [])
    assert data == b"zz" and problem.startswith("FlateDecode")


@pytest.mark.parametrize("form", ["classic", "objstm", "shifted", "cut", "revised", "nested"])
@pytest.mark.parametrize("how", ["plain", "flate", "chain"])
def test_forms_give_the_same_text(form, how):
    source = "First (line)\nZweite Zeile é ÿ\nthird \\ one"
    data = b.document(source, how, form, one_page_a_line=form == "nested")
    assert "".join(texts(data)) == source.replace("\n", "")


def test_three_revisions_and_sections():
    pdf = PdfFile(b.document("a b c", "plain", "revised"))
    assert len(pdf.sections) == 3 and not pdf.repairs


def test_repair_codes():
    assert PdfFile(b.document("a", form="shifted")).repairs[0][0] == "rebuilt-xref"
    assert PdfFile(b"").pages() == [] and PdfFile(b"%PDF-1.4 rubbish").pages() == []


def test_indirect_and_wrong_lengths_and_tricky_streams():
    body = b"q (% endstream \n"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>", 3: b"<< /Length 4 0 R >>\nstream\n" + body + b"\nendstream", 4: b"%d" % len(body), 5: b"<< /Length 999 >>\nstream\nabc\nendstream"}
    pdf = PdfFile(raw_pdf(objects))
    assert pdf.get(3).raw == body and pdf.get(5).raw == b"abc"
    assert [c for c, _ in pdf.repairs] == ["stream-length"]


def test_encrypted_by_reference():
    pdf = PdfFile(raw_pdf({1: b"<< /Type /Catalog >>", 2: b"<< /Filter /Standard >>"}, b"/Root 1 0 R /Encrypt 2 0 R"))
    assert pdf.encrypted and pdf.encryption_filter == "Standard"


def test_inheritance_through_references():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] /MediaBox 5 0 R /Rotate -90 >>", 3: b"<< /Kids [4 0 R] /CropBox [50 60 10 20] >>", 4: b"<< /Type /Page >>", 5: b"[0 0 400 400]"}
    page = PdfFile(raw_pdf(objects)).pages()[0]
    assert box(page.inherited["MediaBox"]) == (0, 0, 400, 400) and box(page.inherited["CropBox"]) == (10, 20, 50, 60) and quarter_turn(page.inherited["Rotate"]) == 270


def test_hybrid_section_fills_free_slots_only():
    rows = b"\x01\x00\x00\x00\x09\x00\x00" * 2
    data = bytearray(b"%PDF-1.5\n")
    at = {}
    for n, body in ((1, b"<< /Type /Catalog >>"), (2, b"(two)"), (4, b"<< /Type /XRef /Size 4 /Index [2 2] /W [1 4 2] /Length 14 >>\nstream\n%s\nendstream")):
        at[n] = len(data)
        if n == 4:
            rows = b"\x01" + at[1].to_bytes(4, "big") + b"\0\0" + b"\x01" + at[2].to_bytes(4, "big") + b"\0\0"
            body = body % rows
        data += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(data)
    data += b"xref\n0 4\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \n0000000000 00000 f \ntrailer\n<< /Size 5 /Root 1 0 R /XRefStm %d >>\nstartxref\n%d\n%%%%EOF" % (at[1], at[2], at[4], start)
    pdf = PdfFile(bytes(data))
    assert pdf.entries[2].offset == at[2] and pdf.entries[3].offset == at[2]


def test_fonts():
    assert glyph_text("eacute") == "é" and glyph_text("uni20AC") == "€" and glyph_text("Scaron") == "Š" and glyph_text("f_i") == "fi" and glyph_text("g123") == ""
    assert encoding("WinAnsiEncoding")[0xE9] == "é" and encoding("MacRomanEncoding")[0x8E] == "é" and encoding("StandardEncoding")[0xE9] == "Ø"
    cmap = b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0078> <00660069>] endbfrange"
    assert parse_cmap(cmap) == {1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "fi"}


def test_composite_font():
    pdf = PdfFile(raw_pdf({1: b"<< /Type /Catalog >>", 2: b"<< /Subtype /Type0 /DescendantFonts [3 0 R] /ToUnicode 4 0 R >>", 3: b"<< /DW 500 /W [1 [600 700] 5 7 250] >>", 4: b"<< /Length 45 >>\nstream\n1 beginbfchar <0001> <0041> endbfchar         \nendstream"}))
    f = Font(pdf, pdf.get(2))
    assert [f.width(c) for c in (1, 2, 3, 6)] == [0.6, 0.7, 0.5, 0.25] and f.text(1) == "A" and f.codes(b"\0\1\2") == [1, 512]


class _Plain:
    """A font with Helvetica-like widths for a few letters."""

    two_byte = False
    widths = {65: 0.667, 32: 0.278}

    def codes(self, data):
        return list(data)

    def text(self, code):
        return chr(code)

    def width(self, code):
        return self.widths.get(code, 0.5)


def show(body: bytes, base=matrix.IDENTITY):
    return content.runs(content.operations(body), {"F1": _Plain()}, base)


def test_text_positions():
    run = show(b"BT /F1 10 Tf 72 700 Td (A) Tj ET")[0]
    assert math.isclose(run.width, 6.67) and run.height == 10 and (run.x, run.y) == (72, 700)
    a, c = show(b"BT /F1 10 Tf 2 Tc 3 Tw 50 Tz (A A) Tj (A) Tj ET")
    assert math.isclose(a.width, (6.67 * 2 + 2.78 + 6 + 3) / 2) and math.isclose(c.x, a.width) and a.height == 5
    t = show(b"BT /F1 10 Tf 14 TL 1 0 0 1 5 100 Tm (A) ' [(A) -100 (A)] TJ 0 -20 TD (A) Tj T* (A) Tj ET")
    assert [(round(r.x, 2), r.y) for r in t] == [(5, 86), (11.67, 86), (19.34, 86), (5, 66), (5, 46)]


def test_text_scaled_by_matrices():
    one = show(b"q 12 0 0 12 72 700 cm BT /F1 1 Tf (A) Tj ET Q")[0]
    two = show(b"BT /F1 1 Tf 12 0 0 12 72 700 Tm (A) Tj ET")[0]
    assert one.height == two.height == 12 and math.isclose(one.width, two.width)
    turned = show(b"BT /F1 10 Tf 0 1 -1 0 50 50 Tm (A) Tj ET")[0]
    assert math.isclose(turned.angle, math.pi / 2)


def test_no_font_shows_nothing_and_does_not_move():
    assert [r.x for r in show(b"BT /F9 10 Tf (A) Tj /F1 10 Tf (A) Tj ET")] == [0]


def test_operations_keep_images_and_drop_overflow():
    data = b"BI /W 1 ID \x00EI\xff EI Q " + b"1 " * 65 + b"m 2 w ] S"
    ops = content.operations(data)
    assert [o.op for o in ops] == ["BI", "Q", "m", "w", "S"] and ops[0].inline_image == b"BI /W 1 ID \x00EI\xff EI" and ops[2].operands == []


def test_glyph_invariants():
    for r in show(b"BT /F1 11 Tf 3 Ts 60 730 Td (some text here) Tj ET"):
        assert list(r.starts) == list(range(len(r.text))) and r.xs[0] == r.x and all(r.ys == r.y) and math.isclose(r.xs[-1] + r.widths[-1], r.x + r.width)


@pytest.mark.parametrize("value, shown", [(1, "1"), (0.5, "0.5"), (-0.0, "0"), (1e21, "1000000000000000000000"), (1.23456789, "1.234568"), (float("nan"), "0"), (-1e-9, "0"), (100.0, "100")])
def test_format_number(value, shown):
    assert format_number(value) == shown


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=20) | st.text("abc #/()", min_size=1, max_size=5).map(Name), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc ", min_size=1, max_size=4), x, max_size=4), max_leaves=15))
@settings(max_examples=80, deadline=None)
def test_values_round_trip(value):
    assert Scanner(format_value(value)).value() == value


def test_hex_and_subsections():
    assert format_hex(b"\xab\x01") == b"<AB01>" and subsections([5, 1, 2, 3, 7, 6]) == [(1, 3), (5, 3)]


@pytest.mark.parametrize("form", ["classic", "nested", "objstm"])
@pytest.mark.parametrize("incremental", [True, False])
def test_edits(form, incremental):
    lines = ["one", "two", "three", "four", "five"]
    data = b.document("\n".join(lines), form=form, one_page_a_line=True)
    steps = [{"op": "remove", "pages": [0, 0, 9, -1]}, {"op": "move", "page": 0, "at": 2}, {"op": "insert_blank", "at": 99}, {"op": "insert_copy", "at": 0, "page": 1}, {"op": "rotate", "page": 0, "degrees": -100}]
    out = edits.apply_edits(data, steps, incremental, compress=True)
    assert texts(out) == ["four", "three", "four", "two", "five", ""]
    pdf = PdfFile(out)
    assert not pdf.repairs and out.startswith(data) == incremental
    assert quarter_turn(pdf.pages()[0].inherited["Rotate"]) == 270
    tree = pdf.dict(pdf.catalog["Pages"])
    assert tree["Count"] == 6
    for p in pdf.pages():
        assert p.dict["Parent"] in [r for n in pdf.numbers() for r in [Ref(n, 0)] if isinstance(pdf.get(n), dict) and Ref(p.num, 0) in (pdf.get(n).get("Kids") or [])]


def test_box_scales_content():
    out = edits.apply_edits(b.document("hello"), [{"op": "set_box", "page": 0, "key": "MediaBox", "box": [0, 0, 306, 396], "scale_content": True}])
    pdf = PdfFile(out)
    p = pdf.pages()[0]
    r = content.runs(content.operations(pdf.contents(p)), content.PageFonts(pdf, p, {}))[0]
    assert (r.x, r.y, r.height) == (36, 360, 5)


def test_new_file_and_full_rewrite():
    w = Writer()
    page, tree = w.alloc(), w.alloc()
    w.set(page, {"Type": Name("Page"), "Parent": tree})
    w.set(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    w.overrides["Root"] = w.add({"Type": Name("Catalog"), "Pages": tree})
    w.add(Stream({}, b"x" * 500))
    pdf = PdfFile(w.save(compress=True))
    assert len(pdf.pages()) == 1 and zlib.decompress(pdf.get(4).raw) == b"x" * 500 and not pdf.repairs
    with pytest.raises(ValueError):
        Writer().save()


def test_labels_and_outline():
    pdf = PdfFile(b.document("a\nb\nc", one_page_a_line=True, labels=b"2 << /S /D /St 5 >> 0 << /S /r >>", titles=["One", "Zwei ü"]))
    assert pdf.page_labels() == [(0, "r", None, 1), (2, "D", None, 5)]
    assert list(pdf.outline(pdf.pages())) == [((0,), "One", 0), ((1,), "Zwei ü", 1)]


def test_display_matrix():
    m, w, h = matrix.display((10, 20, 210, 320), 90, 2)
    assert (w, h) == (600, 400) and matrix.apply(m, 10, 20) == (0, 0)
    m, w, h = matrix.display((0, 0, 612, 792), 0)
    assert matrix.apply(m, 72, 700) == (72, 92)
    assert matrix.inverse((1, 2, 2, 4, 0, 0)) is None
    for turn in (0, 90, 180, 270):
        m, w, h = matrix.display((5, 6, 105, 206), turn, 1.5)
        corners = [matrix.apply(m, x, y) for x in (5, 105) for y in (6, 206)]
        assert min(c[0] for c in corners) == 0 == min(c[1] for c in corners) and max(c[0] for c in corners) == w and max(c[1] for c in corners) == h
