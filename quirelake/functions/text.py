"""Scalar formats and string functions, all in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def format_number(x: Column) -> Column:
    """At most six decimals, no exponent, no minus zero; what isn't finite is 0."""
    x = x.cast("double")
    whole = F.format_string("%.0f", x)
    part = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""), r"^-0$", "0")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, F.lit("0")).when(x == 0, F.lit("0")).when(x == F.rint(x), whole).otherwise(part)


def roman(n: Column) -> Column:
    """Lower-case Roman numerals; empty below 1."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in _ROMAN])
    step = lambda acc, t: F.struct(
        F.concat(acc["out"], F.repeat(t["s"], F.floor(acc["rest"] / t["v"]).cast("int"))).alias("out"), F.pmod(acc["rest"], t["v"]).alias("rest")
    )
    start = F.struct(F.lit("").alias("out"), F.greatest(n, F.lit(0)).cast("int").alias("rest"))
    return F.aggregate(table, start, step, lambda acc: acc["out"])


def letters(n: Column, upper: bool = True) -> Column:
    """A to Z, AA to AZ and on (bijective base 26); empty below 1."""
    step = lambda acc, _: F.struct(
        F.when(acc["rest"] > 0, F.concat(F.chr((F.pmod(acc["rest"] - 1, F.lit(26)) + (65 if upper else 97)).cast("int")), acc["out"])).otherwise(acc["out"]).alias("out"),
        F.when(acc["rest"] > 0, F.floor((acc["rest"] - 1) / 26)).otherwise(F.lit(0)).cast("long").alias("rest"),
    )
    start = F.struct(F.lit("").alias("out"), F.greatest(n, F.lit(0)).cast("long").alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])


def page_label(index: Column, first: Column, style: Column, prefix: Column, start: Column) -> Column:
    """The printed label of a page under its rule; without a rule, the page number.

    A rule without a style prints its prefix alone, an unknown style counts as decimal.
    """
    n = (index - first + start).cast("int")
    body = (
        F.when(style.isNull(), F.lit(""))
        .when(style == "R", F.upper(roman(n)))
        .when(style == "r", roman(n))
        .when(style == "A", letters(n))
        .when(style == "a", letters(n, upper=False))
        .otherwise(n.cast("string"))
    )
    return F.when(first.isNull(), (index + 1).cast("string")).otherwise(F.concat(F.coalesce(prefix, F.lit("")), body))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def base_name(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)\.pdf$", "")


def saved_name(s: Column, incremental: bool) -> Column:
    """What a saved file is called: ``-appended`` or ``-rewritten`` before the ending."""
    return F.concat(base_name(s), F.lit("-appended.pdf" if incremental else "-rewritten.pdf"))


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def latin1_bytes(s: Column) -> Column:
    return F.encode(s, "ISO-8859-1")


def pdf_text(data: Column) -> Column:
    """A text string: UTF-16BE after a byte order mark, otherwise Latin-1."""
    marked = F.hex(F.substring(data, 1, 2)) == "FEFF"
    return F.when(marked, F.decode(F.substring(data, F.lit(3), F.octet_length(data)), "UTF-16BE")).otherwise(latin1(data))


def hex_string(data: Column) -> Column:
    return F.concat(F.lit("<"), F.hex(data), F.lit(">"))


def ascii_hex_decode(data: Column) -> Column:
    """Bytes of hex digits up to ``>``; other characters are skipped and an odd digit is padded."""
    digits = F.regexp_replace(F.substring_index(latin1(data), ">", 1), "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


#: What filters are called in a list of facts, and how objects are stored.
FILTER_WORDS = {"FlateDecode": "Flate", "LZWDecode": "LZW", "ASCIIHexDecode": "Hex text", "ASCII85Decode": "Base 85 text", "RunLengthDecode": "Run length", "DCTDecode": "JPEG", "JPXDecode": "JPEG 2000", "CCITTFaxDecode": "Fax", "JBIG2Decode": "JBIG2"}
STORED_WORDS = {0: "free", 1: "in the file", 2: "in an object stream"}


def worded(value: Column, words: dict) -> Column:
    """A value's word, or the value itself."""
    pairs = [x for k, v in words.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value.cast("string"))


def is_image_filter(value: Column) -> Column:
    return value.isin("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode")
