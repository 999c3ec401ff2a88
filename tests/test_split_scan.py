"""Matches in byte ranges of any size against a scan of the whole file, byte by byte."""

import random

import pytest

from quirelake.fixtures import builder as b
from quirelake.operators import split_scan
from quirelake.sources.pdf import PdfCorpus


def whole(data, needle):
    out, depth, comment, i = [], 0, False, 0
    while i < len(data):
        c = data[i : i + 1]
        if comment:
            comment = c not in (b"\n", b"\r")
        if comment:
            i += 1
            continue
        if depth:
            i += 1 + (c == b"\\")
            depth += (c == b"(") - (c == b")")
            continue
        if c == b"(":
            depth = 1
        elif c == b"%":
            comment = True
        elif data.startswith(needle, i):
            out.append(i)
        i += 1
    return out


@pytest.mark.parametrize("split", [1, 2, 7, 64, 10_000])
def test_any_split(spark, split):
    rng = random.Random(1)
    files = [(f"f{i}", bytearray(b"".join(rng.choice([b"(", b"(", b")", b")", b"\\", b"%", b"\n", b"\r", b"obj", b"ob", b"j", b"x", b"\\\\", b"\xff"]) for _ in range(rng.randint(0, 150))))) for i in range(40)]
    files += [("deep", bytearray(b"(" * 50 + b"obj" + b")" * 50 + b"obj")), ("open", bytearray(b"obj(obj")), ("note", bytearray(b"%obj")), ("none", None)]
    df = spark.createDataFrame(files, "file_id string, content binary")
    got = {}
    for r in split_scan.find_outside(df, b"obj", split).collect():
        got.setdefault(r.file_id, []).append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {f: w for f, d in files if d and (w := whole(bytes(d), b"obj"))}


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_objects_are_those_of_the_index(spark, split):
    corpus = PdfCorpus(spark.createDataFrame([(f"f{i}", bytearray(b.document(t, "plain", one_page_a_line=True))) for i, t in enumerate(["a (b) 7 0 obj\nc \\ d", "x\ny\n1 0 obj", "% no comment"])], "file_id string, content binary"))
    want = sorted(map(tuple, corpus.xref_entries.where("type = 1").select("file_id", "obj_num", "gen", "offset").collect()))
    assert sorted(map(tuple, split_scan.find_objects(corpus.contents, split).collect())) == want and want


def test_needle(spark):
    df = spark.createDataFrame([], "file_id string, content binary")
    assert split_scan.find_outside(df, b"x").count() == 0
    with pytest.raises(ValueError):
        split_scan.find_outside(df, b"(x")
