"""The state told by joins and windows against the positions that parsing gives, over random operator sequences."""

import random

from pyspark.sql import functions as F

from quirelake.fixtures import builder as b
from quirelake.operators import content_state
from quirelake.sources.pdf import PdfCorpus


def content(rng, n):
    """Random operators: nested and unmatched brackets, matrices, moves and texts, some with operands that don't fit."""
    num = lambda: rng.choice(["0", "1", "2", "-3", "0.5", "10", "7.25"])
    nums = lambda k: " ".join(num() for _ in range(k))
    out = ["/F1 10 Tf", "BT"]
    for i in range(n):
        out.append(rng.choice([
            "q", "q", "Q", "Q", "BT", "ET", f"{rng.choice(['0.5', '2', '1', '-1'])} 0 {num()} {rng.choice(['1', '0.5'])} {nums(2)} cm", f"1 0 0 cm", f"{nums(6)} Tm", f"{nums(2)} Td", f"{nums(2)} TD", f"{num()} Td", "T*", f"{num()} TL", f"{num()} Ts",
            f"{num()} Tc", f"{num()} Tw", f"{rng.choice([50, 100, 200])} Tz", f"/F1 {rng.choice([8, 10, 12])} Tf", "(x) Tc", f"(t{i}) Tj", f"(u{i}) Tj", f"[{num()} (v{i}) 3] TJ", f"[{nums(2)}] TJ", "() Tj", f"(w{i}) '", f'{nums(2)} (z{i}) "', f"(z{i}) \"",
        ]))
    return "\n".join(out).encode()


def test_positions_and_matrices_equal_those_of_runs(spark):
    rng = random.Random(1)
    files = [(f"f{i}", bytearray(b.document("one page", "plain", content=lambda _, i=i: content(random.Random(i), rng.randint(5, 160))))) for i in range(25)]
    corpus = PdfCorpus(spark.createDataFrame(files, "file_id string, content binary"))
    runs = {}
    for r in corpus.text_runs.collect():
        runs.setdefault(r.file_id, {})[r.text] = r
    got = content_state.text_starts(corpus.content_ops).join(corpus.content_ops.select("file_id", "op_seq", F.to_json("operands").alias("o")), ["file_id", "op_seq"]).collect()
    seen, near = 0, lambda x, y: abs(x - y) <= 1e-6 * max(1, abs(x), abs(y))
    for s in got:
        found = [r for t, r in runs[s.file_id].items() if f"({t})" in s.o]
        if found:
            seen += 1
            (r,) = found
            assert near(s.x, r.x) and near(s.y, r.y) and s.font_size == r.font_size and s.font_name == r.font_name
            assert all(near(x, y) for x, y in zip(s.ctm, r.ctm))
    assert seen > 200


def test_brackets_of_any_depth(spark):
    deep = b"BT /F1 10 Tf ET " + b"q 1 0 0 1 1 0 cm " * 40 + b"BT (in) Tj ET " + b"Q " * 45 + b"BT (out) Tj ET q q BT (open) Tj ET"
    one = PdfCorpus(spark.createDataFrame([("f", bytearray(b.document("x", "plain", content=lambda _: deep)))], "file_id string, content binary"))
    got = [(r.depth, r.ctm.e, r.x) for r in content_state.text_starts(one.content_ops).orderBy("op_seq").collect()]
    assert got == [(40, 40.0, 40.0), (0, 0.0, 0.0), (2, 0.0, 0.0)]
    many = b"q BT /F1 10 Tf ET " + b"1 0 0 1 1 2 cm " * 100 + b"BT (x) Tj ET Q"
    one = PdfCorpus(spark.createDataFrame([("f", bytearray(b.document("x", "plain", content=lambda _: many)))], "file_id string, content binary"))
    assert [(r.x, r.y) for r in content_state.text_starts(one.content_ops).collect()] == [(100.0, 200.0)]


def test_no_operations(spark):
    none = PdfCorpus(spark.createDataFrame([], "file_id string, content binary"))
    assert content_state.states(none.content_ops).count() == 0
