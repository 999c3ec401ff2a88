"""Piece ids, byte spans and decoded texts against the sentencepiece library, with the model's own settings and with others."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from quirelake.llm import queries, sentencepieces
from quirelake.llm.common import SLICE_BYTES

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["hello world", "  lead", "trail  ", "a  b\t c\n\nd", "ｆｕｌｌ　ｗｉｄｔｈ", "Ａ̊ Å", "▁x ▁▁ y▁", "ﬁne ½ ㍿", "​﻿ a", "日本 😀 👍🏽", "", "   ", " ", "\x00a\x01", "é é́", "x" * 50, "<s> </s> <0x41>", "ﷺ ok", "a　　b", "▁", "\t"]


def texts():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\t", "\n", "é", "é", "ｱ", "ﾞ", "ﬁ", "漢", "😀", "▁", " ", "　", "½", "ﷺ", "1", ".", "the ", "of", "‍"]
    return TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)]


def changed(normalizer=(), trainer=(), pieces=None):
    """The model with other values of some fields."""
    put = lambda v, new: sentencepieces.message(list({**{n: (n, w, x) for n, w, x in sentencepieces.fields(v)}, **{n: (n, 2 if isinstance(x, bytes) else 0, x) for n, x in dict(new).items()}}.values()))
    with open(PATH, "rb") as f:
        parts = list(sentencepieces.fields(f.read()))
    new = {1: pieces or (), 2: trainer, 3: normalizer}
    kind = lambda v: dict((n, x) for n, _, x in sentencepieces.fields(v)).get(3, 1)
    return sentencepieces.message([(n, w, put(v, new[n]) if new.get(n) and (n != 1 or kind(v) == sentencepieces.BYTE) else v) for n, w, v in parts])


@pytest.fixture(scope="module")
def nfkc():
    """The library's compiled character map for NFKC."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return next(v for n, _, spec in sentencepieces.fields(proto) if n == 3 for m, _, v in sentencepieces.fields(spec) if m == 2)


def holds(proto, texts):
    own, library = sentencepieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    ids, bounds = sentencepieces.encode_column(pa.array(texts), own)
    for t, i, b in zip(texts, ids.to_pylist(), bounds.to_pylist()):
        want = library.encode(t, return_type="proto").pieces
        assert i == [p.id for p in want], t
        assert list(zip(b, b[1:])) == [(p.begin, p.end) for p in want], t


def test_settings_of_models(nfkc):
    holds(changed(), texts())
    for normalizer in ({4: 1}, {2: nfkc}, {2: nfkc, 4: 1}, {3: 0}, {5: 0}):
        holds(changed(normalizer), texts())
    holds(changed({2: nfkc, 4: 1}, {24: 1}), texts())  # space symbol behind
    holds(changed((), {35: 0}, {3: 1}), texts())  # no byte fallback: unknown pieces cover several characters


def test_character_map(nfkc):
    found = sentencepieces.char_map(nfkc)
    assert found["ﬁ".encode()] == b"fi" and found["A\u030a".encode()] == "\u00c5".encode() and found[b"\x01"] == b"" and sentencepieces.char_map(b"") == {}


def test_long_texts_in_blocks(monkeypatch):
    rng = random.Random(2)
    one = " ".join(rng.choice(["the", "of", "été", "x" * 30, "a  b", "1,2", "▁"]) for _ in range(3000))
    for texts_ in ([one], ["x" * 5000], [one.replace(" ", "\n")]):
        want = sentencepieces.encode_column(pa.array(texts_), sentencepieces.model(PATH))
        with monkeypatch.context() as m:
            m.setattr(sentencepieces, "SLICE_BYTES", 1000)
            assert sentencepieces.encode_column(pa.array(texts_), sentencepieces.model(PATH)) == want
    assert SLICE_BYTES >= 1000


def test_frame(spark):
    rows = [(1, "the end", "x"), (2, None, None), (2, "", "x"), (None, "été", "y"), (3, "the end", "x"), (4, "w" * 100_000, "z")]
    df = spark.createDataFrame(rows, "id int, text string, `ids.x` string")
    out = sentencepieces.encode(df, PATH)
    assert out.columns == ["id", "ids.x", "ids", "bounds"]
    got = {(r["id"], r["ids.x"]): r for r in out.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, t, x in rows:
        assert got[i, x]["ids"] == library.encode(t or "", add_bos=True, add_eos=True)
    assert got[2, None]["bounds"] == [0] and len(got[1, "x"]["bounds"]) == len(got[1, "x"]["ids"]) - 1
    back = {(r["id"], r["ids.x"]): r["text"] for r in sentencepieces.decode(out.drop("bounds"), PATH, out="text").collect()}
    assert back == {(i, x): t or "" for i, t, x in rows}
    pieces = sentencepieces.spans(out.where("id = 1")).orderBy("piece").collect()
    assert [(p.piece, "the end".encode()[p.begin : p.stop]) for p in pieces] == [(0, b"the"), (1, b" end")]
    assert sentencepieces.encode(df.limit(0), PATH).count() == 0
    null = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert sentencepieces.decode(null, PATH).first().decoded == ""


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in queries.op12_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
