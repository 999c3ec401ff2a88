"""Operators of quirelake.llm against brute force, with odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirelake.llm import byte_bpe, language_id, licenses, media, ngram_join, packing, substring_dedup, suffix_dedup, url_rules, vectors
from quirelake.llm.common import Words, components
from quirelake.llm.recompression import Symbols, open_windows

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, other int"


def corpus(seed=3, n=60, vocabulary=400):
    """Documents with copies, edited copies, shared passages, runs of one word and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(1, 160))]
        kind = i % 6
        if kind == 1 and texts:
            t = texts[rng.randrange(len(texts))].split()
        elif kind == 2 and texts:
            t = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind == 3:
            a = rng.randint(0, 20)
            t[len(t) // 2 : len(t) // 2] = passage[a : a + rng.randint(40, 60)]
        elif kind == 4 and i % 4:
            t += [words[0]] * rng.randint(5, 40)
        texts.append("\n ".join(t) if i % 5 else " ".join(t).upper() + "\t")
    return [*enumerate(texts), (n, ""), (n + 1, None), (n + 2, " \n\x0b"), (n + 3, "one two"), (n + 4, "one  TWO"), (n + 5, "x"), (n + 6, "x" * 5000), (n + 7, "a " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in corpus()], DOCS)


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def split(text):
    return WORD.findall((text or "").encode())


@given(st.lists(st.text("aBé \t\n\x0b\xa0", max_size=30) | st.none(), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words(texts):
    w = Words(pa.array(texts, pa.string()), lower=True)
    got = [[bytes(w.raw[a:b]).lower() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])]
    want = [[x.lower() for x in split(t)] for t in texts]
    assert got == want
    flat = [x for t in want for x in t]
    by = defaultdict(set)
    for x, h in zip(flat, w.hash.tolist()):
        by[x].add(h)
    assert all(len(h) == 1 for h in by.values()) and len({min(h) for h in by.values()}) == len(by)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    g = Groups()
    for a, b in edges:
        if a is not None and a != b:
            g.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: g.find(x) for x in g}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 media ------------------------------------------------------------------


def _images():
    rng = np.random.default_rng(5)
    plain = [media._box(rng.normal(128, 90, (72, 72)), 1) for _ in range(8)]
    a = plain[0]
    made = [(i, media.write_pgm(x)) for i, x in enumerate(plain)]
    made += [(20, media.write_pgm(a)), (21, media.write_pgm(a[6:66, 8:70])), (22, media.write_pgm(a * 1.15 + 8)), (23, media.write_pgm(np.rot90(a))), (24, media.write_pgm(a + rng.normal(0, 5, a.shape)))]
    return made + [(30, None), (31, b""), (32, b"GIF89a"), (33, media.write_pgm(np.full((40, 40), 9))), (34, media.write_pgm(np.full((40, 40), 9))), (35, media.write_pgm(plain[1])[:50])]


def test_media_copies(spark):
    out = media.near_copies(spark.createDataFrame(_images(), "image_id long, image binary"))
    got = {r.image_id: r.component_id for r in out.collect()}
    assert {k for k, v in got.items() if v == 0} == {0, 20, 21, 22, 23, 24}
    assert all(got[i] == i for i in (*range(1, 8), 30, 31, 32, 35)) and got[34] == 33
    assert media.near_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_media_formats():
    grey = np.arange(12, dtype=float).reshape(3, 4)
    assert (media.read_pnm(media.write_pgm(grey)) == grey).all()
    assert media.read_pnm(b"P6 # c\n1 1 255 \x03\x06\x09").tolist() == [[6.0]]


# -- 2 suffix arrays ------------------------------------------------------------


@pytest.mark.parametrize("least", [50, 20])
def test_suffix_spans(spark, docs, least):
    ws = {i: split(t) for i, t in corpus()}
    n = Counter(tuple(w[k : k + least]) for w in ws.values() for k in range(len(w) - least + 1))
    want = set()
    for i, w in ws.items():
        cover = [False] * (len(w) + 1)
        at = [k for k in range(len(w) - least + 1) if n[tuple(w[k : k + least])] > 1]
        spans = []
        for k in at:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + least
            else:
                spans.append([k, k + least])
        want |= {(i, a, b) for a, b in spans}
        assert not any(cover)
    got = suffix_dedup.spans(docs, min_words=least)
    assert {(r.doc_id, r.start_word, r.end_word) for r in got.collect()} == want
    assert suffix_dedup.spans(docs.limit(0)).count() == 0


# -- 3 URL rules ------------------------------------------------------------------

RULES = [url_rules.Rule("block", "net", "/"), url_rules.Rule("allow", "example.net", "/en/"), url_rules.Rule("block", "example.com", "/de/"), url_rules.Rule("allow", "org", "/fr/")]


def test_url_rules(spark):
    urls = [(1, "http://A.Example.NET/en/1?x=1"), (2, "https://x.net"), (3, "https://net/"), (4, "http://notexample.com/de/"), (5, "http://www.example.com/de/3#t"), (6, None), (7, "nothing"), (8, "ftp://b.org/fr/"), (9, "http://b.org/frx"), (10, ""), (11, "http://ÄB.org/fr/\ny?z"), (12, "a://b://c.net/")]
    bad = [(f"http://spam{i % 3}.win/en/{i}", True) for i in range(60)] + [(f"http://good{i}.com/en/{i}", False) for i in range(60)] + [("http://x.com/", None)]
    mined = url_rules.mine(spark.createDataFrame(bad, "url string, bad boolean"))
    assert mined.count() and all(r.confidence >= 0.5 for r in mined.collect())
    df = spark.createDataFrame([*urls, (13, "http://spam1.win/en/9")], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_rules.judge(df, RULES, mined).collect()}
    assert [got[1].host, got[1].path, got[1].rule, got[1].verdict] == ["a.example.net", "/en/1", "example.net/en/", "allow"]
    assert [got[i].rule for i in range(2, 13)] == [None, "net/", None, "example.com/de/", None, None, "org/fr/", None, None, "org/fr/", None]
    assert got[11].host == "Äb.org" and got[11].path == "/fr/\ny" and (got[6].host, got[6].path) == ("", "") and got[12].host == "b:"
    assert got[13].verdict == "block" and got[13].mined_rule and got[2].verdict == "allow"
    none = url_rules.mine(spark.createDataFrame([], "url string, bad boolean"))
    assert url_rules.judge(df, [], none).where("verdict = 'allow' and rule is null").count() == 13


def test_mined_rules_match_by_index(spark):
    rng = random.Random(2)
    data = [(f"http://{rng.choice('abc')}.{rng.choice('xy')}.com/{rng.choice(['p', 'q'])}?{rng.choice(['k', 'l'])}=1", rng.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame(data, "url string, bad boolean")
    mined = url_rules.mine(df, min_support=0.01, min_confidence=0.55)
    rules = [(set(r["items"]), r.confidence) for r in mined.collect()]
    assert rules and not any(a < b and x >= y for a, x in rules for b, y in rules)
    for r in url_rules.judge(df.withColumn("t", url_rules.tokens(F.col("url"))), [], mined).collect():
        hits = [c for items, c in rules if items <= set(r.t)]
        assert (r.verdict == "block") == bool(hits) and (not hits or r.mined_confidence == max(hits))


# -- 4 vectors --------------------------------------------------------------------


@pytest.mark.parametrize("block", [16, 2048])
def test_vector_join(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 24))
    x = np.vstack([centres[rng.integers(0, 12, 150)] + rng.normal(0, 0.32, (150, 24)), rng.normal(0, 1, (60, 24))])
    x[40] = x[41] = x[7]
    x[50] = 3 * x[8]
    data = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (907, [float("inf")] * 24)]
    u = np.array([v for _, v in data])
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    g = Groups()
    for a, b in zip(*np.nonzero(hit)):
        g.join(int(a), int(b))
    out = vectors.near_duplicates(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)), block=block)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert hit.sum() > 100 and len(got) == len(data) + len(odd)
    assert all(got[i] == (int(hit[i].sum()), g.find(i), g.find(i) == i) for i, _ in data)
    assert got[904] == (1, 904, True) and got[905] == (1, 904, False) and all(got[k] == (0, k, True) for k in (900, 901, 902, 903, 906, 907))
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- 5 licenses -------------------------------------------------------------------


def test_license_scan(spark):
    t = licenses.TEMPLATES
    changed = t["mit"].replace("free of charge", "without any charge at all").replace("sublicense, ", "")
    texts = [(1, "x y " + t["mit-line"] + " tail"), (2, t["apache-2.0-header"].upper()), (3, "a b " * 50 + changed + " c"), (4, "the license of version 2 is free"), (5, None), (6, ""), (7, (t["cc-by-nc-4.0-line"] + "\n") * 3), (8, "é " * 40 + t["gpl-3.0-line"])]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), min_coverage=0.8).collect()
    by = Counter((r.doc_id, r.license) for r in got)
    assert by == {(1, "mit-line"): 1, (2, "apache-2.0-header"): 1, (2, "apache-2.0-line"): 1, (3, "mit"): 1, (7, "cc-by-nc-4.0-line"): 3, (8, "gpl-3.0-line"): 1}
    source = dict(texts)
    span = {(r.doc_id, r.license): source[r.doc_id][r.start_char : r.end_char] for r in got}
    assert span[1, "mit-line"] == "Released under the MIT License" and span[8, "gpl-3.0-line"].startswith("This work") and span[3, "mit"].startswith("Permission")
    assert next(r.coverage for r in got if r.doc_id == 3) < 1
    with pytest.raises(Exception, match="fewer than"):
        licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), templates={"short": "two words"}).collect()


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(0)
    for window in (1, 2, 3, 7, 26):
        h = rng.integers(0, 50, 300).astype(np.uint64)
        at = set(licenses.winnow(h, np.ones(300, bool), window).tolist())
        for i in range(300 - window + 1):
            part = h[i : i + window]
            assert i + window - 1 - int(part[::-1].argmin()) in at


# -- 6 byte-level BPE ---------------------------------------------------------------

ODD = ["", None, " ", "\n\n  a", "it's  we'LL 's 'x 1234 ½²", "a b \x85\x85 c\x1cd　 e", "日本語 текст 🙂🙂 e\u0301", "x" * 300, "  " * 90 + "y", "<|endoftext|>", "a\r\n\t b" * 40, "'re" * 60]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(32768, 512), (40, 12), (64, 32)])
def test_byte_bpe(spark, reference, chunk, overlap):
    texts = ODD + [t for _, t in corpus()[:30]]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int").withColumn("row", F.lit("clash"))
    coded = byte_bpe.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap)
    assert set(coded.columns) == {"doc_id", "row", "ids"}
    got = {r.doc_id: r["ids"] for r in coded.collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(coded, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_byte_bpe_edges(spark):
    df = spark.createDataFrame([(1, None), (2, [99999999])], "doc_id long, ids array<int>")
    assert byte_bpe.decode(df.where("doc_id = 1"), RANKS).first().decoded == b""
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(df, RANKS).collect()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


@given(st.lists(st.text("aB'sré \n\t\x85\xa0　1½", max_size=60), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_byte_bpe_columns(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(test_byte_bpe_columns, "enc") else None
    if ranks:
        test_byte_bpe_columns.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = byte_bpe.encoder(RANKS, P.PATTERN)
    assert byte_bpe.encode_column(pa.array(texts, pa.string()), e).to_pylist() == [test_byte_bpe_columns.enc.encode_ordinary(t) for t in texts]


# -- 7 packing ----------------------------------------------------------------------


_PIECES = st.lists(st.text("aBéßΣ'sµ漢 \n\t\x85\xa0ﬁ1½-_!\u0301İ<|>", max_size=50) | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "<|EndOfText|>"]), max_size=4).map("".join)


@given(st.lists(_PIECES, min_size=1, max_size=5))
@settings(max_examples=120, deadline=None)
def test_word_bpe(texts):
    if not hasattr(test_word_bpe, "tok"):
        test_word_bpe.tok = Tokenizer.from_file(WORDS)
    got = packing.word_bpe(WORDS)(pa.array(texts, pa.string())).to_pylist()
    assert got == [test_word_bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark, docs):
    tok = Tokenizer.from_file(WORDS)
    parts = packing.text_pieces(docs, WORDS, capacity=64)
    other = packing.pieces(packing.tokenize(docs.select("doc_id", "text"), WORDS), capacity=64).drop("ids")
    assert sorted(parts.collect()) == sorted(other.collect())
    out = [r.asDict() for r in packing.pack(parts, capacity=64).collect()]
    by, bins = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["key"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in corpus():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, a, min(64, len(ids) - a), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * sum(r["length"] for r in out) / 64 + 2
    assert packing.pack(parts.limit(0), capacity=64).count() == 0


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=25))
@settings(max_examples=40, deadline=None)
def test_plan_covers_the_histogram(histogram):
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    made = packing.plan(sizes, counts, 100)
    total = sum((c * t for c, t in made), np.zeros(len(sizes), np.int64))
    assert (total == counts).all() and all((c * sizes).sum() <= 100 for c, _ in made)


# -- 8 n-gram join -------------------------------------------------------------------


def test_ngram_join(spark, docs):
    sets = {}
    for i, t in corpus():
        w = split(t and t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    g = Groups()
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            g.join(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert got == {i: (len(s), g.find(i)) for i, s in sets.items()} and len({g.find(i) for i in sets}) < len(sets)
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_ngram_join_of_chains_and_templates(spark):
    """Chains of small edits, and texts made of few common passages, are what steps 2 and 3 are for."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    chain = [[rng.choice(words) for _ in range(60)]]
    for _ in range(30):
        t = list(chain[-1])
        t[rng.randrange(60)] = rng.choice(words)
        chain.append(t)
    parts = [[rng.choice(words) for _ in range(12)] for _ in range(7)]
    mixed = [sum(rng.sample(parts, 6), []) for _ in range(60)]
    data = [(i, " ".join(t)) for i, t in enumerate(rng.sample(chain + mixed, len(chain + mixed)))] + [(None, "a b c d e f"), (3, "a b c d e f")]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in data[:-2]}
    g = Groups()
    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            g.join(a, b)
    out = ngram_join.join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id is not None} == {(i, g.find(i)) for i in sets}
    assert [r.component_id for r in out if r.doc_id is None] == [None]


# -- 9 substring dedup ------------------------------------------------------------------


def removed(texts, window):
    ws, first = {i: split(t) for i, t in texts}, {}
    for i in sorted(ws):
        for k in range(len(ws[i]) - window + 1):
            first.setdefault(tuple(ws[i][k : k + window]), i)
    out = {}
    for i, w in ws.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("window, vocabulary", [(13, 400), (5, 12), (13, 3)])
def test_substring_dedup(spark, window, vocabulary):
    texts = corpus(seed=vocabulary, vocabulary=vocabulary)
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, kept int").withColumn("other", F.lit(2)).withColumn("id", F.lit(3))
    out = substring_dedup.dedup(df, window=window)
    assert set(out.columns) == {"doc_id", "text", "other", "id", "n_words", "n_removed", "kept"}
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()}
    assert got == removed(texts, window)


def test_substring_dedup_edges(spark):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20), (2, 20)]
    assert substring_dedup.dedup(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 3), min_size=13, max_size=60), st.integers(0, 12), st.integers(0, 12))
@settings(max_examples=120, deadline=None)
def test_equal_windows_hold_equal_symbols(words, a, b):
    """Whatever stands around a window, the symbols whose context it contains are the same."""
    vocabulary = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    core = np.array(words[:13])
    rng = np.random.default_rng(a * 13 + b)
    found = []
    for before in (a, b):
        seq = np.concatenate((rng.integers(0, 4, before), core, rng.integers(0, 4, 12 - before)))
        s = Symbols(vocabulary[seq], np.array([0, len(seq)]), 2)
        inside = (s.seen_from >= before) & (s.seen_to <= before + 13)
        found.append(sorted(zip((s.start[inside] - before).tolist(), s.name[inside].tolist())))
        assert open_windows(s, ~inside, 13, len(seq))[before] == (not inside.any())
    assert found[0] == found[1]


# -- 10 language ID -----------------------------------------------------------------------


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("clash"))
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(df.where(~held))
    out = language_id.predict(df, model)
    assert set(out.columns) == {*df.columns, "lang_pred"}
    test = out.where(held).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test) and all(0 <= r.score <= 1 for r in test)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %&!"), (4, "é"), (5, "x" * 200000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] in model.labels and got[5][0] in model.labels
    none = language_id.fit(df.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"} and language_id.predict(df.limit(0), model).count() == 0


def test_language_id_counts_by_hand(spark):
    """The posterior of naive Bayes over the same buckets, computed one n-gram at a time."""
    data = [("aab", "x"), ("ab a", "x"), ("bbc", "y")]
    model = language_id.fit(spark.createDataFrame(data, "text string, lang string"))
    counts = {k: Counter() for k in "xy"}
    for t, k in data:
        grams, _ = language_id._grams(pa.array([t]))
        counts[k].update(grams[grams >= 0].tolist())
    grams, _ = language_id._grams(pa.array(["abc"]))
    logs = []
    for k, prior in (("x", 2 / 3), ("y", 1 / 3)):
        total = sum(counts[k].values()) + language_id.ALPHA * (1 << language_id.BITS)
        logs.append(np.log(prior) + sum(np.log((counts[k][g] + language_id.ALPHA) / total) for g in grams[grams >= 0].tolist()))
    want = 1 / (1 + np.exp(min(logs) - max(logs)))
    got = language_id.predict(spark.createDataFrame([("abc",)], "text string"), model).first()
    assert got.lang_pred == "xy"[int(np.argmax(logs))] and abs(got.score - want) < 1e-4
