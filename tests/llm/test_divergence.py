"""Source divergence against a plain enumeration, and the grouping of byte slices where hashes collide."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import common, divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    """Rows (lang, source, part, item, value, rank) for (lang, source, text)."""
    occurs, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        occurs[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)

        def chances(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: chances(occurs[lang, s]) for s in sources}
        q = chances(sum((occurs[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, far(p[s][t], q[t])) for t in kept if occurs[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["the", "The", "of", "été", "Été", "ÀB", "x1y", "a_b", "日本", "z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for _ in range(150):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "S2", "é", None])
        rows.append((lang, source, rng.choice(["", None, " ", "12 _"]) if rng.random() < 0.1 else rng.choice([" ", "\n", "\x00", "."]).join(rng.choices(words, [200 / (i + 1) for i in range(90)], k=rng.randint(1, 60)))))
    return rows + rows[:10] + [("de", "only", "ein wort"), ("de", "two", None), ("it", "one", "a a a"), ("en", "s1", "x" * 5000)]


@pytest.mark.parametrize("min_docs, top", [(3, 200), (1, 5), (8, 3)])
def test_against_brute_force(spark, min_docs, top):
    rows = corpus()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, term int")
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=min_docs, top=top).collect())
    assert got == brute(rows, min_docs, top)


def test_small_slices_and_few_pairs_at_once(spark, monkeypatch):
    rows = corpus()
    column = lambda i: pa.array([r[i] or "" for r in rows])
    batch = pa.RecordBatch.from_arrays([column(2), column(0), column(1)], ["text", "lang", "source"])

    def total():
        out = Counter()
        for b in divergence._counted(iter([batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]] += np.array([r["n"], r["docs"]])
        return {k: tuple(v) for k, v in out.items()}

    want = total()
    monkeypatch.setattr(divergence, "_SLICE", 500)
    assert total() == want
    cells = pa.array([[{"source": s, "n": n, "total": 100} for s, n in zip("abc", (3, 1, 7))], [{"source": s, "n": n, "total": 100} for s, n in zip("ab", (2, 2))]] * 3)
    csr = pa.RecordBatch.from_arrays([pa.array(["en", "fr"] * 3), cells], ["lang", "cells"])
    met = lambda: sorted(tuple(r.values()) for b in divergence._met(iter([csr])) for r in b.to_pylist())
    want = met()
    monkeypatch.setattr(divergence, "_PAIRS", 1)
    assert met() == want and len(want) == 8


def test_exact_shares():
    rng = random.Random(4)
    pairs = [(c, t) for t in (1, 7, 10**6, 9 * 10**14) for c in (1, t, max(1, t // 3), rng.randint(1, t))]
    got = divergence._share(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in pairs]


def test_slices_whose_hashes_collide():
    raw = np.frombuffer(b"aabbaacaab", np.uint8)
    start, end = np.array([0, 2, 4, 6, 7, 9]), np.array([2, 4, 6, 7, 9, 10])  # aa bb aa c aa b
    code, member = common.same_bytes(raw, start, end, np.zeros(6, np.uint64))
    assert [code[0] == code[i] for i in range(6)] == [True, False, True, False, True, False]
    assert len(set(code.tolist())) == 4 == len(member) and all(raw[start[m] : end[m]].tobytes() == raw[start[i] : end[i]].tobytes() for i, m in enumerate(member[code]))


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    one = spark.createDataFrame([(None, None, None)] * 2, "lang string, source string, text string")
    assert divergence.audit(one).count() == 0
