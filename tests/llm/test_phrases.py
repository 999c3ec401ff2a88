"""Phrase mining against a plain enumeration."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quirelake.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) for (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    dropped = set()
    for g, c in candidates.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                inner = (g[0], *g[i : i + k])
                if 100 * c >= 80 * f[inner]:
                    dropped.add(inner)
    out = []
    for lang in n:
        found = []
        for g, a in candidates.items():
            if g[0] == lang and g not in dropped:
                score, k = min((2_000_000 * a // (f[g[: k + 1]] + f[(lang, *g[k + 1 :])]), k) for k in range(1, len(g) - 1))
                found.append((-score, -a, " ".join(g[1:]).encode(), f[g[: k + 1]], f[(lang, *g[k + 1 :])]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["new", "York", "city", "of", "the", "été", "a\x00b", "x-y", "in", "on", " "]
    rows = []
    for _ in range(250):
        parts = [rng.choice(["New York City", "in the city of", "once upon a time", "x"]) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "en", "fr", None, ""]), "".join(p + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\r\n", " "]) for p in parts)))
    return rows + rows[:60] + [("en", None), ("en", ""), ("de", " .,\n"), ("en", "Buy it now! " * 80), ("en", "ha ha ha ha ha " * 40), ("fr", "y" * 3000)]


@pytest.mark.parametrize("least, top", [(30, 2000), (5, 7), (1, 50)])
def test_against_brute_force(spark, least, top):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int")
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.mine(df, min_count=least, top=top).collect())
    assert got == brute(rows, least, top) and got


def test_full_bitmaps_and_small_slices_change_nothing(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "MAX_BITS", 1 << 15)
    bits = phrases._bitmap(spark.createDataFrame([("en", f"w{i}", 1) for i in range(5000)], "lang string, phrase string, n long"), 1).value
    assert len(bits) == 1 << 12
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "fr"]), pa.array(["a b a b a", "b a b", "a b"]), pa.array([2, 3, 1 << 40])], ["lang", "piece", "n"])

    def total():
        out = Counter()
        for lengths in ([1], [2], [3, 4]):
            for b in phrases._counter(lengths, 0, None)(iter([batch])):
                for r in b.to_pylist():
                    out[r["lang"], r["phrase"]] += r["n"]
        return out

    want = total()
    assert want["en", "a b"] == 2 * 2 + 3 and want["en", "b a b"] == 5 and want["fr", "a b"] == 1 << 40 and want["en", ""] == 19
    monkeypatch.setattr(phrases, "_SLICE", 4)
    assert total() == want
    del df


def test_bucket_spills(tmp_path):
    """More groups than the memory of a bucket holds."""
    parts = [pa.RecordBatch.from_arrays([pa.array(["en"] * 20_000), pa.array([f"phrase number {i % 150_000} of many words" for i in range(at, at + 20_000)]), pa.array([1] * 20_000)], ["lang", "phrase", "n"]) for at in range(0, 300_000, 20_000)]
    found = [b for b in phrases._bucket(2, "60MB")(iter(parts))]
    assert sum(b.num_rows for b in found) == 150_000 and {n for b in found for n in b.column("n").to_pylist()} == {2}
    assert list(phrases._bucket(2)(iter([]))) == []


def test_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.mine(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")).count() == 0
