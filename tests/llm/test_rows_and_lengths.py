"""Repeated ids with different texts, and texts far longer than a block."""

import random
import subprocess
import sys

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import common, language_id, ngram_join, substring_dedup
from quirelake.llm.common import Words

WORDS = [f"w{i}" for i in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_ids_with_two_texts(spark):
    """(5, B) links with (9, B with one word changed) although (5, A) is a copy of (2, A)."""
    rng = random.Random(5)
    a, b = text(rng, 80), text(rng, 80)
    near = " ".join([*b.split()[:-1], "zzz"])
    rows = [(2, a), (5, a), (5, b), (9, near), (5, b), (4, None), (4, ""), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.component_id, r.kept) for r in ngram_join.classes(df).collect() if r.id is not None and r.n_shingles)
    assert [x[:2] for x in got] == [(2, 2), (5, 2), (5, 2), (5, 2), (9, 2)] and sum(x[2] for x in got) == 2
    kept = corpus_pipeline.near_copies(spark, df, "").collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == sorted([(2, a), (5, b), (4, ""), (4, ""), (0, b)])
    both = spark.createDataFrame([(5, a), (5, b), (5, near)], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near_copies(spark, both, "").collect()) in (sorted([a, b]), sorted([a, near]))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(common, "BLOCK_WORDS", 17)
    monkeypatch.setattr(common, "BLOCK_BYTES", 23)


def test_blocks_change_nothing(request):
    rng = random.Random(6)
    column = pa.array([text(rng, 200), None, "x" * 90 + " y", "", text(rng, 3), " ".join(["r"] * 70)])

    def told():
        w = Words(column)
        spans = set()
        for a, b, s, told in substring_dedup._symbols(w, 2, 13):
            spans |= {(int(x) + a, int(y) + a, int(n)) for x, y, n in zip(s.start[told], s.end[told], s.name[told])}
        return w.hash.tolist(), w.windows(5)[0].tolist(), w.whole(), spans

    before = told()
    request.getfixturevalue("small_blocks")
    after = told()
    assert before[:3] == after[:3] and before[3] <= after[3]


LONG = """
import resource, random, sys
import numpy as np, pyarrow as pa
from quirelake.llm import language_id, ngram_join, substring_dedup, packing, suffix_dedup, licenses
from quirelake.llm.common import Words
from quirelake.llm.recompression import open_windows
rng = np.random.default_rng(1)
words = np.array([f"w{i}" for i in range(100000)], object)
column = pa.array([" ".join(words[rng.integers(0, len(words), 3_000_000)])])
size = column.nbytes
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss << 10
batch = pa.RecordBatch.from_arrays([column], ["text"])
language_id._grams(pa.array(["warm up"]))
start = peak()
def run8():
    return len(ngram_join.shingle_sets(column)[0])
def run9():
    w = Words(column)
    n = 0
    for lo, hi, s, told in substring_dedup._symbols(w, 2, 13):
        n += int(open_windows(s, ~told, 13, hi - lo).sum())
    return len(substring_dedup._kept(w, np.zeros(len(w.hash), bool))[0].as_buffer())
def run10():
    return sum(int((language_id._grams(t)[0] >= 0).sum()) for _, t in language_id._pieces(batch, 0))
out = {"8": run8, "9": run9, "10": run10}[sys.argv[1]]()
print(out, size, peak() - start)
"""


@pytest.mark.parametrize("which", ["8", "9", "10"])
def test_memory_of_a_long_text(which):
    """A text of 20 MB needs a bounded multiple of itself in one worker."""
    out = subprocess.run([sys.executable, "-c", LONG, which], capture_output=True, text=True, check=True, timeout=300)
    value, size, grown = map(int, out.stdout.split())
    assert size > 19 << 20 and grown < 11 * size, (size, grown)
    assert which != "9" or value == size - 8 or abs(value - size) < 16


def test_language_of_long_texts(spark):
    """Pieces of a long text add up: its label is that of its parts, and nothing of it is left out."""
    rows = [(1, "der hund und die katze " * 9000, "de"), (2, "the dog and the cat " * 9000, "en"), (3, "le chien et le chat " * 20000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert [r.p for r in language_id.predict(df, model, lang="p").orderBy("doc_id").collect()] == ["de", "en", "fr"]
    late = spark.createDataFrame([("xyz " * 20 + "the dog and the cat " * 20000,), ("der hund und die katze " * 4000 + "the dog and the cat " * 20000,)], "text string")
    assert [r.p for r in language_id.predict(late, model, lang="p").collect()] == ["en", "en"]
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 300_000, "d"])], ["text"])
    seen = [(int(r), len(x)) for rows, texts in language_id._pieces(batch, 0) for r, x in zip(rows, texts.to_pylist())]
    assert sorted(np.unique([r for r, _ in seen])) == [0, 1, 2, 3] and sum(n for r, n in seen if r == 2) == 300_000


def test_rows_with_aggregates_of_their_key(spark):
    from pyspark.sql import functions as F

    rows = [(i, i % 7 if i % 3 else 99, i * 31 % 50) for i in range(900)] + [(901, None, 1), (902, 1000, 2)]
    want = {}
    for _, k, v in rows:
        low, n = want.get(k, (v, 0))
        want[k] = (min(low, v), n + 1)
    out = common.over_key(spark.createDataFrame(rows, "id long, k long, v long"), "k", "n > 1", low=F.min("v"), n=F.count("*")).collect()
    assert len(out) == 900 and all((r.low, r.n) == want[r.k] for r in out)
