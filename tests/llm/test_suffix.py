"""Repeated passages by sorted suffixes against brute force where many repeats of one head differ."""

import random
from collections import defaultdict

import pytest

from quirelake.llm import suffix_dedup


def documents(seed):
    """Cuts of a few passages with words changed, so that partners of one suffix match it far to one side only."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(90)] for _ in range(2)]
    out = []
    for i in range(70):
        t = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            cut = p[a : a + rng.randint(10, 50)]
            if rng.random() < 0.6:
                cut[rng.randrange(len(cut))] = rng.choice(words)
            t += cut + [rng.choice(words) for _ in range(rng.randint(0, 4))]
        out.append((i, " ".join(t)))
    return out + [(70, out[3][1]), (3, out[3][1]), (5, out[9][1]), (71, None), (72, ""), (None, out[3][1])]


def brute(rows, least):
    """Spans by id, and the windows that lie in each document."""
    at, texts = defaultdict(int), sorted({(i, t) for i, t in rows if i is not None and t})
    where = defaultdict(set)
    for i, t in [(i, t) for i, t in rows if i is not None and t]:
        w = t.split()
        for k in range(len(w) - least + 1):
            at[tuple(w[k : k + least])] += 1
            where[tuple(w[k : k + least])].add(i)
    spans = set()
    for i, t in texts:
        w, own = t.split(), []
        for k in range(len(w) - least + 1):
            if at[tuple(w[k : k + least])] > 1:
                if own and k <= own[-1][1]:
                    own[-1][1] = k + least
                else:
                    own.append([k, k + least])
        spans |= {(i, a, b) for a, b in own}
    return spans, where


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_against_all_windows(spark, seed):
    rows, least = documents(seed), 18
    want, where = brute(rows, least)
    got = suffix_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == want and len(want) > 30
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append((t or "").split())
    for r in got:  # the document named first shares a window of the span, unless it is the document itself
        windows = {tuple(w[k : k + least]) for w in texts[r.doc_id] for k in range(r.start_word, r.end_word - least + 1)}
        assert r.first_id <= r.doc_id and (r.first_id == r.doc_id or any(r.first_id in where[x] for x in windows))
