"""License notices with words changed, against an alignment of every document with every template."""

import random

import numpy as np
import pytest

from quirelake.llm import licenses

FILL = [f"word{i}" for i in range(300)]


def whole_alignment(text, template):
    """Most matched words of the best local alignment without a band: 2 for a match, -1 for the rest."""
    best, top = (0, 0), [(0, 0)] * (len(text) + 1)
    for word in template:
        row = [(0, 0)]
        for i, own in enumerate(text, 1):
            score, n = top[i - 1]
            cell = max((score + 2, n + 1) if own == word else (score - 1, n), (top[i][0] - 1, top[i][1]), (row[-1][0] - 1, row[-1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
        best, top = max(best, max(row)), row
    return best[1]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        k, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[k] = rng.choice(FILL)
        elif kind < 0.7:
            del words[k]
        else:
            words.insert(k, rng.choice(FILL))
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_against_whole_alignment(spark, seed):
    rng, rows, names = random.Random(seed), [], list(licenses.TEMPLATES)
    for i in range(60):
        words = [rng.choice(FILL) for _ in range(rng.randint(0, 30))]
        if i % 4:
            notice = licenses.TEMPLATES[names[i % len(names)]].split()
            words += edited(rng, notice, rng.randint(0, len(notice) // 12)) + [rng.choice(FILL) for _ in range(20)]
        rows.append((i, " ".join(words)))
    rows += [(60, None), (61, ""), (62, rows[1][1]), (62, rows[1][1])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    plain = lambda t: "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in t or "").split()
    want = set()
    for i, text in rows:
        for name, template in licenses.TEMPLATES.items():
            words = plain(template)
            if whole_alignment(plain(text), words) >= licenses.MIN_COVERAGE * len(words):
                want.add((i, name))
    assert {(r.doc_id, r.license) for r in got} == want and len(want) > 30
    texts = dict(rows)
    assert all(0 <= r.start_char < r.end_char <= len(texts[r.doc_id]) and 0.8 <= r.coverage <= 1 for r in got)
    assert sum(r.doc_id == 62 for r in got) == 2 * sum(r.doc_id == 1 for r in got)


def test_band_alignment_finds_what_the_loop_finds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        template = rng.integers(0, 12, rng.integers(5, 25))
        text = np.concatenate((rng.integers(0, 12, 6), np.delete(template, rng.integers(0, len(template))), rng.integers(0, 12, 6)))
        n, first, last = licenses.align(text, template, 6, len(text) + len(template))
        assert n == whole_alignment(text.tolist(), template.tolist()) and 0 <= first <= last < len(text)
