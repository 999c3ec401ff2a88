"""Links of vectors whose ids are null or repeated, against every pair."""

import math
import random

import numpy as np
import pytest

from quirelake.llm import vectors


def brute(rows):
    """Counted (id, n_links, component_id, kept) by comparing every two rows."""
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))
    fine = lambda v: v is not None and len(v) > 0 and None not in v and any(v)
    linked = lambda i, j: fine(rows[i][1]) and fine(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.9
    near = [[j for j in range(len(rows)) if j != i and linked(i, j)] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            more = [j for j in near[todo.pop()] if j not in seen]
            seen.update(more)
            todo += more
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


CASES = {
    "null id beside others": [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [0.0, 1.0])],
    "one id on two vectors": [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.1]), (7, [1.0, 0.05])],
    "null ids that link": [(None, [1.0, 0.0]), (None, [1.0, 0.1]), (9, [-1.0, 0.0]), (None, [-1.0, 0.01]), (None, None), (3, [0.0, 0.0])],
}


@pytest.mark.parametrize("name", CASES)
def test_ids(spark, name):
    got = vectors.near_duplicates(spark.createDataFrame(CASES[name], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(CASES[name])


def test_random_ids_in_small_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), [rng.gauss(0, 1) for _ in range(3)]) for _ in range(120)]
    rows += [(rng.choice([None, 4, 70]), v) for _, v in rows[:30]]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("tile", [16 * 3 * 8, 5 * 16 * 3 * 8, 1 << 20])
def test_tiles_of_blocks(spark, monkeypatch, tile):
    """One block, five blocks, and as many as there are on either side of a tile; a block is shuffled once a tile."""
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_a_tile_has_one_row_a_vector():
    """Links of three blocks with each other: counts are added up, and the forest has an edge less than there are vectors."""
    units = np.array([[1.0, 0.0], [0.999, (1 - 0.999**2) ** 0.5]])
    held = {k: [np.array([10 * k, 10 * k + 1]), np.array([1, 2]), units.ravel()] for k in range(3)}
    out = vectors._tile([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], held, 2, 0.9).to_pylist()
    assert [(r["rep"], r["links"]) for r in out] == [(10 * k + i, 9 - (1, 2)[i]) for k in range(3) for i in range(2)]
    assert sum(len(r["to"]) for r in out) == 5
