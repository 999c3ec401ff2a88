"""Running totals, islands, as-of and interval joins, and tree totals against plain loops; with keys cut into bins and without."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirelake.operators import graph, ranges



def keyed(n=600, hot=0.7, seed=1):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.03 else "hot" if rng.random() < hot else f"k{rng.randrange(40)}", rng.choice([None, *range(n // 2)]), i, rng.randint(-5, 9) if rng.random() < 0.95 else None) for i in range(n)]


@pytest.mark.parametrize("bins", [None, 16, 300])
def test_running(spark, bins):
    rows = keyed()
    df = spark.createDataFrame(rows, "k string, o int, i int, v int")
    got = {r.i: (r.total, r.place) for r in ranges.running(df, ["k"], ["o", "i"], {"total": F.col("v"), "place": F.lit(1)}, bins).collect()}
    want, total, place = {}, {}, {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        total[k], place[k] = total.get(k, 0) + (v or 0), place.get(k, 0) + 1
        want[i] = (total[k], place[k])
    assert got == want


def test_a_key_with_all_rows_is_many_bins(spark):
    df = spark.range(4000).select(F.lit("x").alias("k"), (F.col("id") * 7919 % 4001).alias("o"))
    laid, cut = ranges.binned(df, ["k"], ["o"], 20)
    per = [r["count"] for r in laid.groupBy("_bin").count().collect()]
    assert cut and 15 <= len(per) <= 25 and max(per) <= 3 * sorted(per)[len(per) // 2]
    plain, cut = ranges.binned(spark.range(400).select(F.col("id").alias("k"), F.col("id").alias("o")), ["k"], ["o"], 20)
    assert not cut and plain.select("_bin").distinct().count() == 1


@pytest.mark.parametrize("bins", [None, 25])
def test_islands(spark, bins):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(120)])) for _ in range(300)]
    got = sorted((r.k or "", r["first"], r["count"]) for r in ranges.islands(spark.createDataFrame(rows, "k string, n int"), ["k"], "n", bins).collect())
    want = []
    for k in {r[0] for r in rows}:
        numbers = sorted({n for x, n in rows if x == k and n is not None})
        for n in numbers:
            if want and want[-1][0] == (k or "") and sum(want[-1][1:]) == n:
                want[-1] = (*want[-1][:2], want[-1][2] + 1)
            else:
                want.append((k or "", n, 1))
    assert got == sorted(want)


@pytest.mark.parametrize("bins", [None, 30])
def test_asof(spark, bins):
    rng = random.Random(3)
    at = lambda: None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(90))
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), at(), i) for i in range(300)] + [("none", at(), 900), ("hot", datetime(2024, 1, 1, 0, 5), 901)] * 2
    right = [(key(), at(), rng.choice([None, *range(50)]), i) for i in range(150)]
    out = ranges.asof(spark.createDataFrame(left, "k string, t timestamp, v int"), spark.createDataFrame(right, "k string, rt timestamp, v2 int, w int"), ["k"], "t", "rt", ["v2", "w"], bins)
    assert out.columns == ["k", "t", "v", "v2", "w"]
    want = []
    for k, t, i in left:
        before = [r for r in right if r[0] == k and k is not None and t is not None and r[1] is not None and r[1] <= t]
        last = max(before, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3]), default=(None,) * 4)
        want.append((k, t, i, last[2], last[3]))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_overlaps(spark, kind):
    rng = random.Random(4)
    number = (lambda a, b: rng.randint(a, b)) if kind == "long" else (lambda a, b: round(rng.uniform(a, b), 3))

    def side():
        rows = []
        for i in range(150):
            begin = number(-500, 500)
            rows.append((rng.choice(["hot", "hot", "b", None]), i, begin, begin + rng.choice([0, 1, number(0, 5), number(0, 60), number(0, 2000), -3])))
        return rows + [("hot", 997, None, 5 if kind == "long" else 5.0), ("hot", 998, number(0, 1), None), ("hot", 999, -(1 << 62) if kind == "long" else -1e300, 1 << 61 if kind == "long" else 1e300)]

    a, b = side(), side()
    make = lambda rows, n: spark.createDataFrame(rows, f"k string, {n} int, {n}_from {kind}, {n}_to {kind}")
    got = sorted((r.a, r.b) for r in ranges.overlaps(make(a, "a"), make(b, "b"), ["k"], "a_from", "a_to", "b_from", "b_to").collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[0] is not None and None not in (*x, *y) and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 500


def test_what_is_compared_grows_with_what_is_found(spark):
    """One key, short ranges spread over a long axis: candidates stay a small multiple of the pairs, far from the square."""
    n = 20_000
    a = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") * 1000).alias("f"), (F.col("id") * 1000 + 600).alias("t"))
    b = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("b"), (F.col("id") * 1000 + 300).alias("bf"), (F.col("id") * 1000 + 900).alias("bt"))
    out = ranges.overlaps(a, b, ["k"], "f", "t", "bf", "bt")
    assert out.count() == n and out.where("a <> b").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "k string, o int, v int")
    some = spark.createDataFrame([("x", 1, 2)], "k string, p int, w int")
    assert ranges.running(none, ["k"], ["o"], {"t": F.col("v")}).count() == 0 == ranges.islands(none, ["k"], "o").count() == ranges.asof(none, some, ["k"], "o", "p", ["w"]).count()
    assert [r.v for r in ranges.asof(some, none, ["k"], "p", "o", ["v"]).collect()] == [None]
    assert ranges.overlaps(none, some, ["k"], "o", "v", "p", "w").count() == 0


def test_tree_totals_of_a_chain_and_a_star(spark):
    chain = spark.range(1000).select("id", F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = {r.node: r.total for r in graph.rollup(chain, F.lit(1)).collect()}
    assert got == {i: 1000 - i for i in range(1000)}
    star = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0)).alias("parent"))
    assert graph.rollup(star, F.col("node")).where("node = 0").first().total == 4999 * 2500
    assert graph.closure(chain.select("node", "parent").where("node < 40")).count() == 40 * 41 // 2


def test_tree_totals_of_any_shape(spark):
    rng = random.Random(5)
    parent = {i: rng.choice([None, *range(max(0, i - 4), i)]) for i in range(150)}
    rows = [(i, p, rng.choice([None, 1, 2, 5])) for i, p in parent.items()]
    rows += [(200, 999, 3), (301, 302, 1), (302, 303, 1), (303, 301, 1), (304, 303, 1)]  # a parent that is no node, a circle and what is below it
    total = {i: 0 for i, _, _ in rows}
    for i, _, v in rows[:151]:
        at = i
        while at in total:
            total[at] += v or 0
            at = parent.get(at)
    want = {i: (None if i > 300 else t) for i, t in total.items()}
    tree = spark.createDataFrame(rows, "node int, parent int, v int")
    assert {r.node: r.total for r in graph.rollup(tree, F.col("v")).collect()} == want
    ways = {(r.ancestor, r.node): r.steps for r in graph.closure(tree.where("node < 200").select("node", "parent")).collect()}
    want = {}
    for i in range(150):
        at, k = i, 0
        while at is not None:
            want[at, i] = k
            at, k = parent[at], k + 1
    assert ways == want
    with pytest.raises(ValueError):
        graph.closure(tree.where("node > 300").select("node", "parent"))


def test_reach_and_inheritance_have_no_depth(spark):
    edges = spark.createDataFrame([("f", i, i + 1) for i in range(90)], "file_id string, src long, dst long")
    assert graph.reachable(spark, edges, spark.createDataFrame([("f", 0)], "file_id string, num long")).agg(F.max("steps")).first()[0] == 90
    spark.createDataFrame([(i, i - 1 if i else None, 5.0 if i == 0 else None) for i in range(80)], "node int, parent int, attr double").createOrReplaceTempView("deep_tree")
    assert spark.sql(graph.inherit_sql("deep_tree", "attr")).where("value = 5").count() == 80
