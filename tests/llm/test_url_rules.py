"""Mined URL rules against an enumeration of all token sets."""

import math
import random
from collections import defaultdict
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from quirelake.llm import url_rules


def brute(rows, min_support, min_confidence):
    """Rules (items, confidence, support) by trying every set of tokens."""
    at = defaultdict(set)
    for k, (items, _) in enumerate(rows):
        for t in items:
            at[t].add(k)
    bad = {k for k, (_, b) in enumerate(rows) if b}
    least = max(1, math.ceil(min_support * len(rows) - 1e-9))
    tokens = [t for t, own in at.items() if len(own & bad) >= least]
    found = {}
    for size in range(1, len(tokens) + 1):
        for items in combinations(sorted(tokens), size):
            own = set.intersection(*(at[t] for t in items))
            if len(own & bad) >= least:
                found[items] = (len(own & bad) / len(own), len(own & bad) / len(rows))
    rules = {i: v for i, v in found.items() if v[0] >= min_confidence}
    return {i: v for i, v in rules.items() if not any(set(j) < set(i) and w[0] >= v[0] for j, w in rules.items())}


@pytest.mark.parametrize("seed, support, confidence", [(1, 0.02, 0.6), (2, 0.1, 0.5), (3, 0.005, 0.8)])
def test_rules_against_all_sets(spark, seed, support, confidence):
    rng = random.Random(seed)
    urls = []
    for _ in range(150):
        host = rng.choice(["a.x", "b.x", "a.y"])
        url = f"http://{host}/{rng.choice(['p/q', 'p', 'r/s'])}" + rng.choice(["", "?k=1", "?k=1&l=2"])
        urls.append((url, None if rng.random() < 0.05 else rng.random() < (0.8 if "k=" in url and "a." in url else 0.3)))
    urls += urls[:20]
    df = spark.createDataFrame(urls, "`the.url` string, bad boolean")
    told = df.where("bad is not null").select(url_rules.tokens(F.col("`the.url`")).alias("t"), "bad").collect()
    want = brute([(r.t, r.bad) for r in told], support, confidence)
    got = url_rules.mine(df, url="the.url", min_support=support, min_confidence=confidence).collect()
    every = {tuple(sorted(items)): (round(r.confidence, 9), round(r.support, 9)) for r in got for items in product(*r.members)}
    assert every == {k: (round(a, 9), round(b, 9)) for k, (a, b) in want.items()} and want
    assert all(r.key in r["items"] for r in got)


def test_every_token_of_the_same_urls_is_a_rule(spark):
    urls = [(f"http://bad.com/spam/{i}", True) for i in range(20)] + [(f"http://good{i}.org/x/{i}", False) for i in range(20)]
    mined = url_rules.mine(spark.createDataFrame(urls, "url string, bad boolean"), min_confidence=0.9)
    pages = spark.createDataFrame([(1, "http://other.org/spam/99"), (2, "http://bad.com/y"), (3, "http://good1.org/x/1"), (4, "http://bad.com/spam"), (5, None)], "page_id int, url string")
    got = {r.page_id: (r.verdict, r.mined_rule, r.mined_confidence) for r in url_rules.judge(pages, [], mined).collect()}
    assert got == {1: ("block", "path:spam", 1.0), 2: ("block", "host:com", 1.0), 3: ("allow", None, None), 4: ("block", "path:spam", 1.0), 5: ("allow", None, None)}


def test_tokens_beyond_the_twelfth(spark):
    """Only the query key after an eight-label host tells bad URLs, and the rule is that key alone."""
    urls = [(f"http://a.b.c.d.e.f.g{i % 5}.com/u/v/w/{i}?{'bad' if i % 2 else 'good'}=1", bool(i % 2)) for i in range(60)]
    mined = url_rules.mine(spark.createDataFrame(urls, "url string, bad boolean"), min_confidence=0.6).collect()
    assert [r["members"] for r in mined] == [[["key:bad"]]]


def test_nothing_to_mine(spark):
    for rows in ([("http://a.b/c", False)] * 3, [(None, True), ("no scheme", True)], [("http://a.b", None)]):
        assert url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
