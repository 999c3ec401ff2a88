"""Index lookups against plain searches of the texts, added to and merged; and what a search over saved pages reads."""

import random

import pytest

from quirelake.fixtures import builder as b
from quirelake.operators import search
from quirelake.operators.search_index import SearchIndex
from quirelake.sources.pdf import PdfCorpus

WORDS = ["the", "The", "other", "Σοφός", "ΟΔΟΣ", "été", "İstanbul", "a", "ab", "worth", "worthless", "x.y", "漢字", "naïve", "$5"]


def texts(n=120):
    rng = random.Random(1)
    return [(f"f{i % 30}", i // 30, " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(texts(), "file_id string, page_index int, text string")
    return SearchIndex.build(df, str(tmp_path_factory.mktemp("index") / "i")), df


@pytest.mark.parametrize("query, case", [("worth", False), ("worthless", True), ("ΟΔΟΣ", False), ("ΟΔΟΣ", True), ("οδος", False), ("İstanbul", True), ("THE", False), ("the", True), ("x.y", False), ("ab", False), ("a", False), ("漢字", True), ("é", False), ("zzzz", False), ("her th", False), ("$5", False)])
def test_no_page_is_missed(index, query, case):
    found, df = index
    want = {(r.file_id, r.page_index) for r in search.find(df, query, case_sensitive=case).collect()}
    got = rows(found.candidates(query, case))
    assert want <= set(got) and len(got) == len(set(got))
    if len(query) == 5 and query.isascii() and not case:
        assert len(got) < 120


def test_added_and_merged(spark, tmp_path):
    df = spark.createDataFrame(texts(), "file_id string, page_index int, text string")
    parts = [df.where("page_index < 2"), df.where("page_index = 2"), df.where("page_index > 2")]
    index = SearchIndex.build(parts[0], str(tmp_path / "i"))
    whole = SearchIndex.build(df, str(tmp_path / "whole"))
    assert [index.add(p) for p in parts[1:]] == [1, 2]
    again = spark.createDataFrame([("f1", 0, "a newer worthy text")], "file_id string, page_index int, text string")
    index.add(again)
    assert ("f1", 0) in rows(index.candidates("newer"))
    for query in ("worth", "other", "ab"):
        assert set(rows(whole.candidates(query))) <= set(rows(index.candidates(query)))
    index.merge()
    assert index._segments() == [4] and index.pages.count() == 120 and ("f1", 0) in rows(index.candidates("newer"))
    assert rows(index.candidates("worthless")) == rows(whole.candidates("worthless").where("not (file_id = 'f1' and page_index = 0)"))
    assert SearchIndex(spark, str(tmp_path / "none")).candidates("worth").count() == 0
    none = SearchIndex.build(df.limit(0), str(tmp_path / "empty"))
    assert none.candidates("worth").count() == 0


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rng = random.Random(2)
    files = [(f"f{i}", bytearray(b.document("\n".join(" ".join(rng.choices(WORDS[:3] + WORDS[9:12], k=6)) for _ in range(8)), one_page_a_line=True))) for i in range(12)]
    corpus = PdfCorpus(spark.createDataFrame(files, "file_id string, content binary"))
    kept = corpus.save_tables(str(tmp_path_factory.mktemp("saved") / "t"), ["text_runs", "pages", "files"])
    return corpus, kept, SearchIndex.build(kept.page_text, str(tmp_path_factory.mktemp("saved") / "i"))


@pytest.mark.parametrize("options", [dict(limit=None), dict(limit=3), dict(limit=3, whole_word=True), dict(limit=2, limit_per_file=False), dict(limit=None, space="page"), dict(limit=5, case_sensitive=True)])
@pytest.mark.parametrize("query", ["the", "worthless"])
def test_saved_pages_give_the_same_rows(saved, query, options):
    parsed, kept, index = saved
    want = rows(search.search(parsed, query, **options))
    assert rows(search.search(kept, query, **options)) == want and want
    assert rows(search.search(kept, query, index=index, **options)) == want


def test_only_pages_up_to_the_limit_are_expanded(saved):
    """Pages behind those that reach the limit are in no row that glyphs are read for."""
    _, kept, _ = saved
    for limit in (1, 4, 1000):
        pages = search._first_pages(kept.page_text, "the", False, False, limit)
        per = {}
        for f, p, t in sorted(map(tuple, kept.page_text.select("file_id", "page_index", "text").collect())):
            if "the" in t.lower() and per.get(f, (0,))[0] < limit:
                n, listed = per.get(f, (0, []))
                per[f] = (n + t.lower().count("the"), [*listed, p])
        assert rows(pages) == sorted((f, p) for f, (_, listed) in per.items() for p in listed)


def test_tables_that_follow_from_saved_pages(saved):
    parsed, kept, _ = saved
    assert rows(kept.page_text) == rows(parsed.page_text)
    key = lambda c: sorted((r.file_id, r.page_index, r.run_seq, r.text, r.x, r.y, len(r.glyphs)) for r in c.text_runs.collect())
    assert key(kept) == key(parsed) and kept.text_runs.columns == parsed.text_runs.columns
    gathered = PdfCorpus(parsed.contents, {"text_runs": parsed.text_runs})
    assert rows(gathered.page_text) == rows(parsed.page_text) and gathered.page_runs.columns == kept.page_runs.columns
