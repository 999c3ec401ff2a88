"""Searches on more pages than are sent around: glyphs don't travel, and what isn't saved is parsed once."""

import contextlib
import io

import pytest

from quirelake.fixtures import builder as b
from quirelake.operators import search
from quirelake.operators.search_index import SearchIndex
from quirelake.plans import pdf
from quirelake.sources.pdf import PdfCorpus

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    return pdf.built(spark, SF, one_page_a_line=True).save_tables(str(tmp_path_factory.mktemp("saved") / "t"), ["page_runs"])


def test_what_is_not_saved_is_parsed_once(spark):
    corpus = pdf.built(spark, SF)
    found = search.search(corpus, "the", limit=5, space="page")
    assert not corpus.saved("page_runs") and plan(found).count("MapInArrow") == 2  # one builds, one parses
    assert rows(corpus.page_text) == rows(pdf.built(spark, SF).page_text) and plan(corpus.page_text).count("inline") == 0


def test_glyphs_are_not_shuffled(spark, saved, monkeypatch):
    few = search.search(saved, "the", limit=3, space="page")
    monkeypatch.setattr(search, "FEW_PAGES", 0)
    many = search.search(saved, "the", limit=3, space="page")
    assert "Join" not in plan(many) and rows(few) == rows(many) != []


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("limit", [None, 1])
def test_index_with_and_without_saved_pages(spark, saved, tmp_path, monkeypatch, few, limit):
    corpus = pdf.built(spark, SF, one_page_a_line=True)
    index = SearchIndex.build(corpus.page_text.where("file_id < '5'"), str(tmp_path / "i"))  # an index of some files finds these
    monkeypatch.setattr(search, "FEW_PAGES", few)
    want = [r for r in rows(search.search(corpus, "wor", limit=limit, space="page")) if "file_id='5" > r[4:]]
    for c in (corpus, saved):
        assert rows(search.search(c, "wor", limit=limit, space="page", index=index)) == want != []


def test_pages_with_letters_that_fold_otherwise(spark):
    texts = ["The İstanbul", "STRASSE", "straße ÜBER", "über", "nothing"]
    c = PdfCorpus(spark.createDataFrame([(f"f{i}", bytearray(b.document(t.replace("İ", "I")))) for i, t in enumerate(texts)], "file_id string, content binary"))
    for needle, folded, exact in (("über", ["f2", "f3"], ["f3"]), ("ÜBER", ["f2", "f3"], ["f2"]), ("Str", ["f1", "f2"], []), ("istan", ["f0"], [])):
        assert sorted({r.file_id for r in search.search(c, needle, space="page").collect()}) == folded
        assert sorted({r.file_id for r in search.search(c, needle, case_sensitive=True, space="page").collect()}) == exact
