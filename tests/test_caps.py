"""Trees of any depth, every part and code, tables parsed together, and searches that look at few pages."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import graph, search
from quirelake.plans import pdf, relational
from quirelake.sources.pdf import PdfCorpus

SF = "/root/testdata/sf0.001"


def test_inherit_from_far_up(spark):
    """A chain of 70 nodes, a node without any value above, one whose way up is a circle, and a parent that is missing."""
    rows = [(f"n{i}", f"n{i - 1}" if i else None, 7.0 if i == 1 else None) for i in range(70)]
    rows += [("lone", None, None), ("x", "y", None), ("y", "x", None), ("z", "x", 3.0), ("orphan", "gone", None), ("w", "z", None)]
    got = {r.node: r.value for r in graph.inherit(spark.createDataFrame(rows, "node string, parent string, attr double"), "attr").collect()}
    assert len(got) == len(rows) and got["n0"] is None and all(got[f"n{i}"] == 7 for i in range(1, 70))
    assert [got[k] for k in ("lone", "x", "y", "z", "orphan", "w")] == [None, None, None, 3, None, 3]
    assert graph.inherit(spark.createDataFrame([], "node string, parent string, attr double"), "attr").count() == 0


def test_tables_saved_together(spark, tmp_path):
    corpus = pdf.built(spark, SF)
    kinds = ["files", "pages", "text_runs", "streams", "fonts", "repairs", "objects"]
    saved = corpus.save_tables(str(tmp_path / "tables"), kinds)
    again = PdfCorpus(corpus.contents)
    for kind in kinds[:-1]:
        a, b = saved.table(kind), again.table(kind)
        assert a.schema.simpleString() == b.schema.simpleString()
        one = lambda df: sorted(map(str, df.collect()))
        assert one(a) == one(b), kind
    assert saved.objects.count() == again.objects.count() and saved.repairs.count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_search_by_either_way(spark, monkeypatch, few):
    corpus = pdf.built(spark, SF)
    monkeypatch.setattr(search, "FEW_PAGES", few)
    for options in ({"space": "page"}, {"whole_word": True}, {"case_sensitive": True, "limit": None}):
        found = search.search(corpus, "The", **options)
        pages = search.find(corpus.page_text, "The", options.get("case_sensitive", False), options.get("whole_word", False))
        assert found.select("file_id", "page_index", "start", "end").exceptAll(pages.select("file_id", "page_index", "start", "end")).count() == 0 < found.count()
    assert search.search(corpus, "no such words anywhere").count() == 0 and search.search(corpus, "").count() == 0
    with pytest.raises(ValueError):
        search.search(corpus, "a", space="paper")


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, k, d: d})()
        sparkContext = Context()

    with pytest.raises(ValueError):
        graph.shared_folder(Session())
    assert F.lit(1) is not None and graph.shared_folder(spark)


def test_roman_and_letters_of_every_part(spark, tmp_path):
    spark.createDataFrame([(n,) for n in (1, 3999, 4000, 20000)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.n: (r.roman, r.letters) for r in relational.roman_and_letters(spark, str(tmp_path)).collect()}
    assert got[4000] == ("mmmm", "EWV") and got[20000] == ("m" * 20, "ACOF") and len(got) == 4
