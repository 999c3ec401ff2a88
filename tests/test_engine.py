"""Registered queries against their SQL, and engine details that SQL doesn't cover."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.fixtures import builder as b
from quirelake.operators import edit, graph, pages, search
from quirelake.plans import registry
from quirelake.sources.pdf import PdfCorpus, read_pdf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sql, name):
    got = registry.queries()[name](spark, SF)
    want = sql.sql(registry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def corpus(spark, *files):
    return PdfCorpus(spark.createDataFrame([(f"f{i}", bytearray(d)) for i, d in enumerate(files)], "file_id string, content binary"))


def found(c, query, **options):
    return [(r.start, r.end, r.text) for r in search.search(c, query, **options).orderBy("file_id", "page_index", "start").collect()]


def test_search_rules(spark):
    c = corpus(spark, b.document("aaaa\nxa a a The the. a.b"))
    assert [m[:2] for m in found(c, "aa")] == [(0, 2), (2, 4)]
    assert [m[2] for m in found(c, "the")] == ["The", "the"] and [m[2] for m in found(c, "the", case_sensitive=True)] == ["the"]
    assert found(c, "a a", whole_word=True) == []  # the first match uses the second up
    assert [m[2] for m in found(c, "a.b")] == ["a.b"] and found(c, "") == [] and found(c, "zzz") == []
    assert len(found(c, "a", limit=3)) == 3 and search.search(c, "a", limit=3).where("truncated").count() == 3
    assert search.search_app(c, " a ").count() == 0


def test_search_across_runs_and_space(spark):
    c = corpus(spark, b.document("one tw\no three"))
    m = search.search(c, "two", space="page").collect()[0]
    assert (m.start, len(m.rects)) == (4, 2)
    assert [round(r.x0, 2) for r in m.rects] == [96, 72] and round(m.rects[0].y1 - m.rects[0].y0, 4) == 10
    s = search.search(c, "two", scale=2.0).collect()[0]
    assert round(s.rects[0].x0, 2) == 192 and round(s.rects[0].y0, 2) == round((792 - 720) * 2 - 20 * 0.78, 2)


def test_broken_and_odd_files(spark):
    c = corpus(spark, b"%PDF-1.4 nothing", b"", b.document("ok", form="cut"), b.document("fine").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /Filter /Standard >>"))
    facts = {r.file_id: r for r in pages.facts(c).collect()}
    assert set(facts) == {"f0", "f2", "f3"} and facts["f2"].verdict.startswith("Repaired") and facts["f3"].verdict == "Password protected" and facts["f3"].advice == "protected"
    assert {r.file_id: r.text for r in c.page_text.collect()} == {"f2": "ok"}
    assert {r.file_id for r in c.repairs.collect()} == {"f0", "f2"}


def test_edit_errors_and_sink(spark, tmp_path):
    c = corpus(spark, b.document("a\nb", one_page_a_line=True), b.document("x").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /Filter /Standard >>"))
    steps = spark.createDataFrame([("f0", 1, "remove", 0), ("f1", 1, "remove", 0)], "file_id string, seq int, op string, page int")
    out = edit.edit(c, steps)
    assert {r.file_id: (r.content is None, r.error is None) for r in out.collect()} == {"f0": (False, True), "f1": (True, False)}
    spark.dataSource.register(edit.PdfSink)
    out.where("error is null").select(F.concat("file_id", F.lit(".pdf")).alias("name"), "content").write.format("pdf_files").mode("append").save(str(tmp_path / "out"))
    again = read_pdf(spark, str(tmp_path / "out"))
    assert [r.text for r in again.page_text.collect()] == ["b"] and again.files.first().page_count == 1


def test_saved_tables(spark, tmp_path):
    c = corpus(spark, b.document("hello the world")).save_tables(str(tmp_path / "t"), ["text_runs", "pages"])
    assert found(c, "the") == [(6, 9, "the")]


def test_corpus_methods(spark):
    from quirelake.functions import text as t

    c = corpus(spark, b.document("find me"))
    assert c.search("me").count() == 1 and c.inventory().count() == 6 and c.facts().first().chars == 7
    assert PdfCorpus(c.save()).page_text.first().text == "find me"
    names = c.contents.select(t.saved_name(F.lit("a.PDF"), True).alias("x"), t.saved_name(F.lit("b"), False).alias("y")).first()
    assert tuple(names) == ("a-appended.pdf", "b-rewritten.pdf")


def test_references(spark):
    c = corpus(spark, b.document("a"))
    e = c.object_edges.select("file_id", "src", F.col("dst_num").alias("dst"))
    reach = graph.reachable(spark, e, spark.createDataFrame([("f0", 1)], "file_id string, num long"))
    assert {r.num: r.steps for r in reach.collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3}
    got = graph.resolve(spark.createDataFrame([("f0", 4), ("f0", 77)], "file_id string, num long"), c.objects, "num").collect()
    assert sorted(r.value is None for r in got) == [False, True]


def test_labels_before_the_first_rule(spark):
    rules = spark.createDataFrame([("f", 2, "Z", None, 7), ("f", 4, None, "p-", 1)], "file_id string, from_index int, style string, prefix string, start int")
    p = spark.createDataFrame([("f", i) for i in range(5)] + [("g", 0)], "file_id string, page_index int")
    assert [r.label for r in pages.with_labels(p, rules).orderBy("file_id", "page_index").collect()] == ["5", "6", "7", "8", "p-", "1"]
