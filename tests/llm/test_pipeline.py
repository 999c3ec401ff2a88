"""Stages of the corpus pipeline against brute force, and the registered queries."""

import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quirelake.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = {k for k in __spark_entry__.queries() if k.startswith("op")}
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark):
    t = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = " ".join(f"other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(1, t, "en", "s", len(t)), (2, t, "en", "s", len(t)), (3, t.replace("wordcb", "zzz"), "en", "s", len(t)), (4, own + " " + t[:200], "en", "s", 0), (5, None, "en", "s", 0), (6, "12 34", "de", "s", 5), (7, "kurz", "de", "s", 4), (7, "kurz", "de", "s", 4), (None, "leer", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert one.columns == docs.columns and sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 2, 3, 4, 7, 7]
    two = corpus_pipeline.near_copies(spark, one, SF)
    assert two.columns == docs.columns and sorted((r.doc_id or 0) for r in two.collect()) == [0, 1, 4, 7]
    three = corpus_pipeline.repeated_passages(spark, two, SF)
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and set(got) == {None, 1, 4, 7} and got[1].text == t
    assert got[4].text.startswith(own) and len(got[4].text) < len(own) + 20 and got[4].n_chars == len(got[4].text)
    four = corpus_pipeline.best_fit_packing(spark, three, SF).collect()
    assert len(four) == 4 and {r.doc_id for r in four} == {None, 1, 4, 7}
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_copies, corpus_pipeline.repeated_passages, corpus_pipeline.best_fit_packing):
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    out = queries.queries()[name](spark, SF)
    assert out.count() > 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
