"""Work that files share is done once, and what is shuffled, joined or listed is as small as it can be."""

import contextlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.fixtures import builder as b
from quirelake.kernel.content import PageFonts, operations, runs, shown
from quirelake.kernel.document import PdfFile
from quirelake.operators import pages, search, search_index, split_scan
from quirelake.plans import pdf
from quirelake.sources.pdf import PdfCorpus, few_tasks
from quirelake.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("form", ["classic", "objstm"])
def test_fonts_are_read_once_for_all_files(form):
    one, two = (PdfFile(b.document(t, "flate", form)) for t in ("first", "second"))
    assert one.get(3) == two.get(3) and one.get(3) is two.get(3)
    fonts = [PageFonts(p, p.pages()[0], {}).get("F1") for p in (one, two)]
    assert fonts[0] is fonts[1] and len(fonts[0].widths) == 224
    # other bytes are another font, and what refers into its file is not shared
    wide = [PdfFile(b.document(t, "flate", form, content=b.composite_content, composite=True)) for t in ("a", "b")]
    assert wide[0].get(3) is not wide[1].get(3) and wide[0].get(3) != one.get(3)


@pytest.mark.parametrize("more", [{}, {"content": b.operator_content}, {"content": b.composite_content, "composite": True}])
def test_texts_without_places(more):
    p = PdfFile(b.document("Ünder (a) \\ b\n\nsecond line\nthird\n4\n5\n6\n7\n8\n9", "flate", **more))
    page = p.pages()[0]
    ops, fonts = operations(p.contents(page)), PageFonts(p, page, {})
    assert shown(ops, fonts) == [r.text for r in runs(ops, fonts)] and len(shown(ops, fonts)) == 9


def test_edits_of_every_file_join_nothing(spark):
    after = pdf._page_lines(pdf._edited(spark, SF, [{"op": "insert_copy", "at": 0, "page": 1}], incremental=False))
    assert plan(after).count("Exchange") == 1 and "Join" not in plan(after)  # the one that deals documents


def test_documents_are_dealt_to_all_cores(spark):
    sizes = pdf.built(spark, SF).contents.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(r.n for r in sizes) < sum(r.n for r in sizes) / 4


def test_facts_by_one_parse(spark):
    assert "Join" not in plan(pages.facts(pdf.built(spark, SF))) and pages.facts(pdf.built(spark, SF)).count() > 0


def test_rectangles_are_sorted_without_glyphs(spark):
    found = search.search(pdf.built(spark, SF), "the", limit=5, space="page")
    told = plan(found)
    assert "rects" in told.split("Window", 1)[1] and "spans" not in told.split("Exchange", 1)[0]


def test_lists_are_put_together_before_the_shuffle():
    batch = pa.RecordBatch.from_pydict({"no": list(range(1000)), "text": ["worth"] * 999 + [None]})
    (out,) = search_index._lists(iter([batch]))
    rows = {r["gram"]: r["slots"] for r in out.to_pylist()}
    assert set(rows) == {"wor", "ort", "rth", "th", "h"} and all(x == list(range(999)) for x in rows.values())


def test_many_small_files_are_few_batches_and_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(1200):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(b.document(f"text {i}"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["page_text"], str(tmp_path / "c")).awaitTermination()
    assert len(list((tmp_path / "out" / "page_text").glob("batch=*"))) == 1
    got = ingest.newest_version(spark.read.parquet(str(tmp_path / "out" / "page_text")))
    assert sorted(r.text for r in got.collect()) == sorted(f"text {i}" for i in range(1200))
    assert got.where(F.col("file_id").endswith("/7.pdf") & F.col("modificationTime").isNotNull()).count() == 1
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    assert few_tasks(files).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < files.rdd.getNumPartitions()


def test_matches_leave_many_at_a_time(spark):
    made = spark.createDataFrame([(str(i), bytearray(b"x Tj (x Tj) " * 200)) for i in range(20)], "file_id string, content binary")
    assert split_scan.find_outside(made, b" Tj", 700).count() == 20 * 200
    assert PdfCorpus(made).contents.count() == 20


def test_a_knapsack_looks_at_every_class():
    """The only class that fills the rest is of least worth for its size, behind many that don't fit together."""
    import numpy as np

    from quirelake.llm import packing

    size = np.array([1000, *range(2100, 2800)])
    worth = np.array([0.0001, *(size[1:] / 4096)])
    size, worth = np.append(size, 1200), np.append(worth, 0.0002)
    best = max(w + (0.0002 if s + 1200 <= 4096 else 0) + (0.0001 if s + 2200 <= 4096 else 0) for s, w in zip(size[1:-1], worth[1:-1]))
    count = packing._price(size, worth, np.ones(len(size), np.int64), 4096)
    assert (count * size).sum() <= 4096 and (count * worth).sum() >= 0.998 * best
