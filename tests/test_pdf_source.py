"""The data source against ``read_pdf``, and what its filters keep from being read."""

import pytest
from pyspark.sql import functions as F

from quirelake.fixtures import builder as b
from quirelake.sources import pdf_source
from quirelake.sources.pdf import read_pdf


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for i in range(9):
        (top / f"f{i}.pdf").write_bytes(b.document("\n".join(f"file {i} page {k}" for k in range(4)), one_page_a_line=True))
    (top / "note.txt").write_text("no file")
    (top / "short.pdf").write_bytes(b"%PDF")
    pdf_source.register(spark)
    return str(top)


def source(spark, folder, **options):
    return spark.read.format("pdf").options(**options).load(folder)


@pytest.mark.parametrize("table", ["page_text", "pages", "files", "text_runs", "fonts", "content_ops"])
def test_rows_are_those_of_read_pdf(spark, folder, table):
    own, other = source(spark, folder, table=table), read_pdf(spark, folder).table(table)
    columns = [c for c, t in own.dtypes if c not in ("file_id", "operands")]
    name = F.regexp_extract("file_id", r"([^/]+)$", 1).alias("file")
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select(name, *columns).collect())
    assert rows(own) == rows(other) and own.count() > 0


def test_filters_are_pushed_and_hold(spark, folder):
    pages = source(spark, folder).where("page_index = 2")
    assert sorted(r.text for r in pages.collect()) == [f"file {i} page 2" for i in range(9)]
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    one = source(spark, folder).where((F.col("file_id") == f"{folder}/f3.pdf") & F.col("page_index").isin(0, 3) & (F.length("text") > 3))
    assert sorted(r.text for r in one.collect()) == ["file 3 page 0", "file 3 page 3"] and one.rdd.getNumPartitions() == 1
    some = source(spark, folder).where("page_index > 0 and page_index <= 2 and page_index < 2 and page_index >= 1")
    assert {r.page_index for r in some.collect()} == {1}


def test_partitions_by_size(spark, folder):
    assert source(spark, folder, partition_bytes="1").rdd.getNumPartitions() == 9 and source(spark, folder).rdd.getNumPartitions() == 1
    reader = pdf_source._Reader({"path": folder, "partition_bytes": "9000"}, None)
    reader.pages.append(("eq", 1))
    parts = reader.partitions()
    assert sum(len(p.paths) for p in parts) == 9 and 1 < len(parts) < 9
    assert source(spark, folder, pattern="*.none").count() == 0
