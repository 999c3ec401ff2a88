"""Folders of files that are read one after another, so that the driver lists few files at a time."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quirelake.operators import edit
from quirelake.plans import pdf, relational, text
from quirelake.sources import pdf as source
from quirelake.streaming import ingest

N = 60


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("docs")
    pq.write_table(pa.table({"doc_id": pa.array(range(N), pa.int64()), "text": [f"text {i}" for i in range(N)]}), top / "documents.parquet")
    return str(top)


def test_directory_folder_by_folder(spark, folder, monkeypatch):
    monkeypatch.setattr(pdf, "FOLDER", 7)
    listed = []
    plain = source.read_pdf
    monkeypatch.setattr(source, "read_pdf", lambda spark, path, *more: listed.append(spark.read.format("binaryFile").load(path).count()) or plain(spark, path, *more))
    got = text.pdf_read_directory(spark, folder)
    assert sorted((r.doc_id, r.chars) for r in got.collect()) == [(i, len(f"text {i}")) for i in range(N)]
    assert len(listed) > 4 and sum(listed) == N and max(listed) < N / 2


def test_stream_folder_by_folder(spark, folder, monkeypatch):
    monkeypatch.setattr(pdf, "FOLDER", 20)
    listed = []
    plain = ingest.ingest
    monkeypatch.setattr(ingest, "ingest", lambda spark, path, *more: listed.append(spark.read.format("binaryFile").load(path).count()) or plain(spark, path, *more))
    got = relational.stream_ingest(spark, folder)
    assert sorted((r.doc_id, r.chars) for r in got.collect()) == [(i, len(f"text {i}")) for i in range(N)]
    assert len(listed) == 3 and sum(listed) == N


def test_sink_makes_folders(spark, tmp_path):
    spark.dataSource.register(edit.PdfSink)
    rows = [("a/b/1.pdf", bytearray(b"x" * 9)), ("2.pdf", bytearray(b"y" * 9)), ("a/3.pdf", None)]
    spark.createDataFrame(rows, "name string, content binary").write.format("pdf_files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "a" / "b" / "1.pdf").read_bytes() == b"x" * 9 and (tmp_path / "out" / "2.pdf").exists()
    assert not (tmp_path / "out" / "a" / "3.pdf").exists() and source.folders(spark, str(tmp_path / "out")) == ["a"]
