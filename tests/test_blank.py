"""Documents without a shown character, and without a text."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quirelake.fixtures import builder as b
from quirelake.plans import registry
from quirelake.sources.pdf import PdfCorpus

TEXTS = ["one the line", "", "\n", "\n\n", "a\n\nb the end", " ", None]
FILTERS = [f"pdf_filters_{f}" for f in ("plain", "flate", "hex", "a85", "rl", "lzw", "png", "chain")]
FORMS = ["pdf_nested", "pdf_objstm", "pdf_operator_text", "pdf_composite_text", "pdf_read_directory", "pdf_repair_cut", "pdf_repair_offsets", "pdf_three_revisions", "pdf_save_full", "pdf_roundtrip_text", "stream_ingest"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("blank")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS}), top / "documents.parquet")
    return str(top)


@pytest.mark.parametrize("name", [*FILTERS, *FORMS])
def test_blank_documents_have_a_row(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, folder)
    rows = lambda found: sorted(map(tuple, found), key=repr)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_runs_of_blank_pages(spark, tmp_path):
    files = [b.document(t, one_page_a_line=True) for t in ("a\n\nb", "", "\n")]
    c = PdfCorpus(spark.createDataFrame([(f"f{i}", bytearray(d)) for i, d in enumerate(files)], "file_id string, content binary"))
    assert sorted((r.file_id, r.page_index, r.text, len(r.runs)) for r in c.page_runs.collect()) == [("f0", 0, "a", 1), ("f0", 1, "", 0), ("f0", 2, "b", 1), ("f1", 0, "", 0), ("f2", 0, "", 0), ("f2", 1, "", 0)]
    saved = c.save_tables(str(tmp_path / "t"), ["page_runs"])
    assert sorted(map(tuple, saved.page_text.collect())) == sorted(map(tuple, c.page_text.collect())) == [("f0", 0, "a", 1), ("f0", 2, "b", 1)]
    assert saved.text_runs.count() == 2
