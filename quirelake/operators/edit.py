"""Page edits and saves of many files, and writing them out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..kernel.document import PdfFile
from ..kernel.edits import apply_edits
from ..kernel.writer import Writer
from ..sources.pdf import PdfCorpus

#: Columns of an edit; op is one of insert_blank, insert_copy, remove, move, rotate, set_box, set_content,
#: set_inherited and set_trailer, whose value is a number or PDF syntax. Those that an op doesn't use are null or left out.
EDIT_COLUMNS = {"at": "int", "page": "int", "pages": "array<int>", "degrees": "double", "width": "double", "height": "double", "key": "string", "box": "array<double>", "scale_content": "boolean", "content": "binary", "value": "double", "syntax": "string"}
#: Edits up to this number, and bytes of content in them, are sent to where files are read; more of them meet the files by a shuffle.
FEW_EDITS, FEW_BYTES = 200_000, 32 << 20


def edit(corpus: PdfCorpus, edits: DataFrame | list[dict], incremental: bool = True, compress: bool = False) -> DataFrame:
    """Files (file_id, content) after their edits (file_id, seq, op and EDIT_COLUMNS), in the order of seq.

    A file's edits travel as one array to where the file is read, so that its bytes aren't shuffled unless edits are many.
    A list of edits (op and arguments, in order) is that of every file, and nothing is joined. Files without edits are not returned; encrypted ones come back with a null content and an error.
    """
    def one(content: bytes, steps: list) -> tuple[bytes | None, str | None]:
        try:
            return apply_edits(content, steps, incremental, compress), None
        except ValueError as e:
            return None, str(e)

    schema = "file_id string, content binary, error string"
    if isinstance(edits, list):

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, made in _written(batches, lambda b, i: one(b.column("content")[i].as_py(), edits)):
                yield _edited_batch(ids, made)

        return corpus.contents.select("file_id", "content").mapInArrow(same, schema)
    fields = [F.col(c) if c in edits.columns else F.lit(None).cast(t).alias(c) for c, t in EDIT_COLUMNS.items()]
    steps = edits.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", *fields)), lambda a, b: (a["seq"] - b["seq"]).cast("int")).alias("steps"))
    size = F.octet_length("content") if "content" in edits.columns else F.lit(0)
    n = edits.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    few = n["rows"] <= FEW_EDITS and n["bytes"] <= FEW_BYTES
    joined = corpus.contents.join(F.broadcast(steps) if few else steps, "file_id").select("file_id", "content", "steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _written(batches, lambda b, i: one(b.column("content")[i].as_py(), b.column("steps")[i].as_py())):
            yield _edited_batch(ids, made)

    return joined.mapInArrow(run, schema)


def _edited_batch(ids: list, made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.string())], ["file_id", "content", "error"])


def _written(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch, int], tuple]) -> Iterator[tuple[list, list[tuple]]]:
    """Ids and what is made of each row (first of it the file's bytes), some megabytes at a time."""
    ids, made, size = [], [], 0
    for b in batches:
        for i in range(b.num_rows):
            made.append(make(b, i))
            ids.append(b.column("file_id")[i].as_py())
            size += len(made[-1][0] or b"")
            if size > 8 << 20 or len(ids) >= 1000:
                yield ids, made
                ids, made, size = [], [], 0
    if ids:
        yield ids, made


def save(corpus: PdfCorpus, incremental: bool = False, compress: bool = False) -> DataFrame:
    """Every file written anew (or, appended to without changes, as it is): file_id, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _written(batches, lambda b, i: (Writer(PdfFile(b.column("content")[i].as_py())).save(incremental, compress),)):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x for (x,) in made], pa.binary())], ["file_id", "content"])

    return corpus.contents.select("file_id", "content").mapInArrow(run, "file_id string, content binary")


def appended(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether each file still starts with its old bytes."""
    old = before.select("file_id", F.col("content").alias("old"))
    return after.join(old, "file_id").select("file_id", F.startswith("content", "old").alias("appended"))


class PdfSink(DataSource):
    """Writes rows (name, content) as files: ``df.write.format("pdf_files").mode("append").save(uri)``. A name may have folders."""

    @classmethod
    def name(cls) -> str:
        return "pdf_files"

    def writer(self, schema, overwrite):
        return _PdfSinkWriter(self.options["path"])


class _PdfSinkWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")
        store.create_dir(top, recursive=True)
        made = {""}
        for b in iterator:
            for file, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                if content is not None:
                    if (folder := file.rpartition("/")[0]) not in made:
                        store.create_dir(f"{top}/{folder}", recursive=True)
                        made.add(folder)
                    with store.open_output_stream(f"{top}/{file}") as out:
                        out.write(content)
        return WriterCommitMessage()
