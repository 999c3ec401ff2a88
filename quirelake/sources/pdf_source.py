"""``spark.read.format("pdf")``: one table of PDF files as a data source that plans its reads.

Files are put together into partitions of about ``partition_bytes`` by their sizes, the largest first, so that one large file is not read behind many small ones.
Filters on ``file_id`` choose files while planning, filters on ``page_index`` choose the pages whose content is interpreted, and Spark checks nothing of
these again. It takes ``spark.sql.python.filterPushdown.enabled``, which ``register`` sets; without it rows are the same and Spark filters them.

Options: ``path`` (a folder or file, by any URI that pyarrow's file systems read), ``table`` (of ``SCHEMAS``, by default ``page_text``; values of VARIANT
tables come as JSON text), ``pattern`` (``*.pdf``), ``min_bytes`` (8) and ``partition_bytes`` (16 MB). Encrypted files have no text, and files that are not PDF what can be
told of them, as with ``read_pdf``; ``file_id`` is the file's path.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernel.document import PdfFile
from .pdf import SCHEMAS, to_batches

_COMPARED = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}


def holds(kind: str, value: Any, bound: Any) -> bool:
    return {"eq": lambda: value == bound, "gt": lambda: value > bound, "ge": lambda: value >= bound, "lt": lambda: value < bound, "le": lambda: value <= bound, "in": lambda: value in bound}[kind]()


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "page_text")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), to_arrow_schema(schema))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.arrow = schema
        self.table = options.get("table", "page_text")
        self.path, self.pattern = options["path"], options.get("pattern", "*.pdf")
        self.least, self.share = int(options.get("min_bytes", 8)), int(options.get("partition_bytes", 16 << 20))
        self.files: list[tuple[str, Any]] = []
        self.pages: list[tuple[str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        paged = "page_index int" in SCHEMAS[self.table] and self.table != "outline"
        for f in filters:
            if isinstance(f, IsNotNull) and (f.attribute == ("file_id",) or f.attribute == ("page_index",) and paged):
                continue  # neither ever is null
            kind, column = _COMPARED.get(type(f)), getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if kind is not None and value is not None and column == ("file_id",):
                self.files.append((kind, value))
            elif kind is not None and value is not None and column == ("page_index",) and paged:
                self.pages.append((kind, value))
            else:
                yield f

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, top = self._store()
        found = store.get_file_info(fs.FileSelector(top, recursive=True)) if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        kept = [x for x in found if x.type == fs.FileType.File and x.size >= self.least and fnmatch.fnmatch(x.base_name, self.pattern) and all(holds(k, x.path, v) for k, v in self.files)]
        parts: list[Files] = []
        held, size = [], 0
        for x in sorted(kept, key=lambda x: (-x.size, x.path)):
            if held and size + x.size > self.share:
                parts.append(Files(held))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return [*parts, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()

        def opened() -> Iterator[tuple[str, PdfFile]]:
            for path in partition.paths:
                with store.open_input_stream(path) as f:
                    pdf = PdfFile(f.read())
                pdf.wanted = lambda i: all(holds(k, i, v) for k, v in self.pages)
                yield path, pdf

        yield from to_batches(self.table, self.arrow, opened())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
