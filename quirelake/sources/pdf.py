"""PDF files as tables.

``read_pdf`` scans files with Spark's ``binaryFile`` source; ``PdfCorpus`` derives each table from the bytes
in one Arrow-batched Python stage, and only when that table is used. A table's stage parses what the table needs and
no more. ``PdfCorpus.save_tables`` writes derived tables as Parquet once, for queries that run on them many times.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernel.content import PageFonts, operations, runs, shown
from ..kernel.document import Page, PdfFile, box, kind_of, quarter_turn
from ..kernel.values import Keyword, Name, Ref, Stream, text

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
SCHEMAS = {
    "files": "file_id string, length long, version string, startxref long, size long, encrypted boolean, encryption_filter string, sections_read array<long>, object_count long, page_count long, declared_pages long, repair_count long",
    "file_facts": "file_id string, version string, sections_read array<long>, object_count long, page_count long, repair_count long, encrypted boolean, runs long, chars long, filters array<string>",
    "xref_entries": "file_id string, obj_num long, type int, offset long, gen int, container long, idx int, section_seq int",
    "objects": "file_id string, obj_num long, kind string, subtype string, stored int, value string",
    "object_edges": "file_id string, src long, path string, dst_num long, dst_gen int",
    "streams": "file_id string, obj_num long, filters array<string>, raw_len long, data binary, image_codec string",
    "pages": f"file_id string, page_index int, obj_num long, depth int, ord array<int>, media_box {BOX}, crop_box {BOX}, rotate int",
    "content_ops": "file_id string, page_index int, op_seq int, op string, operands string, inline_image binary",
    "fonts": "file_id string, page_index int, font_name string, subtype string, base_font string, first_char int, default_width double, has_to_unicode boolean, to_unicode_size int, mapped_codes array<int>",
    "font_codes": "file_id string, page_index int, font_name string, code int, width double, text string",
    "text_runs": f"file_id string, page_index int, run_seq int, text string, x double, y double, width double, height double, angle double, font_name string, font_size double, ctm {MATRIX}, glyphs array<struct<start:int,x:double,y:double,width:double>>",
    "page_text": "file_id string, page_index int, text string, runs long",
    "page_lines": "file_id string, page_index int, text string, runs long",
    "outline": "file_id string, path array<int>, title string, page_index int, depth int",
    "page_labels": "file_id string, from_index int, style string, prefix string, start int",
    "repairs": "file_id string, seq int, code string, detail string",
    "info": "file_id string, key string, value string",
}
_RUN = SCHEMAS["text_runs"].removeprefix("file_id string, page_index int, ")
#: A page's text and its runs in one row, so that nothing has to gather them; ``text_runs`` and ``page_text`` can be told from it. Pages that show nothing have no runs.
SCHEMAS["page_runs"] = f"file_id string, page_index int, text string, runs array<struct<{_RUN}>>"
#: Tables with large values, which are saved by a parse of their own.
_WIDE = ("page_runs", "text_runs", "streams")
#: Rows of a table that are held before they leave as one Arrow batch.
_ROWS = 4096


def to_json(value: Any) -> str:
    """A value as JSON: names as "/Name", strings as "(text)", references as {"ref": [num, gen]}, streams as their dictionary."""
    def plain(v: Any) -> Any:
        if isinstance(v, Name):
            return "/" + v
        if isinstance(v, Keyword):
            return v.decode("latin-1")
        if isinstance(v, bytes):
            return "(" + text(v) + ")"
        if isinstance(v, Ref):
            return {"ref": list(v)}
        if isinstance(v, Stream):
            return {k: plain(x) for k, x in v.dict.items()}
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    return json.dumps(plain(value), ensure_ascii=False)


def _edges(value: Any, path: str = "$") -> Iterator[tuple[str, Ref]]:
    if isinstance(value, Ref):
        yield path, value
    elif isinstance(value, Stream):
        yield from _edges(value.dict, path)
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _edges(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _edges(v, f"{path}[{i}]")


def _rect(value: Any) -> dict[str, float] | None:
    found = box(value)
    return dict(zip(("x0", "y0", "x1", "y1"), found)) if found else None


def _files(pdf: PdfFile) -> Iterator[tuple]:
    count = pdf.dict(pdf.catalog.get("Pages")).get("Count")
    pages = len(pdf.pages())
    yield (len(pdf.data), pdf.version, pdf.startxref, pdf.size, pdf.encrypted, pdf.encryption_filter, pdf.sections, len(pdf.entries), pages, int(count) if isinstance(count, (int, float)) else None, len(pdf.repairs))


def _file_facts(pdf: PdfFile) -> Iterator[tuple]:
    """What one look at a file tells for ``operators.pages.facts``."""
    (_, version, _, _, encrypted, _, sections, objects, pages, _, repairs), cache = next(_files(pdf)), {}
    filters = sorted({f for n in pdf.numbers() if isinstance(s := pdf.get(n), Stream) for f in pdf.filters_of(s)})
    texts = [t for _, p in _with_text(pdf) for t in shown(operations(pdf.contents(p)), PageFonts(pdf, p, cache))]
    yield (version, sections, objects, pages, repairs, encrypted, len(texts), sum(map(len, texts)), filters)


def _pages(pdf: PdfFile) -> Iterator[tuple]:
    for i, p in _wanted(pdf):
        media = _rect(p.inherited.get("MediaBox")) or dict(x0=0.0, y0=0.0, x1=612.0, y1=792.0)
        yield (i, p.num, len(p.order), list(p.order), media, _rect(p.inherited.get("CropBox")) or media, quarter_turn(p.inherited.get("Rotate")))


def _objects(pdf: PdfFile) -> Iterator[tuple]:
    for n in sorted(pdf.entries):
        value = pdf.get(n)
        yield (n, *kind_of(value), pdf.entries[n].type, to_json(value))


def _streams(pdf: PdfFile) -> Iterator[tuple]:
    for n in pdf.numbers():
        value = pdf.get(n)
        if isinstance(value, Stream):
            data, codec = pdf.stream_data(n, value)
            yield (n, pdf.filters_of(value), len(value.raw), data, codec)


def _wanted(pdf: PdfFile) -> list[tuple[int, Page]]:
    """Pages with their places; a reader may want some of them alone."""
    wanted = getattr(pdf, "wanted", None)
    return [(i, p) for i, p in enumerate(pdf.pages()) if wanted is None or wanted(i)]


def _with_text(pdf: PdfFile) -> list[tuple[int, Page]]:
    return [] if pdf.encrypted else _wanted(pdf)


def _ops(pdf: PdfFile) -> Iterator[tuple]:
    for i, p in _with_text(pdf):
        for k, op in enumerate(operations(pdf.contents(p))):
            yield (i, k, op.op, to_json(op.operands), op.inline_image)


def _fonts(pdf: PdfFile) -> Iterator[tuple]:
    cache: dict = {}
    for i, p in _with_text(pdf):
        fonts = PageFonts(pdf, p, cache)
        for key in fonts.names():
            if f := fonts.get(key):
                yield (i, key, f.subtype, f.base_font, f.first_char, f.default_width, bool(f.to_unicode), len(f.to_unicode), f.mapped_codes())


def _font_codes(pdf: PdfFile) -> Iterator[tuple]:
    cache: dict = {}
    for i, p in _with_text(pdf):
        fonts = PageFonts(pdf, p, cache)
        for key in fonts.names():
            if f := fonts.get(key):
                for code in f.mapped_codes():
                    yield (i, key, code, f.width(code), f.text(code))


def _info(pdf: PdfFile) -> Iterator[tuple]:
    for k, v in pdf.info.items():
        v = pdf.resolve(v)
        yield (k, text(v) if isinstance(v, bytes) else to_json(v))


def _repairs(pdf: PdfFile) -> Iterator[tuple]:
    list(_streams(pdf))  # damage shows when things are read
    for p in pdf.pages():
        pdf.contents(p)
    for i, (code, detail) in enumerate(pdf.repairs):
        yield (i, code, detail)


_ROWS_OF: dict[str, Callable[[PdfFile], Iterator[tuple]]] = {
    "files": _files,
    "file_facts": _file_facts,
    "xref_entries": lambda p: ((n, e.type, e.offset, e.gen, e.container, e.index, e.section) for n, e in sorted(p.entries.items())),
    "objects": _objects,
    "object_edges": lambda p: ((n, path, r.num, r.gen) for n in p.numbers() for path, r in _edges(p.get(n))),
    "streams": _streams,
    "pages": _pages,
    "content_ops": _ops,
    "fonts": _fonts,
    "font_codes": _font_codes,
    "outline": lambda p: ((list(path), title, page, len(path) - 1) for path, title, page in p.outline(p.pages())),
    "page_labels": lambda p: iter(p.page_labels()),
    "repairs": _repairs,
    "info": _info,
}


_VARIANTS = {"objects": "value", "content_ops": "operands"}


class _Rows:
    """Rows of one table, handed over in batches of a bounded size."""

    def __init__(self, kind: str, schema: pa.Schema):
        self.kind, self.schema = kind, schema
        self.held: list[tuple] = []
        self.size = 0

    def add(self, file_id: str, pdf: PdfFile) -> Iterator[pa.RecordBatch]:
        for row in _ROWS_OF[self.kind](pdf):
            self.held.append((file_id, *row))
            self.size += len(row[3]) if self.kind == "streams" else 0
            if len(self.held) >= _ROWS or self.size > 32 << 20:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield _batch(self.held, self.schema)
        self.held, self.size = [], 0


class _Runs(_Rows):
    """Text runs, counted by their glyphs."""

    def add(self, file_id: str, pdf: PdfFile) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for i, page in _with_text(pdf):
            for seq, r in enumerate(runs(operations(pdf.contents(page)), PageFonts(pdf, page, cache))):
                self.held.append((file_id, i, seq, r))
                self.size += len(r.xs)
                if self.size > 200_000 or len(self.held) >= 4 * _ROWS:
                    yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield _run_batch(self.held, self.schema)
        self.held, self.size = [], 0


class _PageRuns(_Runs):
    """The runs of each page in one row; pages that show nothing have an empty list. With a ``having``, pages whose texts it refuses are left out."""

    def __init__(self, kind: str, schema: pa.Schema, having: Callable[[str], bool] | None = None):
        super().__init__(kind, schema)
        self.having, self.paged = having, []

    def add(self, file_id: str, pdf: PdfFile) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for i, page in _with_text(pdf):
            ops, fonts = operations(pdf.contents(page)), PageFonts(pdf, page, cache)
            if self.having is not None and not self.having("".join(shown(ops, fonts))):
                continue
            self.paged.append((file_id, i, len(self.held)))
            for seq, r in enumerate(runs(ops, fonts)):
                self.held.append((file_id, i, seq, r))
                self.size += len(r.xs)
            if self.size > 200_000 or len(self.held) + len(self.paged) >= 4 * _ROWS:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.paged:
            ids, places, first = zip(*self.paged)
            bounds = [*first, len(self.held)]
            text = pa.array(["".join(h[3].text for h in self.held[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string())
            head = [pa.array(ids, pa.string()), pa.array(places, pa.int32()), text]
            flat = pa.schema([*list(self.schema)[:2], *self.schema.field("runs").type.value_type])
            own = _run_batch(self.held, flat) if self.held else pa.RecordBatch.from_pylist([], flat)
            each = pa.StructArray.from_arrays(own.columns[2:], own.schema.names[2:])
            yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each).cast(self.schema.field("runs").type)], schema=self.schema)
        self.held, self.paged, self.size = [], [], 0


class _Texts(_Rows):
    """Texts of pages, without places of glyphs; ``page_lines`` has all pages, ``page_text`` those that show some."""

    def add(self, file_id: str, pdf: PdfFile) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for i, page in _wanted(pdf) if self.kind == "page_lines" else _with_text(pdf):
            found = [] if pdf.encrypted else shown(operations(pdf.contents(page)), PageFonts(pdf, page, cache))
            if found or self.kind == "page_lines":
                self.held.append((file_id, i, "".join(found), len(found)))
                self.size += len(self.held[-1][2])
                if self.size > 4 << 20 or len(self.held) >= 4 * _ROWS:
                    yield from self.rest()


_HOLDERS: dict[str, type[_Rows]] = {"text_runs": _Runs, "page_runs": _PageRuns, "page_text": _Texts, "page_lines": _Texts}


def _parsed(kinds: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, pa.RecordBatch]]]:
    """Batches of the tables ``kinds``, each file being parsed once."""
    schemas = {k: to_arrow_schema(T.StructType.fromDDL(SCHEMAS[k])) for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        tables = {k: _HOLDERS.get(k, _Rows)(k, x) for k, x in schemas.items()}
        for b in batches:
            for file_id, content in zip(b.column("file_id").to_pylist(), b.column("content")):
                data = content.as_py()
                if data:
                    pdf = PdfFile(data)
                    for k, t in tables.items():
                        yield from ((k, out) for out in t.add(file_id, pdf))
        for k, t in tables.items():
            yield from ((k, out) for out in t.rest())

    return run


def to_batches(kind: str, schema: pa.Schema, files: Iterator[tuple[str, PdfFile]]) -> Iterator[pa.RecordBatch]:
    """Rows of one table for (file_id, file)."""
    rows = _HOLDERS.get(kind, _Rows)(kind, schema)
    for file_id, pdf in files:
        yield from rows.add(file_id, pdf)
    yield from rows.rest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _run_batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    rs = [h[3] for h in held]
    column = lambda get, kind: pa.array([get(r) for r in rs], kind)
    ctm = pa.StructArray.from_arrays([column(lambda r, k=k: r.ctm[k], pa.float64()) for k in range(6)], list("abcdef"))
    flat = [pa.array(np.concatenate([r.starts for r in rs]).astype(np.int32)), *[pa.array(np.concatenate([getattr(r, k) for r in rs])) for k in ("xs", "ys", "widths")]]
    glyph = pa.StructArray.from_arrays(flat, ["start", "x", "y", "width"])
    offsets = np.concatenate(([0], np.cumsum([len(r.xs) for r in rs]))).astype(np.int32)
    arrays = [
        pa.array([h[0] for h in held]), pa.array([h[1] for h in held], pa.int32()), pa.array([h[2] for h in held], pa.int32()), column(lambda r: r.text, pa.string()),
        *[column(lambda r, k=k: float(getattr(r, k)), pa.float64()) for k in ("x", "y", "width", "height", "angle")],
        column(lambda r: r.font_name, pa.string()), column(lambda r: float(r.font_size), pa.float64()), ctm, pa.ListArray.from_arrays(pa.array(offsets), glyph),
    ]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


class PdfCorpus:
    """Tables over files given as (file_id, content), or over tables that were saved.

    ``objects.value`` and ``content_ops.operands`` are VARIANT; ``text_runs`` are in user space.
    """

    def __init__(self, contents: DataFrame, tables: dict[str, DataFrame] | None = None):
        self.contents, self._tables, self._given = contents, dict(tables or {}), frozenset(tables or ())

    def table(self, kind: str) -> DataFrame:
        """A table of ``SCHEMAS``; ``page_text`` is the text of each page that has any, its runs in order without separators; ``page_lines`` has the other pages too."""
        if kind not in self._tables and (told := self._told(kind)) is not None:
            self._tables[kind] = told
        if kind not in self._tables:
            parsed = _parsed([kind])
            out = self.contents.select("file_id", "content").mapInArrow(lambda batches: (b for _, b in parsed(batches)), SCHEMAS[kind])
            variant = _VARIANTS.get(kind)
            self._tables[kind] = out.withColumn(variant, F.parse_json(variant)) if variant else out
        return self._tables[kind]

    def _told(self, kind: str) -> DataFrame | None:
        """A table that follows from one that was saved."""
        pages, runs_ = (self._tables[k] if self.saved(k) else None for k in ("page_runs", "text_runs"))
        if kind == "text_runs" and pages is not None:
            return pages.select("file_id", "page_index", F.inline("runs"))
        if kind == "page_text" and pages is not None:
            return pages.where("text <> ''").select("file_id", "page_index", "text", F.size("runs").cast("long").alias("runs"))
        if kind in ("page_text", "page_runs") and runs_ is not None:
            fields = ["run_seq", "text"] if kind == "page_text" else runs_.columns[2:]
            ordered = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["run_seq"] - b["run_seq"])
            grouped = runs_.groupBy("file_id", "page_index").agg(ordered.alias("runs"))
            text = F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text")
            return grouped.select("file_id", "page_index", text, F.size("runs").cast("long").alias("runs") if kind == "page_text" else "runs")
        return None

    def saved(self, kind: str) -> bool:
        """Whether a table is read from files, without parsing."""
        return kind in self._given

    def page_runs_with(self, needle: str, case_sensitive: bool = False) -> DataFrame:
        """``page_runs`` without pages that can't have a needle; places of glyphs are told for the others alone. Saved ones are as they are."""
        if self.saved("page_runs") or not needle:
            return self.page_runs
        schema = to_arrow_schema(T.StructType.fromDDL(SCHEMAS["page_runs"]))
        low = needle.lower()

        def having(text: str) -> bool:
            # letters past Latin-1 are left to Spark, which may fold them in another way
            return needle in text if case_sensitive else low in text.lower() or not text.isascii() and max(text) > "\xff"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _PageRuns("page_runs", schema, having)
            for b in batches:
                for file_id, content in zip(b.column("file_id").to_pylist(), b.column("content")):
                    if data := content.as_py():
                        yield from rows.add(file_id, PdfFile(data))
            yield from rows.rest()

        return self.contents.select("file_id", "content").mapInArrow(run, SCHEMAS["page_runs"])

    def __getattr__(self, kind: str) -> DataFrame:
        if kind in SCHEMAS:
            return self.table(kind)
        raise AttributeError(kind)

    def search(self, query: str, **options) -> DataFrame:
        """``operators.search.search`` over this corpus."""
        from ..operators.search import search

        return search(self, query, **options)

    def inventory(self) -> DataFrame:
        from ..operators.pages import inventory

        return inventory(self)

    def facts(self) -> DataFrame:
        from ..operators.pages import facts

        return facts(self)

    def edit(self, edits: DataFrame, incremental: bool = True, compress: bool = False) -> DataFrame:
        from ..operators.edit import edit

        return edit(self, edits, incremental, compress)

    def save(self, incremental: bool = False, compress: bool = False) -> DataFrame:
        from ..operators.edit import save

        return save(self, incremental, compress)

    def save_tables(self, path: str, kinds: list[str] | None = None) -> PdfCorpus:
        """Write tables as Parquet below ``path`` and read them from there.

        Narrow tables come from one parse of each file; those with large values or VARIANT columns from one each. ``text_runs`` and ``page_text`` are saved as
        ``page_runs``, from which they follow.
        """
        spark, tables = self.contents.sparkSession, {}
        kinds = list(dict.fromkeys("page_runs" if k in ("text_runs", "page_text") else k for k in kinds or SCHEMAS))
        together = [k for k in kinds if k not in _VARIANTS and k not in _WIDE and k not in self._tables]
        if len(together) > 1:
            self._save_together(f"{path}/parsed", together)
            tables = {k: spark.read.schema(f"`{k}` struct<{_struct(k)}>").parquet(f"{path}/parsed/kind={k}").select(f"{k}.*") for k in together}
        for kind in kinds:
            if kind not in tables:
                self.table(kind).write.mode("overwrite").parquet(f"{path}/{kind}")
                tables[kind] = spark.read.parquet(f"{path}/{kind}")
        kept = {k: t for k, t in self._tables.items() if k in tables}
        return PdfCorpus(self.contents, {**kept, **tables})

    def _save_together(self, path: str, kinds: list[str]) -> None:
        """One folder of Parquet files for each table, its rows as a struct of that name."""
        spark, parsed = self.contents.sparkSession, _parsed(kinds)
        schema = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(k, T.StructType.fromDDL(SCHEMAS[k])) for k in kinds]])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for kind, b in parsed(batches):
                columns = [pa.array([kind] * b.num_rows), *[b.to_struct_array().cast(f.type) if f.name == kind else pa.nulls(b.num_rows, f.type) for f in list(arrow)[1:]]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        writers = "spark.sql.maxConcurrentOutputFileWriters"  # one open file for each table, in place of a sort
        before = spark.conf.get(writers, "0")
        spark.conf.set(writers, str(len(kinds) + 1))
        try:
            self.contents.select("file_id", "content").mapInArrow(run, schema).write.mode("overwrite").partitionBy("kind").parquet(path)
        finally:
            spark.conf.set(writers, before)
        # a table without a row has no folder yet
        for k in kinds:
            empty = spark.createDataFrame([], schema).where(F.lit(False)).select(k)
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={k}")
            if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
                empty.write.parquet(f"{path}/kind={k}")


def _struct(kind: str) -> str:
    return T.StructType.fromDDL(SCHEMAS[kind]).simpleString().removeprefix("struct<").removesuffix(">")


def read_pdf(spark: SparkSession, path: str, pattern: str = "*.pdf", min_bytes: int = 8) -> PdfCorpus:
    """All PDF files below ``path``; what is shorter than ``min_bytes`` is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return PdfCorpus(few_tasks(files).where(F.col("length") >= min_bytes).select(F.col("path").alias("file_id"), "content"))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def read_folders(spark: SparkSession, path: str, rows: Callable[[PdfCorpus], DataFrame], out: str) -> DataFrame:
    """``rows`` of the files of each folder in ``path``, one folder after another.

    Spark's reader holds the list of all files that it reads on the driver; here it is that of one folder at a time. Rows are written below ``out``, a folder that all executors reach.
    """
    names = folders(spark, path)
    if not names:
        return rows(read_pdf(spark, path))
    for name in names:
        rows(read_pdf(spark, f"{path}/{name}")).write.mode("overwrite").parquet(f"{out}/{name}")
    return spark.read.parquet(*[f"{out}/{name}" for name in names])


def few_tasks(files: DataFrame) -> DataFrame:
    """Rows of ``binaryFile`` in fewer tasks: Spark counts 4 MB for opening a file, so many small ones make a task of some thirty."""
    n, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(4 * cores, n // 32)) if n > 4 * cores else files


def native_version(content: F.Column) -> F.Column:
    """The header's version from the first 1024 bytes, without Python."""
    found = F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"%PDF-(\d+\.\d+)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def native_startxref(content: F.Column) -> F.Column:
    """The last ``startxref`` offset of the final 2048 bytes, or -1, without Python."""
    tail = F.decode(F.substring(content, F.greatest(F.octet_length(content) - 2047, F.lit(1)), F.lit(2048)), "ISO-8859-1")
    found = F.regexp_extract_all(tail, F.lit(r"startxref[\x00\t\n\x0c\r ]*(\d+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("long"), F.lit(-1).cast("long"))


__all__ = ["PdfCorpus", "SCHEMAS", "folders", "native_startxref", "native_version", "read_folders", "read_pdf", "to_json"]
