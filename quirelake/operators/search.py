"""Text search over pages, with a rectangle for each line that a match touches.

Everything is column expressions over ``page_runs``, which has a page's text and its runs in one row, so no shuffle gathers them. Matches take the
glyphs that they touch; only these meet the page's matrix, and rectangles are folded from them in the same row.
Offsets count code points of the page's text, which is its runs without separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.pdf import PdfCorpus
from . import graph

LIMIT = 2000
#: Pages that are sent to where their runs are read; more of them meet matches, or texts, by a shuffle.
FEW_PAGES = 200_000
#: Pages whose files are named in the filter of the scan.
FEW_FILES = 500
#: From this length on a needle without an index is looked for in texts first, so that glyphs are read for pages that have it.
RARE = 5
_BLOCK = 64
_WORD = r"[\p{L}\p{N}_]"


def runs_in(corpus: PdfCorpus, space: str = "screen", scale: float = 1.0) -> DataFrame:
    """``text_runs`` in user space (``page``), or as a viewer shows them (``screen``, y grows down)."""
    runs = corpus.text_runs
    if space == "page":
        return runs
    if space != "screen":
        raise ValueError("space is page or screen")
    return _placed(corpus, runs, scale)


def _placed(corpus: PdfCorpus, runs: DataFrame, scale: float) -> DataFrame:
    shown = corpus.pages.select("file_id", "page_index", g.display(F.col("crop_box"), F.col("rotate"), scale)["matrix"].alias("m"))
    m = F.col("m")
    at = g.apply(m, F.col("x"), F.col("y"))
    dx, dy = F.cos("angle"), F.sin("angle")
    turned = F.atan2(m["b"] * dx + m["d"] * dy, m["a"] * dx + m["c"] * dy)
    glyphs = F.transform("glyphs", lambda b: F.struct(b["start"].alias("start"), g.apply(m, b["x"], b["y"])["x"].alias("x"), g.apply(m, b["x"], b["y"])["y"].alias("y"), (b["width"] * scale).alias("width")))
    made = {"x": at["x"], "y": at["y"], "width": F.col("width") * scale, "height": F.col("height") * scale, "angle": F.when(F.col("width") == 0, F.lit(0.0)).otherwise(turned), "ctm": g.concat(F.col("ctm"), m), "glyphs": glyphs}
    return runs.join(shown, ["file_id", "page_index"]).select(*[made.get(c, F.col(c)).alias(c) for c in runs.columns])


def _quoted(needle: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in needle)


def starts(haystack: Column, needle: str) -> Column:
    """Offsets of matches that don't overlap, from the left."""
    pieces = F.split(haystack, _quoted(needle), -1)
    step = lambda acc, p: F.struct((acc["at"] + F.char_length(p) + len(needle)).alias("at"), F.array_append(acc["out"], acc["at"] + F.char_length(p)).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.slice(F.aggregate(pieces, begin, step, lambda acc: acc["out"]), F.lit(1), F.size(pieces) - 1)


def find(pages: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Matches in rows (file_id, page_index, text): start, end, text.

    Whole words are picked after matches: a match that is none still uses up its characters.
    """
    keep = keep or []
    needle = query if case_sensitive else query.lower()
    fields = ["file_id", "page_index", *keep]
    if not needle:
        return pages.select(*fields, F.lit(0).alias("start"), F.lit(0).alias("end"), "text").where("false")
    hay = F.col("text") if case_sensitive else F.lower("text")
    found = pages.where(F.contains(hay, F.lit(needle))).select(*fields, "text", F.explode(starts(hay, needle)).alias("start"))
    found = found.withColumn("end", F.col("start") + len(needle))
    if whole_word:
        before = F.when(F.col("start") > 0, F.substring("text", F.col("start"), F.lit(1))).otherwise("")
        after = F.substring("text", F.col("end") + 1, F.lit(1))
        found = found.where(~before.rlike(_WORD) & ~after.rlike(_WORD))
    return found.select(*fields, "start", "end", F.substring("text", F.col("start") + 1, F.lit(len(needle))).alias("text"))


def _touched(run: Column, start: Column, end: Column) -> Column:
    """Height of a run and the glyphs of it that a range covers: a slice where each character has a glyph of its own."""
    first = F.greatest(start, F.lit(0))
    cut = F.slice(run["glyphs"], first + 1, F.greatest(F.least(end, run["stop"] - run["at"]) - first, F.lit(0)))
    some = F.filter(run["glyphs"], lambda b: (b["start"] + 1 > start) & (b["start"] < end))
    return F.struct(run["height"].alias("height"), F.when(run["plain"], cut).otherwise(some).alias("glyphs"))


def _rects(run: Column, y_down: bool, m: Column | None = None, scale: float = 1.0) -> Column:
    """Boxes of touched glyphs, as the matrix ``m`` shows them, merged along a line."""
    tall = F.greatest(F.lit(1.0), run["height"] * scale)
    up, down = tall * 0.78, tall * 0.22

    def boxed(b: Column) -> Column:
        at = b if m is None else g.apply(m, b["x"], b["y"])
        low, high = (at["y"] - up, at["y"] + down) if y_down else (at["y"] - down, at["y"] + up)
        return F.struct(at["x"].alias("x0"), low.alias("y0"), (at["x"] + b["width"] * scale).alias("x1"), high.alias("y1"))

    def merge(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = last.isNotNull() & (F.abs(last["y0"] - b["y0"]) < 0.6) & (F.abs(last["y1"] - b["y1"]) < 0.6) & (b["x0"] <= last["x1"] + tall * 0.6)
        joined = F.struct(last["x0"].alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(same, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, b))

    empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    merged = F.aggregate(F.transform(run["glyphs"], boxed), empty, merge)
    return F.transform(merged, lambda r: g.rect(r["x0"], r["y0"], r["x1"], r["y1"]))


def _hits(hay: Column, needle: str, whole_word: bool) -> Column:
    """Matches of a page in its own row: start, end, text and the runs with the glyphs that each touches."""
    text, size = F.col("text"), len(needle)
    step = lambda acc, r: F.struct((acc["at"] + F.char_length(r["text"])).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate("runs", begin, step, lambda acc: acc["out"])
    plain = lambda r: r["glyphs"]["start"] == F.sequence(F.lit(0), F.greatest(F.char_length(r["text"]) - 1, F.lit(0)))
    laid = F.zip_with("runs", offsets, lambda r, o: F.struct(o.alias("at"), (o + F.char_length(r["text"])).alias("stop"), plain(r).alias("plain"), r["height"].alias("height"), r["glyphs"].alias("glyphs")))
    # blocks of runs, so that a match looks at few of a long page
    many = lambda runs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(runs), F.lit(1)), F.lit(_BLOCK)), lambda i: F.slice(runs, i, F.lit(_BLOCK)))
    near = lambda r, s: (r["stop"] > s) & (r["at"] < s + size)
    at = starts(hay, needle)
    if whole_word:
        before = lambda s: F.when(s > 0, F.substring(text, s, F.lit(1))).otherwise("")
        at = F.filter(at, lambda s: ~before(s).rlike(_WORD) & ~F.substring(text, s + size + 1, F.lit(1)).rlike(_WORD))

    def hit(blocks: Column, s: Column) -> Column:
        some = F.filter(blocks, lambda b: (F.element_at(b, -1)["stop"] > s) & (F.element_at(b, 1)["at"] < s + size))
        met = F.flatten(F.transform(some, lambda b: F.filter(b, lambda r: near(r, s))))
        spans = F.filter(F.transform(met, lambda r: _touched(r, s - r["at"], s + size - r["at"])), lambda r: F.size(r["glyphs"]) > 0)
        return F.struct(s.alias("start"), (s + size).alias("end"), F.substring(text, s + 1, F.lit(size)).alias("text"), spans.alias("spans"))

    # arrays of one, so that the runs are laid out once for all matches
    told = F.transform(F.transform(F.array(laid), many), lambda blocks: F.transform(at, lambda s: hit(blocks, s)))
    return F.filter(F.element_at(told, 1), lambda h: F.size(h["spans"]) > 0)


def _first_pages(texts: DataFrame, query: str, case_sensitive: bool, whole_word: bool, limit: int | None) -> DataFrame:
    """Pages with the needle, by their texts alone; with a limit only those of a file where matches before the page haven't reached it."""
    needle = query if case_sensitive else query.lower()
    hit = texts.where(F.contains(F.col("text") if case_sensitive else F.lower("text"), F.lit(needle)))
    if limit is None:
        return hit.select("file_id", "page_index")
    if whole_word:
        n = find(hit.select("file_id", "page_index", "text"), query, case_sensitive, True).groupBy("file_id", "page_index").agg(F.count("*").alias("n"))
    else:
        n = hit.select("file_id", "page_index", F.size(starts(F.col("text") if case_sensitive else F.lower("text"), needle)).alias("n"))
    before = Window.partitionBy("file_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < limit).select("file_id", "page_index")


def _kept(pages: DataFrame) -> tuple[DataFrame, int]:
    """Pages, computed once, and their number up to ``FEW_PAGES`` + 1."""
    graph.shared_folder(pages.sparkSession)
    pages = pages.checkpoint()
    return pages, pages.limit(FEW_PAGES + 1).count()


def _on(df: DataFrame, pages: DataFrame, count: int) -> DataFrame:
    """Rows of ``df`` on these pages; where the pages are of few files, the files are a filter of the scan."""
    if count <= FEW_FILES:
        df = df.where(F.col("file_id").isin([r[0] for r in pages.select("file_id").distinct().collect()]))
    return df.join(F.broadcast(pages) if count <= FEW_PAGES else pages, ["file_id", "page_index"], "left_semi")


def _picked(corpus: PdfCorpus, query: str, case_sensitive: bool, whole_word: bool, limit: int | None, index) -> tuple[DataFrame, DataFrame | None]:
    """``page_runs`` where a query is looked for, and the pages that its matches still have to be on.

    Few pages are sent to where runs are read, or their files to where they are parsed. Runs with their glyphs never meet many pages by a shuffle: only matches do, and where pages just spare work none.
    """
    if index is not None:
        listed, n_listed = _kept(index.candidates(query, case_sensitive))
    if not corpus.saved("page_runs"):
        if index is None:
            return corpus.page_runs_with(query, case_sensitive), None
        if n_listed > FEW_PAGES:
            return corpus.page_runs_with(query, case_sensitive), listed
        own = corpus.contents.join(F.broadcast(listed.select("file_id").distinct()), "file_id", "left_semi")
        return _on(PdfCorpus(own).page_runs_with(query, case_sensitive), listed, n_listed), None
    texts = corpus.page_text if index is None else _on(corpus.page_text, listed, n_listed)
    if limit is None and index is None and len(query) < RARE:
        return corpus.page_runs, None
    first, n = _kept(_first_pages(texts, query, case_sensitive, whole_word, limit))
    if n <= FEW_PAGES:
        return _on(corpus.page_runs, first, n), None
    return corpus.page_runs, first if index is not None else None


def search(corpus: PdfCorpus, query: str, case_sensitive: bool = False, whole_word: bool = False, limit: int | None = LIMIT, space: str = "screen", scale: float = 1.0, limit_per_file: bool = True, index=None) -> DataFrame:
    """Matches in reading order: file_id, page_index, start, end, text, rects, truncated.

    ``limit`` holds for each file, or for all of them; truncated says that it was reached. Where ``page_runs`` was saved, glyphs are read for the pages alone that
    their text (or ``index``, a ``search_index.SearchIndex``) picks, and with a limit for none behind those that reach it, unless pages are many (``FEW_PAGES``); otherwise files are parsed once,
    with an index only those of few pages that it finds, and places of glyphs are told for pages alone that have the query.
    """
    if space not in ("page", "screen"):
        raise ValueError("space is page or screen")
    needle = query if case_sensitive else query.lower()
    paged, pages = _picked(corpus, query, case_sensitive, whole_word, limit if limit_per_file else None, index) if needle else (corpus.page_runs, None)
    hay = F.col("text") if case_sensitive else F.lower("text")
    hits = _hits(hay, needle, whole_word)
    # an array ends where the limit does, and only matches with the glyphs that they touch leave the page's row
    found = paged.where(F.contains(hay, F.lit(needle)) & F.lit(needle != "")).select("file_id", "page_index", F.inline(F.slice(hits, 1, limit) if limit is not None else hits))
    if space == "page":  # rectangles are smaller than the glyphs that they hold, and are what is sorted
        found = found.select("file_id", "page_index", "start", "end", "text", F.flatten(F.transform("spans", lambda s: _rects(s, False))).alias("rects"))
    if pages is not None:
        found = found.join(pages, ["file_id", "page_index"], "left_semi")
    if limit is not None:
        found = limited(found, limit, limit_per_file)
    else:
        found = found.withColumn("truncated", F.lit(False))
    if space == "screen":
        shown = corpus.pages.select("file_id", "page_index", g.display(F.col("crop_box"), F.col("rotate"), scale)["matrix"].alias("m"))
        found, m = found.join(shown, ["file_id", "page_index"]), F.col("m")
        rects = F.flatten(F.transform("spans", lambda s: _rects(s, True, m, scale)))
        found = found.withColumn("rects", rects)
    return found.select("file_id", "page_index", "start", "end", "text", "rects", "truncated")


def limited(matches: DataFrame, limit: int, per_file: bool = True) -> DataFrame:
    """The first matches in reading order, of each file or of all."""
    if not per_file:
        first = matches.orderBy("file_id", "page_index", "start").limit(limit)
        return first.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) >= limit)
    by = Window.partitionBy("file_id")
    ranked = matches.withColumn("_k", F.row_number().over(by.orderBy("page_index", "start"))).where(F.col("_k") <= limit)
    return ranked.withColumn("truncated", F.max("_k").over(by) >= limit).drop("_k")


def search_app(corpus: PdfCorpus, query: str, **options) -> DataFrame:
    """What a search box runs: the query trimmed, nothing below two characters."""
    query = query.strip()
    return search(corpus, query if len(query) >= 2 else "", **options)


def snippets(matches: DataFrame, page_text: DataFrame, width: int = 34, first: int = 300) -> DataFrame:
    """Listed hits: ``width`` characters on both sides, the first hits of each file, and how many more there are."""
    by = Window.partitionBy("file_id")
    ranked = matches.withColumn("hit", F.row_number().over(by.orderBy("page_index", "start"))).withColumn("more", F.greatest(F.count("*").over(by) - first, F.lit(0)))
    pages = page_text.select("file_id", "page_index", F.col("text").alias("page"))
    out = ranked.where(F.col("hit") <= first).join(pages, ["file_id", "page_index"])
    begin = F.greatest(F.col("start") - width, F.lit(0))
    before = F.when(F.col("start") > 0, F.substring("page", begin + 1, F.col("start") - begin)).otherwise("")
    return out.select("file_id", "page_index", "hit", "start", before.alias("before"), "text", F.substring("page", F.col("end") + 1, F.lit(width)).alias("after"), "more")


def step_match(matches: DataFrame, delta: int = 1) -> DataFrame:
    """For each match of a file, the number of the next (or previous) one, with wrap; -1 is for files without any."""
    by = Window.partitionBy("file_id")
    k = F.row_number().over(by.orderBy("page_index", "start")) - 1
    out = matches.withColumn("match", k).withColumn("n", F.count("*").over(by))
    to = F.col("match") + delta
    return out.withColumn("to", F.when(to < 0, F.col("n") - 1).when(to >= F.col("n"), F.lit(0)).otherwise(to)).drop("n")


def on_pages(matches: DataFrame, current: int = 0) -> DataFrame:
    """The matches of each page in order (``rects``), and which of them is match ``current`` of its file: file_id, page_index, rects, current_at, -1 where none is."""
    by = Window.partitionBy("file_id").orderBy("page_index", "start")
    numbered = matches.withColumn("_k", F.row_number().over(by) - 1)
    listed = numbered.groupBy("file_id", "page_index").agg(F.min("_k").alias("_first"), F.array_sort(F.collect_list(F.struct("start", "rects"))).alias("m"))
    at = F.lit(current) - F.col("_first")
    return listed.select("file_id", "page_index", F.transform("m", lambda x: x["rects"]).alias("rects"), F.when((at >= 0) & (at < F.size("m")), at).otherwise(-1).cast("int").alias("current_at"))
