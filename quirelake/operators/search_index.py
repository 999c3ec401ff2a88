"""A stored index of page texts: for every three characters the pages that have them.

Postings are lists of pages in blocks of ``BLOCK`` pages, one row a (three characters, block) with how many pages it lists and the first and last of them, sorted by
the characters, so that looking some up reads few row groups. A search compares the narrow columns first and drops blocks where a
list is missing or the ranges don't meet; the lists of the blocks that remain are intersected, shortest first. What is found is every page that can have
the needle, and some others: its text is compared afterwards, by ``search`` as without an index.

Files are added in segments, each with page numbers of its own, so adding reads and rewrites nothing that is there; ``merge`` puts segments together. A page that is indexed again is
found by its newest text as well as by the older ones, and its current text is what is compared.

Cases: pages without text are in no list; needles of two characters are looked up by all lists that begin with them, one character (and no character) finds every page; case
is folded in the index, and searches that heed case look up the folded characters, without those whose folding depends on what is around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph

#: Pages in a block: as many as 15 bits tell apart.
BLOCK_BITS = 15
#: Pages that are named in the filter of a scan of their texts; more of them meet by a join.
FEW = 500
#: Letters whose lower case depends on their place in a word (fixed values of Unicode).
_CONTEXT = "Σσς"
_POSTINGS = "gram string, block long, n int, first int, last int, slots array<int>"
_PAGES = "no long, file_id string, page_index int, text string"


def grams(text: Column) -> Column:
    """Distinct sequences of three characters; the last two of a text also stand alone, and so does the last."""
    c = F.filter(F.split(F.lower(text), ""), lambda x: x != "")
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    return F.array_distinct(joined(joined(c, F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))), F.slice(c, 3, F.greatest(F.size(c), F.lit(1)))))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of slots for each (three characters, block) of pages (no, text), some thousand pages at a time; ``grams`` of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            held: dict[tuple[str, int], list[int]] = {}
            b = batch.slice(at, 2048)
            for no, t in zip(b.column("no").to_pylist(), b.column("text").to_pylist()):
                block, slot = no >> BLOCK_BITS, no & (1 << BLOCK_BITS) - 1
                for gram in {t[i : i + 3] for i in range(len(t or ""))}:
                    held.setdefault((gram, block), []).append(slot)
            lists = list(held.values())
            sizes = pa.array([0, *accumulate(map(len, lists))], pa.int32())
            slots = pa.ListArray.from_arrays(sizes, pa.array([s for x in lists for s in x], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.string()), pa.array([k for _, k in held], pa.int64()), slots], ["gram", "block", "slots"])


class SearchIndex:
    """The index below ``path``, which is a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, page_text: DataFrame, path: str) -> SearchIndex:
        """Index rows (file_id, page_index, text) into an empty folder."""
        out = cls(page_text.sparkSession, path)
        out.add(page_text)
        return out

    def _segments(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return sorted(int(m[1]) for f in files.listStatus(folder) if (m := re.fullmatch(r"segment=(\d+)", f.getPath().getName())))

    def _read(self, what: str, schema: str) -> DataFrame:
        found = self._segments()
        if not found:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        folders = [f"{self.path}/{what}/segment={n}" for n in found]
        return self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.path}/{what}").parquet(*folders)

    @property
    def pages(self) -> DataFrame:
        """Indexed pages: no, file_id, page_index, text, segment."""
        return self._read("pages", _PAGES)

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", _POSTINGS)

    def add(self, page_text: DataFrame) -> int:
        """Index these pages as a new segment; gives its number. Postings are written last: a segment without them isn't there."""
        n = max(self._segments(), default=-1) + 1
        rows = page_text.select(F.monotonically_increasing_id().alias("no"), F.col("file_id").cast("string").alias("file_id"), F.col("page_index").cast("int").alias("page_index"), "text")
        rows.write.mode("overwrite").parquet(f"{self.path}/pages/segment={n}")
        pages = self.spark.read.schema(_PAGES).parquet(f"{self.path}/pages/segment={n}")
        # a task numbers its pages in a row, so most of a list is put together before anything is shuffled
        parts = pages.select("no", F.lower("text").alias("text")).mapInArrow(_lists, "gram string, block long, slots array<int>")
        lists = parts.groupBy("gram", "block").agg(F.sort_array(F.flatten(F.collect_list("slots"))).alias("slots"))
        self._write(lists.select("gram", "block", F.size("slots").alias("n"), F.element_at("slots", 1).alias("first"), F.element_at("slots", -1).alias("last"), "slots"), n)
        return n

    def _write(self, postings: DataFrame, n: int) -> None:
        postings.sortWithinPartitions("gram", "block").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{self.path}/postings/segment={n}")

    def merge(self) -> SearchIndex:
        """Put all segments together in a new one and drop them. Of pages that were indexed more than once the newest text is kept."""
        old = self._segments()
        if len(old) > 1:
            newest = self.pages.groupBy("file_id", "page_index").agg(F.max_by("text", F.struct("segment", "no")).alias("text"))
            self.add(newest)
            for what in ("postings", "pages"):
                for n in old:
                    folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/segment={n}")
                    folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return self

    def slots(self, query: str, case_sensitive: bool = False) -> DataFrame:
        """(segment, no) of the pages that have all the three characters of a query, each once."""
        low = query.lower()
        runs = [x for x in re.split(f"[{_CONTEXT}]", low)] if case_sensitive else [low]
        wanted = sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})
        number = (F.shiftleft("block", BLOCK_BITS) + F.col("slot")).alias("no")
        if not wanted:
            longest = max(runs, key=len)
            if len(longest) < 2:
                return self.pages.select("segment", "no")
            return self.postings.where(F.startswith(F.col("gram"), F.lit(longest))).select("segment", "block", F.explode("slots").alias("slot")).distinct().select("segment", number)
        some = self.postings.where(F.col("gram").isin(wanted))
        met = some.groupBy("segment", "block").agg(F.count("*").alias("k"), F.max("first").alias("lo"), F.min("last").alias("hi"))
        blocks = met.where((F.col("k") == len(wanted)) & (F.col("lo") <= F.col("hi"))).select("segment", "block")
        lists = some.join(blocks, ["segment", "block"], "left_semi").groupBy("segment", "block").agg(F.array_sort(F.collect_list(F.struct("n", "slots"))).alias("lists"))
        both = F.aggregate(F.slice("lists", 2, len(wanted)), F.element_at("lists", 1)["slots"], lambda a, x: F.array_intersect(a, x["slots"]))
        return lists.select("segment", "block", F.explode(both).alias("slot")).select("segment", number)

    def candidates(self, query: str, case_sensitive: bool = False) -> DataFrame:
        """(file_id, page_index) of the pages that can have a query, each once."""
        graph.shared_folder(self.spark)
        found = self.slots(query, case_sensitive).checkpoint()
        pages, few = self.pages, found.limit(FEW + 1).count()
        if few <= FEW:
            pages = pages.where(F.col("no").isin([r["no"] for r in found.select("no").distinct().collect()]))
            found = F.broadcast(found)
        return pages.join(found, ["segment", "no"], "left_semi").select("file_id", "page_index").distinct()
