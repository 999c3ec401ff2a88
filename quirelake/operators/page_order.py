"""Where pages end up after batches of edits, told from page numbers alone, for any number of files at once.

Every edit is a small map of places: an insertion moves what is at or behind it on by one, a removal closes gaps, a move turns a stretch. A file's edits are
brought to a normal form first (places clamped to the pages that there are by then), travel as one array, and each page folds its place over them; pages that
an edit makes begin in the middle of the array. Pages don't wait for each other, so a file of many pages is no task of its own. What a copy is of is found by the
inverse maps from its edit back to the start, and by the other copies on the way.

Work is the number of a file's pages times that of its edits. Cases: edits out of range are clamped or do nothing, as when files are written; files without edits stay as they are; edits of files that
have no pages insert into an empty file; null arguments have the defaults of ``edit``; other operations than insertions, copies, removals and moves change no place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .edit import EDIT_COLUMNS, FEW_EDITS

_STEP = "array<struct<seq:int,kind:string,a:int,b:int,gone:array<int>,source:int>>"


def _normal(edits: DataFrame, counts: DataFrame) -> DataFrame:
    """Each file's edits in order (file_id, steps) with places that exist: i (insert at a), r (remove gone), m (move a to b)."""
    used = ("at", "page", "pages")
    fields = [F.col(c) if c in edits.columns else F.lit(None).cast(EDIT_COLUMNS[c]).alias(c) for c in used]
    listed = edits.where(F.col("op").isin("insert_blank", "insert_copy", "remove", "move")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", *fields)), lambda x, y: (x["seq"] - y["seq"]).cast("int")).alias("edits"))
    listed = listed.join(counts, "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))

    def step(acc: Column, e: Column) -> Column:
        n, op = acc["n"], e["op"]
        at, page = F.coalesce(e["at"], F.lit(0)), F.coalesce(e["page"], F.when(op == "insert_copy", 0).otherwise(-1))
        inside = (page >= 0) & (page < n)
        asked = F.when(F.size(F.coalesce(e["pages"], F.array().cast("array<int>"))) > 0, e["pages"]).otherwise(F.array(page))
        gone = F.array_sort(F.array_distinct(F.filter(asked, lambda p: (p >= 0) & (p < n))))
        to = F.greatest(F.lit(0), F.least(at, n - 1))
        made = F.struct(
            e["seq"].cast("int").alias("seq"), F.when(op == "remove", "r").when(op == "move", F.when(inside & (to != page), "m").otherwise("-")).otherwise("i").alias("kind"),
            F.when(op == "move", page).otherwise(F.greatest(F.lit(0), F.least(at, n))).cast("int").alias("a"), to.cast("int").alias("b"), F.when(op == "remove", gone).alias("gone"), F.when((op == "insert_copy") & inside, page).cast("int").alias("source"),
        )
        left = F.when(op == "remove", n - F.size(gone)).when(op == "move", n).otherwise(n + 1)
        return F.struct(left.cast("int").alias("n"), F.array_append(acc["out"], made).alias("out"))

    begin = F.struct(F.col("n").alias("n"), F.array().cast(_STEP).alias("out"))
    return listed.select("file_id", F.aggregate("edits", begin, step, lambda a: a["out"]).alias("steps"))


def _forward(steps: Column, start: Column) -> Column:
    """The place that ``start`` has after the steps, or -1 once it's removed."""

    def step(at: Column, e: Column) -> Column:
        a, b, kind = e["a"], e["b"], e["kind"]
        shut = F.when(F.array_contains(e["gone"], at), -1).otherwise(at - F.size(F.filter(e["gone"], lambda g: g < at)))
        turned = F.when(at == a, b).when((a < b) & (at > a) & (at <= b), at - 1).when((a > b) & (at >= b) & (at < a), at + 1).otherwise(at)
        return F.when(at < 0, at).when(kind == "i", F.when(at >= a, at + 1).otherwise(at)).when(kind == "r", shut).when(kind == "m", turned).otherwise(at).cast("int")

    return F.aggregate(steps, start.cast("int"), step)


def _backward(steps: Column, start: Column) -> Column:
    """(at, seq): the first place of what is at ``start`` after the steps, or the step that made it."""

    def step(acc: Column, e: Column) -> Column:
        a, b, kind, at = e["a"], e["b"], e["kind"], acc["at"]
        opened = F.aggregate(e["gone"], at, lambda p, g: F.when(p >= g, p + 1).otherwise(p).cast("int"))
        turned = F.when(at == b, a).when((a < b) & (at >= a) & (at < b), at + 1).when((a > b) & (at > b) & (at <= a), at - 1).otherwise(at)
        made = acc["seq"].isNull() & (kind == "i") & (at == a)
        before = F.when(acc["seq"].isNotNull(), at).when(kind == "i", F.when(at > a, at - 1).otherwise(at)).when(kind == "r", opened).when(kind == "m", turned).otherwise(at)
        return F.struct(before.cast("int").alias("at"), F.when(made, e["seq"]).otherwise(acc["seq"]).alias("seq"))

    return F.aggregate(F.reverse(steps), F.struct(start.cast("int").alias("at"), F.lit(None).cast("int").alias("seq")), step)


def places(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """file_id, place, page_index, seq of every page that there is after the edits (file_id, seq, op, at, page, pages).

    ``page_index`` is the page that it was, or that it's a copy of; null for blank ones. ``seq`` is the edit that made it, null for pages that were there.
    """
    graph.shared_folder(pages.sparkSession)
    counts = pages.groupBy("file_id").agg(F.count("*").alias("n"))
    normal = _normal(edits.withColumn("seq", F.col("seq").cast("int")), counts).checkpoint()
    few = normal.agg(F.coalesce(F.sum(F.size("steps")), F.lit(0))).first()[0] <= FEW_EDITS
    sent = F.broadcast(normal) if few else normal
    was = pages.select("file_id", "page_index").join(sent, "file_id", "left")
    stays = was.select("file_id", F.coalesce(_forward(F.col("steps"), F.col("page_index")), "page_index").alias("place"), "page_index", F.lit(None).cast("int").alias("seq"))
    own = normal.select("file_id", "steps", F.posexplode("steps").alias("k", "e")).where("e.kind = 'i'")
    rest = F.slice("steps", F.col("k") + 2, F.greatest(F.size("steps") - F.col("k") - 1, F.lit(0)))
    made = own.select("file_id", _forward(rest, F.col("e.a")).alias("place"), F.col("e.seq").alias("seq"), F.when(F.col("e.source").isNotNull(), _backward(F.slice("steps", F.lit(1), F.col("k")), F.col("e.source"))).alias("of"))
    made = made.checkpoint()
    # copies of copies: the page at the end of each chain
    node = lambda c: F.struct("file_id", F.col(c).alias("seq"))
    chain = made.select(node("seq").alias("node"), F.when(F.col("of.seq").isNotNull(), node("of.seq")).alias("parent"), F.when(F.col("of.seq").isNull(), F.col("of.at")).alias("page_index"))
    source = graph.inherit(chain, "page_index").select("node.file_id", "node.seq", F.col("value").alias("page_index"))
    fresh = made.join(source, ["file_id", "seq"]).select("file_id", "place", "page_index", "seq")
    return stays.unionByName(fresh).where("place >= 0")
