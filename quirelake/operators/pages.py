"""Page attributes, labels, bookmarks and facts about files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..sources.pdf import PdfCorpus


def with_labels(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` with the printed label: that of the last rule at or before a page, of the first one before that.

    Rules of a file travel as one sorted array, so pages meet them in an equality join by file.
    """
    held = rules.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("from_index", "style", "prefix", "start"))).alias("_rules"))
    out = pages.join(held, "file_id", "left")
    before = F.filter("_rules", lambda r: r["from_index"] <= F.col("page_index"))
    rule = F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(F.col("_rules"), F.lit(1)))
    label = t.page_label(F.col("page_index"), rule["from_index"], rule["style"], rule["prefix"], rule["start"])
    return out.withColumn("label", label).drop("_rules")


def pages_view(corpus: PdfCorpus, scale: float = 1.0) -> DataFrame:
    """``pages`` with label and display (matrix, width and height on a screen)."""
    return with_labels(corpus.pages, corpus.page_labels).withColumn("display", g.display(F.col("crop_box"), F.col("rotate"), scale))


def choose_scale(corpus: PdfCorpus, width: float, most: float = 2.0) -> DataFrame:
    """The scale of each file that fits its widest page, as turned, into ``width``."""
    shown = g.display(F.col("crop_box"), F.col("rotate"))["width"]
    return corpus.pages.groupBy("file_id").agg(F.least(F.lit(width) / F.max(shown), F.lit(most)).alias("scale"))


def inventory(corpus: PdfCorpus) -> DataFrame:
    """Every indexed object with kind, subtype and how it's stored."""
    return corpus.objects.select("file_id", "obj_num", "kind", "subtype", "stored", t.worded(F.col("stored"), t.STORED_WORDS).alias("stored_as"))


def outline_view(corpus: PdfCorpus, labels: int = 24) -> DataFrame:
    """Bookmarks depth first with the label of the first ``labels`` pages that they point at."""
    labelled = with_labels(corpus.pages.select("file_id", "page_index"), corpus.page_labels).where(F.col("page_index") < labels)
    return corpus.outline.join(labelled, ["file_id", "page_index"], "left").select("file_id", "path", "depth", "title", "page_index", "label")


def facts(corpus: PdfCorpus) -> DataFrame:
    """One row a file: version, pages, parts, later saves, text blocks, characters, filters, repairs, verdict and advice."""
    if all(map(corpus.saved, ("files", "text_runs", "streams"))):
        text = corpus.text_runs.groupBy("file_id").agg(F.count("*").alias("runs"), F.sum(F.char_length("text")).alias("chars"))
        filters = corpus.streams.select("file_id", F.explode("filters").alias("f")).groupBy("file_id").agg(F.array_sort(F.collect_set(t.worded(F.col("f"), t.FILTER_WORDS))).alias("filters"))
        out = corpus.files.join(text, "file_id", "left").join(filters, "file_id", "left")
    else:
        out = corpus.file_facts.withColumn("filters", F.array_sort(F.array_distinct(F.transform("filters", lambda f: t.worded(f, t.FILTER_WORDS)))))
    chars, empty = F.coalesce("chars", F.lit(0)), F.array().cast("array<string>")
    verdict = F.when(F.col("encrypted"), F.lit("Password protected")).when(F.col("repair_count") > 0, F.concat(F.lit("Repaired ("), F.col("repair_count"), F.lit(")"))).otherwise("Opened cleanly")
    advice = F.when((chars == 0) & (F.col("page_count") > 0), F.when(F.col("encrypted"), F.lit("protected")).otherwise("no text"))
    return out.select(
        "file_id", "version", "page_count", F.col("object_count").alias("parts"), F.greatest(F.size("sections_read") - 1, F.lit(0)).alias("later_saves"),
        F.coalesce("runs", F.lit(0)).alias("runs"), chars.alias("chars"), F.coalesce("filters", empty).alias("filters"), "repair_count", "encrypted", verdict.alias("verdict"), advice.alias("advice"),
    )


def editable(corpus: PdfCorpus) -> DataFrame:
    """Which edits a file allows: none when encrypted, no deletion of its only page."""
    return corpus.files.select("file_id", (~F.col("encrypted")).alias("can_edit"), (~F.col("encrypted") & (F.col("page_count") > 1)).alias("can_delete"))
