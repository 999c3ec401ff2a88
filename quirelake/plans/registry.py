"""All named queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf, relational, text


def queries() -> dict:
    return {**pdf.QUERIES, **relational.QUERIES, **text.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**pdf.ORACLES, **relational.ORACLES, **text.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with rectangles over files built from ``documents``: matches and covered width per file."""
    from ..operators.search import search

    found = search(pdf.built(spark, sf_dir), pdf.NEEDLE, whole_word=True, limit=None)
    width = F.aggregate("rects", F.lit(0.0), lambda a, r: a + r["x1"] - r["x0"])
    return found.groupBy("file_id").agg(F.count("*").alias("matches"), F.round(F.sum(width), 3).alias("width"), F.sum(F.size("rects")).alias("rects"))
