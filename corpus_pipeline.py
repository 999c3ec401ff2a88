"""A corpus pipeline over ``documents``: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written to the
shared folder and read again. All stages but the last return the columns that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm import language_id as lang
from quirelake.llm import ngram_join, packing, substring_dedup
from quirelake.llm.common import sized, stored


#: A language counts as told where it is at least as likely as all others together.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell: ``und`` (null or no letter) goes, and what scores below ``MIN_SCORE``."""
    model = lang.fit(docs.select("text", "lang"))
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = lang.predict(docs, model, lang="_lang", score="_score").where((F.col("_lang") != lang.UNKNOWN) & (F.col("_score") >= MIN_SCORE))
    return told.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of the smallest id of each group of near copies; rows without an id or words stay.

    Rows are told apart by id and text; of rows that repeat both, the first in the order of all columns stays.
    """
    found = ngram_join.classes(docs.select("doc_id", "text")).where("id is not null and n_shingles > 0")
    per = stored(found.groupBy("id", "rk").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    rows = docs.select("*", F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_rk"))
    named = per.select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), "kept")
    kept = rows.join(sized(named.drop("kept")), ["_id", "_rk"], "left_anti").select(docs.columns)
    repeated = rows.join(sized(named.where("kept").drop("kept")), ["_id", "_rk"], "left_semi")
    order = Window.partitionBy("_id", "_rk").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    first = repeated.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return kept.unionByName(first.select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those with nothing left go.

    A text that loses words has the rest joined by one space; others stay as they are.
    """
    out = substring_dedup.dedup(docs).where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    changed = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    parts = packing.text_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(stored(parts), order=["key", "piece", "start", "ids_crc32"]).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL gives tokens or trained languages; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
