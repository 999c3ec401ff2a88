"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, language_id, licenses, media, ngram_join, packing, phrases, sentencepieces, substring_dedup, suffix_dedup, url_rules, vectors
from .common import stored
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [url_rules.Rule("block", "net", "/"), url_rules.Rule("allow", "example.net", "/en/"), url_rules.Rule("block", "example.com", "/de/"), url_rules.Rule("allow", "org", "/fr/")]


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with whether the document that their path names is labelled of low quality or toxic."""
    doc = F.regexp_extract(url_rules.path(F.col("url")), r"/(\d+)", 1)
    named = table(spark, sf_dir, "pages").select("url", doc.try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return named.join(labels, "doc_id").select("url", "bad")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so each vector of ``embeddings`` is rendered as one, and each eighth once more as an edited copy."""
    images = media.render(table(spark, sf_dir, "embeddings"))
    found = media.near_copies(images)
    vec_id, copy = F.floor(F.col("image_id") / 2), F.pmod("image_id", F.lit(2)) == 1
    return found.select(vec_id.alias("vec_id"), copy.alias("edited"), "image_id", "n_corners", "component_id", "kept")


def op2_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = url_rules.mine(labelled_pages(spark, sf_dir))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, RULES, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


def op4_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    listed = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), "ids")
    back = byte_bpe.decode(listed, path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = packing.text_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(stored(parts), order=["key", "piece", "start", "ids_crc32"])
    return packed.withColumnRenamed("key", "doc_id")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    marked = docs.select("doc_id", held.alias("held_out"), "text")
    return language_id.predict(marked, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepieces.encode(docs, path, digests=True).withColumn("n_tokens", F.size("ids").cast("long"))
    back = sentencepieces.decode(coded.drop("bounds"), path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "bounds_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
