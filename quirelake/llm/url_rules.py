"""URL filters: hand-written rules first, then association rules mined from labelled URLs.

A URL's tokens are its scheme, host labels with their suffixes, path words and query keys (numbers
become one token). ``mine`` has Spark's FP-growth find frequent sets of tokens and keeps rules "tokens -> bad" by
support and confidence, without those that a shorter rule of no less confidence implies. No URL is cut: tokens
that too few bad URLs have are in no rule. Of tokens that occur in the same labelled URLs one stands for all while sets are mined, because
sets that differ in such tokens alone have the same support and confidence; a rule has all of them again as ``members``, and any
member of each of its items makes it fit. A class of tokens has no more members than a URL has tokens.
``judge`` looks mined rules up by an inverted index on the members of the rarest item of each, and names the largest member of each item that the URL has.

Cases: null URLs or URLs without ``://`` have an empty host and path, fit no rule and are
judged by the method on no tokens; no labelled row means no mined rule; repeated rows are judged
each; equal confidences are ordered by the rule's text; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; an empty list for null and for what has no ``://``."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.filter(F.split(F.lower(path(url)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.concat(F.lit("path:"), F.when(x.rlike(r"^\d+$"), F.lit("0")).otherwise(x)))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    found = F.array_distinct(F.concat(suffixes, scheme, words, keys))
    return F.when(F.instr(url, "://") > 0, found).otherwise(F.array().cast("array<string>"))


_BAD = "label:bad"


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (items, members, key, confidence, support) from rows with a boolean ``bad``; null labels are left out."""
    spark = labelled.sparkSession
    rows = labelled.select(tokens(F.col(f"`{url}`")).alias("items"), F.col(f"`{bad}`").alias("bad")).where("bad is not null and size(items) > 0")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    found = _frequent(rows, max(1, math.ceil(min_support * n - 1e-9)))
    if found is None:
        return spark.createDataFrame([], "items array<string>, members array<array<string>>, key string, confidence double, support double")
    sets, stands = found
    with_bad = sets.where(F.array_contains("items", _BAD)).select(F.array_sort(F.array_remove("items", _BAD)).alias("items"), F.col("freq").alias("n_bad"))
    rules = with_bad.join(sets.select(F.array_sort("items").alias("items"), "freq"), "items").where(F.col("n_bad") / F.col("freq") >= min_confidence)
    rules = _indexed(rules.select("items", (F.col("n_bad") / F.col("freq")).alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support")))
    # a shorter rule of the same tokens is found by its key
    one = rules.select("items", "confidence", F.explode("items").alias("key"))
    parts = rules.select(F.col("items").alias("less"), F.col("confidence").alias("sure"), "key")
    implied = one.join(parts, "key").where((F.size("less") < F.size("items")) & (F.col("sure") >= F.col("confidence")))
    implied = implied.where(F.size(F.array_except("less", "items")) == 0).select("items").distinct()
    kept = _indexed(rules.drop("key").join(implied, "items", "left_anti"))
    each = kept.select("items", F.posexplode("items").alias("k", "t")).join(sized(stands), "t")
    members = each.groupBy("items").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "members"))), lambda x: x["members"]).alias("members"))
    return stored(kept.join(members, "items").select("items", "members", "key", "confidence", "support"))


def _frequent(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame] | None:
    """Sets of tokens and ``_BAD`` (items, freq) of at least ``least`` rows, for rows (row, items, bad), and the tokens that each token in them stands for (t, members); None if there can't be any."""
    each = rows.select("row", "bad", F.explode("items").alias("t"))
    same = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"same{k}") for k in (1, 2)]
    per = each.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), *same).where(F.col("n_bad") >= least)
    stands = stored(per.groupBy("n", "same1", "same2").agg(F.min("t").alias("t"), F.array_sort(F.collect_list("t")).alias("members")).select("t", "members"))
    baskets = each.join(sized(stands.select("t")), "t").groupBy("row", "bad").agg(F.collect_list("t").alias("items"))
    baskets = stored(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items")))
    m = baskets.count()
    if not m:
        return None
    return stored(FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m, minConfidence=1.0).fit(baskets).freqItemsets), stands


def _indexed(rules: DataFrame) -> DataFrame:
    """Rules with their key: the one of their tokens that the fewest rules have."""
    rules = stored(rules)
    one = rules.select("items", F.explode("items").alias("t"))
    key = one.join(one.groupBy("t").agg(F.count("*").alias("n")), "t").groupBy("items").agg(F.min_by("t", F.struct("n", "t")).alias("key"))
    return stored(rules.join(key, "items"))


def fitting(rules: list[Rule], h: Column, p: Column) -> Column:
    """The longest rule whose host is h or a parent of it and whose path starts p, as (n, text, verdict); or null.

    Rules are looked up by each suffix of the host in one literal map.
    """
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.host, []).append(r)
    if not by:
        return F.lit(None).cast("struct<n:int,text:string,verdict:string>")
    entry = lambda r: F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))
    index = F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.array(*map(entry, v)))])
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(index, s)), lambda x: x.isNotNull()))
    best = F.array_max(F.transform(F.filter(found, lambda r: F.startswith(p, r["path"])), lambda r: F.struct(r["n"].alias("n"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    return best


def judge(df: DataFrame, rules: list[Rule], mined: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict, mined_rule and mined_confidence; columns of these names are replaced."""
    made = ["host", "path", "rule", "verdict", "mined_rule", "mined_confidence"]
    df = df.drop(*made)
    rows = stored(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("other"), F.monotonically_increasing_id().alias("row"), F.col(f"`{url}`").alias("url")))
    own = rows.select("row", tokens(F.col("url")).alias("tokens"))
    index = mined.select("members", "confidence", F.explode(F.element_at("members", F.array_position("items", F.col("key")).cast("int"))).alias("key"))
    hits = own.select("row", "tokens", F.explode("tokens").alias("key")).join(index, "key")
    hits = hits.where(F.forall("members", lambda m: F.arrays_overlap("tokens", m)))
    named = F.array_join(F.array_sort(F.transform("members", lambda m: F.array_max(F.array_intersect(m, F.col("tokens"))))), " ")
    best = hits.groupBy("row").agg(F.max(F.struct("confidence", named.alias("text"))).alias("hit"))
    out = rows.join(best, "row", "left")
    out = out.withColumn("h", host(F.col("url"))).withColumn("p", path(F.col("url"))).withColumn("fit", fitting(rules, F.col("h"), F.col("p")))
    verdict = F.coalesce("fit.verdict", F.when(F.col("hit").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(f"other.`{c}`").alias(c) for c in df.columns], F.col("h").alias("host"), F.col("p").alias("path"), F.col("fit.text").alias("rule"), verdict.alias("verdict"), F.col("hit.text").alias("mined_rule"), F.col("hit.confidence").alias("mined_confidence"))
