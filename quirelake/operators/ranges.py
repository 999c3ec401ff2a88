"""Operations along an order: running totals, places, islands, as-of joins and interval joins, where one key may hold most rows.

Rows of a key that has more than a task's share are cut into bins along the order. The cuts are quantiles of a sample, so they decide which
task works on a row and nothing else; they are literals in the plan, so a task that runs again cuts alike. Each bin is worked off alone
by a window over (key, bin), one shuffle for all keys; what it has to know of the bins before it (a total, or the last
row of the right side) is one row a bin, scanned and sent back as a broadcast that has as many rows as there are cuts.

Cases: null keys are a key of their own, except in joins, where they meet nothing; null order values come first; equal order values may come in any order among
themselves, so give columns that tell rows apart where that matters; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins that all rows together would fill, for each shuffle partition.
BINS = 4
#: Rows of the sample for each bin.
SAMPLED = 50


def _named(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def binned(df: DataFrame, key: list[str], order: list[str | Column], bins: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with ``_bin``, which grows with the order within a key; and whether any key has more than one.

    ``bins`` is how many all rows together would fill: a key with a share of them gets that share. At most that many cuts are collected.
    """
    spark = df.sparkSession
    bins = bins or BINS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*[_named(c).alias(f"o{i}") for i, c in enumerate(order)])
    n = df.count()
    if not n:
        return df.withColumn("_bin", F.lit(0)), False
    share = min(1.0, SAMPLED * bins / n)
    drawn = df.select(*key, place.alias("_o")).sample(share, 7) if share < 1 else df.select(*key, place.alias("_o"))
    told = drawn.groupBy(*key).agg(F.count("*").alias("c"), F.sort_array(F.collect_list("_o")).alias("o"))
    told = told.withColumn("b", F.ceil(F.col("c") * (bins / (n * share)))).where("b > 1")
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("b").cast("int") - 1), lambda i: F.col("o")[(i * F.col("c") / F.col("b")).cast("int")]))
    found = told.select(*key, cuts.alias("_cuts"))
    rows = found.collect()
    if not rows:
        return df.withColumn("_bin", F.lit(0)), False
    cut = F.broadcast(spark.createDataFrame(rows, found.schema))
    joined = df.join(cut, _same(df, cut, key), "left").select(*[df[c] for c in df.columns], cut["_cuts"])
    out = joined.withColumn("_bin", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= place))))
    return out.withColumn("_cut", F.col("_cuts").isNotNull()).drop("_cuts"), True


def _carried(out: DataFrame, per: DataFrame, key: list[str], carried: dict[str, Column]) -> DataFrame:
    """``out`` with what its bin has to know, from one row a bin of the keys that were cut."""
    before = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    told = F.broadcast(per.select(*key, "_bin", *[c.over(before).alias(n) for n, c in carried.items()]))
    return out.join(told, _same(out, told, [*key, "_bin"]), "left").select(*[out[c] for c in out.columns], *[told[n] for n in carried])


def running(df: DataFrame, key: list[str], order: list[str | Column], totals: dict[str, Column], bins: int | None = None) -> DataFrame:
    """``df`` with running totals within a key, each up to and with its row; nulls count as zero."""
    names = list(df.columns)
    laid, cut = binned(df, key, order, bins)
    w = Window.partitionBy(*key, "_bin").orderBy(*[_named(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(F.coalesce(c, F.lit(0))) for n, c in totals.items()}
    out = laid.withColumns({n: c.over(w) for n, c in sums.items()})
    if cut:
        per = laid.where("_cut").groupBy(*key, "_bin").agg(*[c.alias(f"_{n}") for n, c in sums.items()])
        out = _carried(out, per, key, {f"_before_{n}": F.sum(f"_{n}") for n in totals})
        out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in totals})
    return out.select(*[f"`{c}`" for c in names], *totals)


def placed(df: DataFrame, key: list[str], order: list[str | Column], name: str = "place", bins: int | None = None) -> DataFrame:
    """``df`` with the place of each row in its key's order, from 1."""
    return running(df, key, order, {name: F.lit(1)}, bins)


def islands(df: DataFrame, key: list[str], number: str, bins: int | None = None) -> DataFrame:
    """Runs of consecutive distinct numbers of a key: first and count."""
    n = placed(df.select(*key, number).where(F.col(number).isNotNull()).distinct(), key, [number], "_k", bins)
    return n.groupBy(*key, (F.col(number) - F.col("_k")).alias("_island")).agg(F.min(number).alias("first"), F.count("*").alias("count")).drop("_island")


def asof(left: DataFrame, right: DataFrame, key: list[str], left_order: str, right_order: str, values: list[str], bins: int | None = None) -> DataFrame:
    """Every ``left`` row with ``values`` of the last ``right`` row of its key at or before it.

    Ties of the right side take the largest values. Left rows without one, or with a null order, get nulls.
    """
    r = right.where(F.col(right_order).isNotNull()).groupBy(*key, F.col(right_order).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    kind = r.schema["_v"].dataType
    named = {c: f"l{i}" for i, c in enumerate(left.columns)}
    l = left.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], F.col(left_order).alias("_t"), F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_side"))
    # among equal times left rows come after the right one, in any order: their hash lets cuts fall between them
    l = l.withColumn("_h", F.xxhash64(*named.values()))
    r = r.select(*[(F.col(c) if c in key else F.lit(None)).cast(left.schema[c].dataType).alias(n) for c, n in named.items()], "_t", "_v", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_h"))
    k, order = [named[c] for c in key], ["_t", "_side", "_h"]
    laid, cut = binned(l.unionByName(r), k, order, bins)
    w = Window.partitionBy(*k, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.withColumn("_found", F.last("_v", ignorenulls=True).over(w))
    if cut:
        per = laid.where("_cut").groupBy(*k, "_bin").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
        out = _carried(out, per, k, {"_before": F.last("_last", ignorenulls=True)})
        out = out.withColumn("_found", F.coalesce("_found", "_before"))
    out = out.where("_side = 1")
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in k], F.col("_t").isNotNull())
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], *[F.when(known, F.col(f"_found.{c}")).alias(c) for c in values])


def overlaps(a: DataFrame, b: DataFrame, key: list[str], a_from: str, a_to: str, b_from: str, b_to: str) -> DataFrame:
    """Pairs of a key whose half-open ranges meet (a_from < b_to and b_from < a_to): columns of both, the key once.

    A pair is found once, where its later range begins. Ranges are cut into bins about as wide as they are long (widths are powers of four, so a
    range is in two bins), the beginnings of the other side look into the bin that they are in, of each width there is. A beginning
    that shares a bin with a range is likely to meet it, so what is compared grows with what is found, not with the square of a key.
    """
    later_b = _begun(a, b, key, (a_from, a_to), (b_from, b_to), strict=False)
    later_a = _begun(b, a, key, (b_from, b_to), (a_from, a_to), strict=True)
    columns = [*key, *[c for c in (*a.columns, *b.columns) if c not in key]]
    return later_b.select(*columns).unionByName(later_a.select(*columns))


def _begun(long: DataFrame, point: DataFrame, key: list[str], span: tuple[str, str], other: tuple[str, str], strict: bool) -> DataFrame:
    """Pairs whose ``point`` range begins within the ``long`` one; where strict, not together with it."""
    whole = all(f.dataType.typeName() in ("byte", "short", "integer", "long") for d, cs in ((long, span), (point, other)) for f in (d.schema[c] for c in cs))
    kind = "long" if whole else "double"
    lo, hi, at = F.col(span[0]).cast(kind), F.col(span[1]).cast(kind), F.col(other[0]).cast(kind)
    width = 2 * F.ceil(F.log2(F.greatest(hi.cast("double") - lo.cast("double"), F.lit(1.0 if whole else 1e-300))) / 2).cast("int")
    slot = lambda x, w: F.call_function("shiftright", x, w) if whole else F.floor(x / F.pow(F.lit(2.0), w))
    ranges = long.where(lo < hi).withColumn("_w", F.least(width, F.lit(62)) if whole else width)
    widths = [r[0] for r in ranges.select("_w").distinct().collect()]  # at most 32 of whole numbers, 1074 of others
    spread = ranges.withColumn("_s", F.explode(F.sequence(slot(lo, F.col("_w")), slot(hi, F.col("_w")))))
    probes = point.where(at.isNotNull()).withColumn("_w", F.explode(F.array(*[F.lit(w) for w in sorted(widths)]).cast("array<int>"))).withColumn("_s", slot(at, F.col("_w")))
    begins = (F.col(span[0]) < F.col(other[0])) if strict else (F.col(span[0]) <= F.col(other[0]))
    met = spread.join(probes, [*key, "_w", "_s"]).where(begins & (F.col(other[0]) < F.col(span[1])) & (F.col(span[0]) < F.col(other[1])))
    return met.drop("_w", "_s")
