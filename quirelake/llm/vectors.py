"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are rotated onto leading principal directions (fitted on a bounded sample; any
orthonormal directions give right results) and sorted by their grid cells of side epsilon in the
space of those directions. The sorted sequence is cut into blocks, blocks into a tree of intervals with bounding
boxes, and pairs of intervals are joined recursively: a pair whose boxes are further apart than epsilon is
dropped with all below it, because a rotation's leading coordinates never exceed the distance. Pairs of blocks
that remain are compared by matrix products in double precision, which emit link counts and a spanning forest
of the links, never the pairs themselves. They are compared tile by tile, a tile being two runs of blocks of up to ``TILE`` bytes each, so a block is
shuffled once for each tile that needs it and not for each pair.

Equal vectors are collapsed first, so a vector that a third of all rows share is one row.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors of different lengths never link; repeated rows count as rows; rows of one id with different vectors are
vectors of their own, each with its own links; a null id is that of its row alone and names no component, unless no vector that it reaches has an id; an
empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, list_array, sized, spread, stored

MIN_COSINE = 0.9
LEAD = 8
#: Vectors that the directions are fitted on, by the smallest hash of their id.
FIT_ROWS = 5_000
BLOCK = 2_048
FAN = 8
#: Bytes of unit vectors on either side of a tile.
TILE = 32 << 20


def directions(reps: DataFrame, dim: int, lead: int = LEAD, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Leading principal directions of unit vectors of one length, as rows."""
    sample = reps.orderBy(F.xxhash64("rep", F.lit(11)), "rep").limit(fit_rows).select("v").toArrow()["v"]
    x = _unit(np.array(sample.to_pylist(), float).reshape(-1, dim))
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return v[: min(lead, dim)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled by their largest component first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", min_cosine: float = MIN_COSINE, block: int = BLOCK, lead: int = LEAD) -> DataFrame:
    """One row for each vector: key, n_links, component_id and kept."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("ok", fine & F.coalesce(top > 0, F.lit(False)))
    own = rows.where("ok")
    reps = own.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    # distinct vectors are told apart by a number of their own: ids may be null, or on several vectors
    reps = stored(reps.select(F.monotonically_increasing_id().alias("rep"), "low", "n", "v"))
    dims = [r[0] for r in reps.select(F.size("v")).distinct().collect()]
    linked = None
    for dim in dims:
        part = _join(reps.where(F.size("v") == dim).select("rep", "n", "v"), dim, min_cosine, block, lead)
        linked = part if linked is None else linked.unionByName(part)
    if linked is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    linked = stored(linked)
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = linked.select("rep", F.explode("to").alias("to"))
    found = components(edges, "rep", "to")
    per = reps.join(counts, "rep", "left").join(found, reps["rep"] == found["node"], "left")
    # stored, so that both sides of the joins by component and by vector are plain shuffles, which Spark splits where many rows have one
    per = stored(per.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"), "low"))
    lows = stored(per.groupBy("c").agg(F.min("low").alias("component_id")))
    per = stored(per.join(lows, "c").select("v", "n_links", "component_id"))
    out = own.select("id", "v").join(per, "v").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _join(reps: DataFrame, dim: int, min_cosine: float, block: int, lead: int) -> DataFrame:
    """Links of distinct unit vectors of one length: rep, links (rows on the other side), to (forest edges)."""
    spark, epsilon = reps.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    axes = directions(reps, dim, lead)
    n = reps.count()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column("v").flatten().to_numpy().reshape(-1, dim))
            p = x @ axes.T
            cell = np.floor(p / max(epsilon, 1e-9)).astype(np.int64)
            same = np.full(len(p), len(axes))
            unit = list_array(pa.array(x.ravel()), np.full(len(x), dim))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), unit, list_array(pa.array(p.ravel()), same), list_array(pa.array(cell.ravel()), same)], ["rep", "n", "unit", "p", "cell"])

    laid = reps.mapInArrow(project, "rep long, n long, unit array<double>, p array<double>, cell array<long>")
    order = [*[F.col("cell")[i] for i in range(len(axes))], F.col("p")[0], F.col("rep")]
    laid = laid.repartitionByRange(max(1, -(-n // block)), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= block:
                t = pa.Table.from_batches(held)
                yield box(t.slice(0, block))
                held = t.slice(block).to_batches()
        if sum(x.num_rows for x in held):
            yield box(pa.Table.from_batches(held))

    def box(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        p = np.array(t["p"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(axes))
        unit = np.array(t["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        one = lambda x, kind: pa.array([x], kind)
        return pa.RecordBatch.from_arrays(
            [one(p[0].tolist(), pa.list_(pa.float64())), one(t["rep"][0].as_py(), pa.int64()), one(p.min(axis=0).tolist(), pa.list_(pa.float64())), one(p.max(axis=0).tolist(), pa.list_(pa.float64())), one(t["rep"].to_numpy().tobytes(), pa.binary()), one(t["n"].to_numpy().tobytes(), pa.binary()), one(unit.tobytes(), pa.binary())],
            ["head", "first_id", "lo", "hi", "ids", "weights", "units"],
        )

    form = "head array<double>, first_id long, lo array<double>, hi array<double>, ids binary, weights binary, units binary"
    # partition index and place in the partition follow the sorted sequence
    blocks = stored(laid.mapInArrow(cut, form).withColumn("seq", F.monotonically_increasing_id()))
    places = blocks.select("seq", "lo", "hi")
    part, k = F.shiftright("seq", 33), F.col("seq").bitwiseAND((1 << 33) - 1)
    top = blocks.agg(F.max(part).alias("p"), F.max(k).alias("k")).first()
    per = (top["k"] or 0) + 1
    n_places = ((top["p"] or 0) + 1) * per
    boxes = stored(blocks.select((part * per + k).alias("i"), "lo", "hi"))
    # as few tiles as memory allows, but some for every core
    side = max(1, min(TILE // (block * dim * 8), int(np.ceil(n_places / np.sqrt(6 * spread(spark))))))
    tile = [F.floor(F.col(c) / side).alias(f"tile_{c}") for c in "ij"]
    pairs = stored(_surviving(boxes, n_places, epsilon, len(axes)).select(*tile, "i", "j"))
    needed = pairs.select("tile_i", "tile_j", F.explode(F.array("i", "j")).alias("place")).distinct()
    data = blocks.select((part * per + k).alias("place"), "ids", "weights", "units").join(sized(stored(needed)), "place")

    def compare(met: pa.Table, own: pa.Table) -> pa.Table:
        held = {x: [np.frombuffer(c[r].as_buffer(), kind) for c, kind in zip(b.columns[1:], (np.int64, np.int64, np.float64))] for b in own.select(["place", "ids", "weights", "units"]).to_batches() for r, x in enumerate(b.column(0).to_pylist())}
        return _tile(list(zip(met["i"].to_pylist(), met["j"].to_pylist())), held, dim, min_cosine)

    return pairs.groupBy("tile_i", "tile_j").cogroup(data.groupBy("tile_i", "tile_j")).applyInArrow(compare, "rep long, links long, to array<long>")


def _surviving(boxes: DataFrame, n: int, epsilon: float, lead: int) -> DataFrame:
    """Pairs i <= j of blocks whose boxes, and all intervals above them, come within epsilon."""
    levels = [(boxes.select("i", "lo", "hi"), n)]
    while levels[-1][1] > FAN:
        below, m = levels[-1]
        up = below.groupBy(F.floor(F.col("i") / FAN).alias("i")).agg(
            F.array(*[F.min(F.col("lo")[k]) for k in range(lead)]).alias("lo"), F.array(*[F.max(F.col("hi")[k]) for k in range(lead)]).alias("hi")
        )
        levels.append((stored(up), -(-m // FAN)))
    spark = boxes.sparkSession
    top = levels[-1][1]
    pairs = spark.createDataFrame([(i, j) for i in range(top) for j in range(i, top)], "i long, j long")
    for k in range(len(levels) - 1, -1, -1):
        table, m = levels[k]
        a = table.select("i", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        b = table.select(F.col("i").alias("j"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        gap = [F.greatest(F.col("lo_a")[d] - F.col("hi_b")[d], F.col("lo_b")[d] - F.col("hi_a")[d], F.lit(0.0)) for d in range(lead)]
        apart = sum((g * g for g in gap[1:]), gap[0] * gap[0])
        pairs = pairs.join(a, "i").join(b, "j").where(apart <= epsilon * epsilon * (1 + 1e-9) + 1e-12).select("i", "j")
        if k:
            size = levels[k - 1][1]
            kids = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.least(F.col(c) * FAN + FAN - 1, F.lit(size - 1))))  # noqa: B023, E731
            pairs = stored(pairs.select(kids("i").alias("i"), "j").select("i", kids("j").alias("j")).where("i <= j"))
    return pairs


def _tile(pairs: list[tuple[int, int]], held: dict[int, list[np.ndarray]], dim: int, floor: float) -> pa.Table:
    """Counts and forest edges of pairs of blocks (ids, weights, units of each by its place)."""
    places = sorted(held)
    at = dict(zip(places, np.cumsum([0, *[len(held[x][0]) for x in places]]).tolist()))
    ids = np.concatenate([held[x][0] for x in places])
    counts, parent, to_by = np.zeros(len(ids), np.int64), np.arange(len(ids)), {}
    for i, j in sorted(pairs):
        (_, w_a, u_a), (_, w_b, u_b) = held[i], held[j]
        for a, c in _links(at[i], w_a, u_a.reshape(-1, dim), at[j], w_b, u_b.reshape(-1, dim), floor, counts, parent):
            to_by.setdefault(a, []).append(int(ids[c]))
    keep = np.flatnonzero(counts)
    return pa.table({"rep": ids[keep], "links": counts[keep], "to": pa.array([to_by.get(x, []) for x in keep.tolist()], pa.list_(pa.int64()))})


def _links(at_a: int, w_a, u_a, at_b: int, w_b, u_b, floor: float, counts: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """Counts of one pair of blocks, which start at these rows of ``counts`` and ``parent``, a few hundred rows at a time, and forest edges that join what ``parent`` has apart."""
    same, made = at_a == at_b, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(u_a), 512):
        hit = u_a[at : at + 512] @ u_b.T >= floor
        if same:
            hit[np.arange(hit.shape[0]), np.arange(at, at + hit.shape[0])] = False
        if not hit.any():
            continue
        counts[at_a + at : at_a + at + len(hit)] += hit @ w_b
        if not same:
            counts[at_b : at_b + len(u_b)] += w_a[at : at + 512] @ hit
        # components of this strip: rows with the same smallest partner need no second look
        rows = np.flatnonzero(hit.any(axis=1))
        for r in rows.tolist():
            partners = at_b + np.flatnonzero(hit[r])
            a = at_a + at + r
            _, pick = np.unique(parent[partners], return_index=True)
            for c in partners[pick].tolist():
                x, y = find(a), find(c)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    made.append((a, c))
            top = find(a)
            parent[partners] = top
            parent[a] = top
    return made
