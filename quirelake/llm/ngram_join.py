"""N-gram Jaccard self-join of documents by T-occurrence search.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Sets that are equal collapse to
one representative. In the order of hashes, two sets of similarity 0.8 or more share at least T elements of
prefixes a little longer than a fifth, so the inverted index holds prefixes only:

1. lists of one document are dropped, and with them every document with fewer than T entries left;
2. each document is compared with the leaders of its lists, which joins large groups of
   copies in work linear in their size;
3. documents in lists that still hold several components are searched as DivideSkip does, in pairs of blocks: each
   document sets its longest lists apart, the short ones are merged (by a sort that merges sorted runs, in place of a
   heap), and documents with enough short hits are settled by binary probes of the long lists.

Step 3 sees all pairs that steps 1 and 2 have not settled, so no link between components is lost;
pairs inside a component are not looked at again. Hashes stand for shingles: at 64 bits, two different
shingles of a corpus of N distinct ones collide with a chance of N * N / 2**65.

Cases: null or empty text has an empty set and links with nothing; fewer than 5 words make one shingle of
the whole sequence; rows of a null id link with nothing and return a null component; repeated rows are copies of each
other; rows of one id with different texts have their own links, which all count as links of that id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, components, discard, list_array, mix, over_key, signed, sized, slices, stored

SHINGLE = 5
PERCENT = 80


def _need(n: int, percent: int) -> int:
    """Elements of a set of n that any similar set must share: the ceiling of percent of n."""
    return -(-percent * n // 100)


def _least(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _extra(n: int) -> int:
    return 1 + n // 20


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    w = Words(column, lower=True)
    hashes, _ = w.windows(k)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= k:
            own = hashes[a : b - k + 1]
            own.sort()
            own = own[np.append(True, own[1:] != own[:-1])]
            out.append(own)
        elif b > a:
            few = np.zeros(1, np.uint64)
            for h in w.hash[a:b]:
                few = mix(few + h)
            out.append(few + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return list_array(signed(flat), np.array([len(s) for s in sets], np.int64))


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """id and the whole set, for rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(shingle_sets(b.column("text"), k))], ["id", "s"])

    return rows.mapInArrow(run, "id long, s array<long>")


def _prefixes(rows: DataFrame, k: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), k)
            size = np.array([len(s) for s in sets], np.int64)
            whole = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
            short = [s[: len(s) - _need(len(s), percent) + _extra(len(s))] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rk"), pa.array(size), pa.array(whole, pa.binary()), _lists(short)], ["id", "rk", "n", "whole", "prefix"])

    return rows.mapInArrow(run, "id long, rk long, n long, whole binary, prefix array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, by binary probes of one sorted set with the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                hit = []
                for i in range(b.num_rows):
                    x, y = (b.column(c)[i].values.to_numpy().view(np.uint64) for c in ("s_a", "s_b"))
                    if len(x) > len(y):
                        x, y = y, x
                    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    hit.append(100 * same >= percent * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    a = sets.select(F.col("id").alias("a"), F.col("s").alias("s_a"))
    b = sets.select(F.col("id").alias("b"), F.col("s").alias("s_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: key, n_shingles, component_id."""
    return classes(df, key, text, k, percent).select(F.col("id").alias(key), "n_shingles", "component_id")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: id, rk (xxhash64 of its text), n_shingles, component_id and kept.

    Exactly one row of each class of linked texts is kept, one of its smallest id; rows that link with nothing are kept.
    Rows of one id share its component, but are kept or not by their own texts.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("rk"), F.col(f"`{text}`").alias("text"))
    made = stored(_prefixes(rows, k, percent).withColumn("row", F.monotonically_increasing_id()))
    base = stored(made.drop("prefix"))
    # a node is the row that stands for all of its set
    reps = base.where("n > 0 and id is not null").groupBy("whole").agg(F.min(F.struct("id", "row")).alias("r"))
    reps = stored(reps.select("whole", F.col("r.id").alias("rep"), F.col("r.row").alias("node")))
    copies = base.where("n > 0").join(reps, "whole").where("row <> node").select("row")
    index = made.where("n > 0 and id is not null").join(sized(copies), "row", "left_anti").select(F.col("row").alias("id"), "n", F.explode("prefix").alias("h"))
    alive = stored(over_key(index, "h", "c > 1", c=F.count("*")).drop("c"))
    discard(made)
    need = lambda n: F.lit(1) + F.floor(_least(n, percent) / 20)  # noqa: E731  (the partner has at least so many elements)
    entries = stored(_pruned(alive, need))
    discard(alive)
    found = None
    if not entries.isEmpty():
        ids = base.join(sized(entries.select(F.col("id").alias("row")).distinct()), "row", "left_semi").select("id", "rk", "row")
        sets = _sets(rows.join(sized(stored(ids)), ["id", "rk"]).select(F.col("row").alias("id"), "text"), k)
        if not base.groupBy("id", "rk").count().where("count > 1").isEmpty():
            sets = sets.dropDuplicates(["id"])  # the text of repeated rows was read several times
        sets = stored(sets)
        # leaders: the smallest id, and the document with the largest shared part (an original among its edited copies)
        near = over_key(entries, "h", "true", x=F.min(F.struct("id", "n")), y=F.max(F.struct((F.col("c") / F.col("n")).alias("part"), "id", "n"))).select("id", "n", F.explode(F.array("x", F.struct(F.col("y.id").alias("id"), F.col("y.n").alias("n")))).alias("m"))
        near = near.groupBy("id", "n", "m").agg(F.count("*").alias("c")).where(F.col("c") >= need(F.col("n")))
        pairs = _fitting(near.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("m.id").alias("b"), F.col("m.n").alias("nb")), percent)
        links = stored(_verified(stored(pairs), sets, percent))
        found = stored(components(links))
        rest = _residue(entries, found, need)
        if rest is not None:
            more = _searched(rest, sets, percent)
            if more is not None and not more.isEmpty():
                found = stored(components(links.unionByName(more)))
        discard(sets)
    discard(entries)
    reps = reps.withColumn("class", F.col("node")) if found is None else reps.join(found, "node", "left").select("whole", "rep", "node", F.coalesce("component", "node").alias("class"))
    reps = stored(reps)
    first = reps.groupBy("class").agg(F.min(F.struct("rep", "node")).alias("f")).select("class", F.col("f.rep").alias("low"), F.col("f.node").alias("node"))
    # ids whose rows fall into several classes
    named = base.where("n > 0 and id is not null").select("id", "whole").distinct()
    named = stored(named.join(named.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"), "id").join(reps.select("whole", "class"), "whole").select("id", "class").distinct())
    if not named.isEmpty():
        ties = named.join(named.groupBy("id").agg(F.min("class").alias("b")), "id").select(F.col("class").alias("a"), "b")
        tops = components(ties).select(F.col("node").alias("class"), F.col("component").alias("top"))
        first = first.join(tops, "class", "left").withColumn("top", F.coalesce("top", "class"))
        first = first.join(first.groupBy("top").agg(F.min("low").alias("least")), "top").select("class", F.col("least").alias("low"), "node")
    reps = reps.select("whole", "class").join(first, "class").select("whole", F.col("low").alias("rep"), "node")
    out = base.join(reps, "whole", "left")
    lone = F.col("id").isNull() | (F.col("n") == 0)
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("rep"))
    return out.select("id", "rk", F.col("n").alias("n_shingles"), component.alias("component_id"), (lone | (F.col("row") == F.col("node"))).alias("kept"))


def _pruned(entries: DataFrame, need) -> DataFrame:
    """Entries of documents that have at least T of them, with that count as c."""
    enough = entries.groupBy("id").agg(F.count("*").alias("c"), F.max("n").alias("n_")).select("id", "c", "n_")
    enough = enough.where(F.col("c") >= need(F.col("n_"))).drop("n_")
    return entries.drop("c").join(enough, "id")


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b whose sizes allow the similarity."""
    sizes = pairs.where("a <> b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sizes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _residue(entries: DataFrame, found: DataFrame, need) -> DataFrame | None:
    """Documents (id, g) that have T entries in lists over several components; None if there are none."""
    own = entries.join(found, entries["id"] == found["node"], "left").select("h", "id", "n", F.coalesce("component", "id").alias("g"))
    own = _mixed(own, need)
    return None if own is None else own.select("id", "g").distinct()


def _mixed(own: DataFrame, need) -> DataFrame | None:
    """Entries (h, id, n, g) whose list has another component, of documents with T of them.

    Rounds end when one drops less than a tenth: what they drop cannot link, what they leave is still searched.
    """
    before = None
    while True:
        mixed = own.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h")
        whole, own = own, stored(_pruned(own.join(mixed, "h", "left_semi"), need))
        if before is not None:
            discard(whole)
        size = own.count()
        if not size:
            return None
        if before is not None and size > 0.9 * before:
            return own
        before = size


def _searched(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between different components among the documents of ``rest`` (id, g).

    Whole sets are listed now, with T the least overlap that the similarity asks for: a document
    with fewer elements in lists of other components is dropped. What stays falls into cohorts that no list crosses. Cohorts are
    cut into blocks by size of set, and each pair of blocks whose sizes allow links is searched in one task.
    """
    own = sets.join(rest, "id").select("id", "g", F.size("s").cast("long").alias("n"), F.explode("s").alias("h"))
    own = _mixed(own, lambda n: _least(n, percent))
    if own is None:
        return None
    lead = own.groupBy("h").agg(F.min("id").alias("b"))
    cohort = components(own.join(lead, "h").select(F.col("id").alias("a"), "b").where("a <> b").distinct())
    docs = own.select("id", "g", "n").distinct().join(cohort, F.col("id") == F.col("node")).select("id", "g", "n", F.col("component").alias("cohort"))
    docs = stored(_blocks(docs))
    ranges = docs.groupBy("cohort", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = ranges.select("cohort", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i")), ranges.select("cohort", F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    tasks = x.join(y, "cohort").where("i <= j").where((100 * F.col("hi_i") >= percent * F.col("lo_j")) & (100 * F.col("hi_j") >= percent * F.col("lo_i"))).select("cohort", "i", "j")
    sides = tasks.select("cohort", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(tasks.where("i < j").select("cohort", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    rows = sides.join(docs, ["cohort", "block"]).join(sets, "id").select("cohort", "i", "j", "side", "id", "g", "s")

    def search(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(group))
        side = t["side"].to_numpy()
        ids, g = t["id"].to_numpy(), t["g"].to_numpy()
        held = [x.values.to_numpy().view(np.uint64) for x in t["s"]]
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() else one
        links = divide_skip([held[k] for k in one], g[one], [held[k] for k in two], g[two], percent)
        yield pa.RecordBatch.from_arrays([pa.array([int(ids[one[a]]) for a, _ in links], pa.int64()), pa.array([int(ids[two[b]]) for _, b in links], pa.int64())], ["a", "b"])

    return stored(rows.groupBy("cohort", "i", "j").applyInArrow(search, "a long, b long"))


#: Elements in the sets of one block; a task holds two.
BLOCK = 600_000


def _blocks(docs: DataFrame) -> DataFrame:
    """Number blocks of about BLOCK elements in each cohort, similar sizes together.

    Sizes are ranked through a histogram for each cohort, so a large cohort is never sorted in one task.
    """
    counts = docs.groupBy("cohort", "n", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("part")).agg(F.sum("n").alias("c"))
    w = Window.partitionBy("cohort").orderBy("n", "part").rowsBetween(Window.unboundedPreceding, -1)
    place = counts.withColumn("block", F.floor(F.coalesce(F.sum("c").over(w), F.lit(0)) / BLOCK))
    return docs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1024))).join(place.drop("c"), ["cohort", "n", "part"]).drop("part")


def divide_skip(queries: list[np.ndarray], q_group: np.ndarray, indexed: list[np.ndarray], i_group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (query, indexed) of sorted sets that are similar enough, one for each two groups that they connect.

    For each query, its longest lists are set apart; the others are merged, which counts how often each document
    occurs in them; documents with enough hits are then looked up in the long lists, shortest first, and dropped as
    soon as what is left cannot reach the overlap that the similarity asks for.
    """
    sizes = np.array([len(s) for s in indexed], np.int64)
    flat = np.concatenate(indexed)
    owner = np.repeat(np.arange(len(indexed)), sizes)
    order = np.argsort(flat, kind="stable")  # owners ascend within a list
    names, start = np.unique(flat[order], return_index=True)
    owner, stop = owner[order], np.append(start[1:], len(flat))
    groups = {int(x): k for k, x in enumerate(np.unique(np.concatenate((q_group, i_group))))}
    parent = list(range(len(groups)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    mine = np.array([groups[int(x)] for x in i_group])
    roots = mine.copy()
    out: list[tuple[int, int]] = []
    for q, s in enumerate(queries):
        at = np.searchsorted(names, s)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == s)]
        least = _need(len(s), percent)
        if len(at) < least:
            continue
        at = at[np.argsort(stop[at] - start[at], kind="stable")]
        apart = max(0, least - 1 - least // 10)
        short, long = at[: len(at) - apart], at[len(at) - apart :]
        merged = np.sort(np.concatenate([owner[start[k] : stop[k]] for k in short]), kind="stable")  # merges the sorted lists
        at = np.flatnonzero(np.diff(merged, prepend=-1))
        found, count = merged[at], np.diff(at, append=len(merged))
        # overlap that each indexed set would need: percent / (100 + percent) of both sizes
        target = -(-percent * (sizes[found] + len(s)) // (100 + percent))
        own = find(groups[int(q_group[q])])
        keep = (count >= target - len(long)) & (roots[found] != own)
        found, count, target = found[keep], count[keep], target[keep]
        for k, name in enumerate(long):
            if not len(found):
                break
            members = owner[start[name] : stop[name]]
            place = np.minimum(np.searchsorted(members, found), len(members) - 1)
            count = count + (members[place] == found)
            keep = count + (len(long) - 1 - k) >= target
            if not keep.all():
                found, count, target = found[keep], count[keep], target[keep]
        for c in found.tolist():
            a, b = find(groups[int(q_group[q])]), find(int(mine[c]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((q, c))
        if len(found):
            roots = np.array([find(x) for x in mine.tolist()])
    return out
