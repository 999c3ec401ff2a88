"""Places after edits against edits that are made one by one, on lists and on files."""

import random

from pyspark.sql import functions as F

from quirelake.fixtures import builder as b
from quirelake.operators import edit, page_order
from quirelake.sources.pdf import PdfCorpus

EDITS = "file_id string, seq int, op string, at int, page int, pages array<int>"


def applied(n, steps):
    """(page, seq) in order, by editing a list."""
    pages = [(i, None) for i in range(n)]
    for _, seq, op, at, page, listed in sorted(steps, key=lambda s: s[1]):
        clamp = lambda top: max(0, min(at or 0, top))  # noqa: B023, E731
        if op in ("insert_blank", "insert_copy"):
            page = 0 if page is None else page
            made = pages[page][0] if op == "insert_copy" and 0 <= page < len(pages) else None
            pages.insert(clamp(len(pages)), (made, seq))
        elif op == "remove":
            gone = set(listed or [-1 if page is None else page])
            pages = [p for i, p in enumerate(pages) if i not in gone]
        elif op == "move" and page is not None and 0 <= page < len(pages):
            to = clamp(len(pages) - 1)
            pages.insert(to, pages.pop(page))
    return pages


def steps_of(rng, f, n):
    number = lambda: rng.choice([None, *range(-1, n + 3)])
    return [(f, seq, rng.choice(["insert_blank", "insert_copy", "insert_copy", "remove", "move", "move", "rotate"]), number(), number(), rng.choice([None, None, [], [0], [1, 3, 1, 99]])) for seq in rng.sample(range(100), rng.randint(0, 14))]


def test_places_of_random_edits(spark):
    rng = random.Random(1)
    counts = {f"f{i}": rng.randint(0, 9) for i in range(60)}
    steps = [s for f, n in counts.items() for s in steps_of(rng, f, n)]
    pages = spark.createDataFrame([(f, i, "x") for f, n in counts.items() for i in range(n)], "file_id string, page_index int, place string")
    got = {}
    for r in page_order.places(pages, spark.createDataFrame(steps, EDITS)).orderBy("file_id", "place").collect():
        got.setdefault(r.file_id, []).append((r.place, r.page_index, r.seq))
    for f, n in counts.items():
        want = [(k, *p) for k, p in enumerate(applied(n, [s for s in steps if s[0] == f]))]
        assert got.get(f, []) == want, f


def test_places_are_those_of_written_files(spark):
    rng = random.Random(2)
    files, steps = [], []
    for i in range(8):
        n = rng.randint(2, 6)
        files.append((f"f{i}", bytearray(b.document("\n".join(f"page {k}" for k in range(n)), one_page_a_line=True))))
        steps += [s for s in steps_of(rng, f"f{i}", n) if s[2] not in ("rotate", "remove")]
    corpus, edits = PdfCorpus(spark.createDataFrame(files, "file_id string, content binary")), spark.createDataFrame(steps, EDITS)
    written = PdfCorpus(edit.edit(corpus, edits.withColumn("pages", F.lit(None).cast("array<int>"))))
    text = written.pages.select("file_id", F.col("page_index").alias("place")).join(written.page_text.withColumnRenamed("page_index", "place"), ["file_id", "place"], "left").select("file_id", "place", "text")
    own = page_order.places(corpus.pages, edits).join(edits.select("file_id").distinct(), "file_id")
    told = own.select("file_id", "place", F.when(F.col("page_index").isNotNull(), F.concat(F.lit("page "), F.col("page_index"))).alias("text"))
    assert sorted(map(tuple, told.collect()), key=repr) == sorted(map(tuple, text.collect()), key=repr)


def test_nothing(spark):
    pages = spark.createDataFrame([("f", 0), ("f", 1)], "file_id string, page_index int")
    none = spark.createDataFrame([], EDITS)
    assert sorted((r.place, r.page_index) for r in page_order.places(pages, none).collect()) == [(0, 0), (1, 1)]
    assert page_order.places(pages.limit(0), none).count() == 0
    only = page_order.places(pages.limit(0), spark.createDataFrame([("g", 1, "insert_blank", 5, None, None)], EDITS)).collect()
    assert [tuple(r) for r in only] == [("g", 0, None, 1)]
