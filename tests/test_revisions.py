"""Revisions that come late, twice and in any order give the newest of each key."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake.streaming import revisions

SCHEMA = "file_id string, obj_num long, at long, kind string, gone boolean"


def run(spark, path, batches, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        if options:
            stream = stream.withColumn("time", F.timestamp_millis("at")).withWatermark("time", "0 seconds")
        changed = revisions.changes(stream, ["file_id", "obj_num"], F.col("at"), F.col("gone"), **options)
        revisions.follow(changed, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return changed


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = [(f"f{rng.randrange(3)}", rng.randrange(6), rng.randrange(50), rng.choice(["a", "b", "c"]), rng.random() < 0.2) for _ in range(120)]
    sent = log + rng.sample(log, 40)
    rng.shuffle(sent)
    changed = run(spark, str(tmp_path), [sent[:60], sent[60:61], sent[61:]])
    got = {(r.file_id, r.obj_num): (r.at, r.kind) for r in revisions.current(spark, f"{tmp_path}/out", changed.schema, ["file_id", "obj_num"]).collect()}
    rank = lambda r: (r[2], f'{{"file_id":"{r[0]}","obj_num":{r[1]},"at":{r[2]},"kind":"{r[3]}","gone":{str(r[4]).lower()}}}')
    newest = {}
    for r in log:
        if (r[0], r[1]) not in newest or rank(r) > rank(newest[r[0], r[1]]):
            newest[r[0], r[1]] = r
    assert got == {k: (r[2], r[3]) for k, r in newest.items() if not r[4]}
    written = spark.read.parquet(f"{tmp_path}/out").count()
    assert written <= len(newest) * 3  # a key is written once a batch at most


def test_removed_keys_are_forgotten_after_a_time(spark, tmp_path):
    batches = [[("f", 1, 1_000, "a", False), ("f", 1, 2_000, "b", True)], [("f", 1, 1_500, "late", False)], [("f", 2, 60_000, "c", False)], [("f", 2, 61_000, "c", False)], [("f", 1, 62_000, "new", False)]]
    changed = run(spark, str(tmp_path), batches, forget_ms=10_000)
    got = sorted((r.obj_num, r.kind) for r in revisions.current(spark, f"{tmp_path}/out", changed.schema, ["file_id", "obj_num"]).collect())
    assert got == [(1, "new"), (2, "c")]
    assert [r.kind for r in spark.read.parquet(f"{tmp_path}/out").where("kind = 'late'").collect()] == []
