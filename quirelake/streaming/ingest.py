"""Structured Streaming: PDF tables over a growing directory, and windows over events (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pdf import PdfCorpus, few_tasks, folders

_BINARY = "path string, modificationTime timestamp, length long, content binary"


#: Bytes of files in a batch. A number of files would make the more batches the smaller files are, and each looks at the list of all.
BATCH = 2 << 30
#: A batch names its files one by one, and Spark looks each up, by default in up to 10,000 tasks whose records stay on the driver, and keeps what it finds.
_LOOKUPS, _KEPT = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.manageFilesourcePartitions"


def stream_files(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_trigger: int | None = None) -> DataFrame:
    most = ("maxBytesPerTrigger", BATCH) if files_per_trigger is None else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).option(*most).load(path)


def ingest(spark: SparkSession, path: str, out: str, kinds: list[str], checkpoint: str, pattern: str = "*.pdf", part: str = ""):
    """Append each new file's tables below ``out``, once for what is there now.

    A batch is one folder (``batch=N``, in ``part``) that a retried batch overwrites, so every file counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        # the time travels in front of the path, so that files are read once and nothing is joined
        named = F.concat_ws(" ", F.unix_micros("modificationTime"), "path").alias("file_id")
        corpus = PdfCorpus(few_tasks(batch).where("length >= 8").select(named, "content"))
        at = F.instr("file_id", " ")
        for kind in kinds:
            table = corpus.table(kind).withColumn("modificationTime", F.timestamp_micros(F.substring("file_id", F.lit(1), at - 1).cast("long")))
            table.withColumn("file_id", F.substr("file_id", at + 1)).write.mode("overwrite").parquet(f"{out}/{kind}/{part}batch={number}")

    return stream_files(spark, path, pattern).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_folders(spark: SparkSession, path: str, out: str, kinds: list[str], checkpoint: str, pattern: str = "*.pdf") -> None:
    """``ingest`` of each folder in ``path`` (``folder=NAME`` below each table), one stream after another, each with a checkpoint of its own.

    A stream holds the list of all files that are there on the driver, so this bounds it by the largest folder.
    """
    before = {k: spark.conf.get(k) for k in (_LOOKUPS, _KEPT)}
    spark.conf.set(_LOOKUPS, str(4 * spark.sparkContext.defaultParallelism))
    spark.conf.set(_KEPT, "false")
    try:
        for name in folders(spark, path):
            ingest(spark, f"{path}/{name}", out, kinds, f"{checkpoint}/{name}", pattern, f"folder={name}/").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def newest_version(table: DataFrame) -> DataFrame:
    """Rows of each file's newest version."""
    last = table.groupBy("file_id").agg(F.max("modificationTime").alias("modificationTime"))
    return table.join(last, ["file_id", "modificationTime"])


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts and sums by type, for streams or tables with ts, event_type and value."""
    at = F.window("ts", size, slide or size)
    return events.withWatermark("ts", late).groupBy(at, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")
