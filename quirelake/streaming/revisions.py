"""The newest revision of every object, kept as state of a stream.

Each key holds how new its newest revision is; a batch's rows change it where they are newer and leave it where they are late or come again, so revisions may come in any
order and any number of times. What changed is written once a batch; nothing that was written is read again. Removed objects are
remembered, because an older revision may still come, until a timer says that the watermark has passed them by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """State of a key: version and rank of its newest row, and whether that one removes it."""

    def __init__(self, columns: list[str], forget: int | None):
        self.columns, self.forget = columns, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "version long, rank string, removed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.newest.get())[:2] if self.newest.exists() else None
        best, found = held, None
        for part in rows:
            part.columns = [*self.columns, "_version", "_removed", "_rank"]  # computed columns come without their names
            order = pd.DataFrame({"v": part["_version"], "r": part["_rank"]}).sort_values(["v", "r"])
            last = order.index[-1]
            now = (int(order.at[last, "v"]), str(order.at[last, "r"]))
            if best is None or now > best:
                best, found = now, part.loc[[last]]
        if found is None:
            return
        removed = bool(found["_removed"].iloc[0])
        self.newest.update((*best, removed))
        if self.forget is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if removed:
                self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), best[0]) + self.forget)
        yield found[[*self.columns, "_version", "_removed"]].reset_index(drop=True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and self.newest.get()[2]:
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(log: DataFrame, key: list[str], version: F.Column, removed: F.Column, forget_ms: int | None = None) -> DataFrame:
    """Of a stream, the rows that are the newest of their key when they come: all columns, ``_version`` and ``_removed``.

    ``version`` is a long; of equal ones the row with the larger text of its values counts. With ``forget_ms`` versions are event times in milliseconds, the stream has
    a watermark, and a removed key is forgotten that long after it.
    """
    spark = log.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    columns = list(log.columns)
    ranked = log.withColumn("_version", version.cast("long")).withColumn("_removed", removed).withColumn("_rank", F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))
    schema = T.StructType([*log.schema.fields, T.StructField("_version", T.LongType()), T.StructField("_removed", T.BooleanType())])
    grouped = ranked.groupBy(*key)
    return grouped.transformWithStateInPandas(_Newest(columns, forget_ms), schema, "Update", "None" if forget_ms is None else "EventTime")


def follow(changed: DataFrame, out: str, checkpoint: str):
    """Write what changes below ``out``, a folder a batch (a retried batch overwrites its own), for all that is there now."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """The newest row of every key that isn't removed, from what was written: the last change of each key."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", out).parquet(out)
    rest = [f.name for f in schema.fields if f.name not in (*key, "_version", "_removed")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest, "_removed"), "batch").alias("v"))
    return last.where("not v._removed").select(*key, *[F.col(f"v.`{c}`").alias(c) for c in rest])
