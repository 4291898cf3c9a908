"""Quotas, sessions and counts that work on tables and on streams alike, and the streaming forms of the rest."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cues import REQUEST_LOG
from ..operators import metrics
from ..policy import PostprocessConfig
from ..storage import shared_folder

QUOTA_CALLS, QUOTA_SECONDS, QUOTA_HOURS = 100, 21_600, 12


def rolling_quota(events: DataFrame) -> DataFrame:
    """Calls and seconds of a service in the 12 hours up to each event, and whether they are within the quota. Exact; for tables.

    Events meet in stretches of 12 hours, each with the stretch before it, so a hot service is many groups, not one. Events
    of one and the same time count each other.
    """
    reach = QUOTA_HOURS * 3_600_000_000
    e = events.select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("of", F.floor(F.col("us") / reach)).withColumn("stretch", F.explode(F.array("of", F.col("of") + 1)))
    w = Window.partitionBy("user_id", "stretch").orderBy("us").rangeBetween(-reach, 0)
    e = e.withColumns({"calls": F.count(F.lit(1)).over(w), "seconds": F.round(F.sum("value").over(w), 6)}).where(F.col("of").eqNullSafe(F.col("stretch")))
    return e.select("event_id", "user_id", "calls", "seconds", _allowed().alias("allowed"))


def _allowed():
    return (F.col("calls") <= QUOTA_CALLS) & (F.col("seconds") <= QUOTA_SECONDS)


class _Quota(StatefulProcessor):
    """Holds a service's last 12 hours of calls, and calls whose turn hasn't come. A call is answered once the watermark has reached it: none before it can come any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "us long, value double, event_id long, answered boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for b in rows for r in zip(b["us"].tolist(), [None if v is None or v != v else float(v) for v in b["value"].tolist()], b["event_id"].tolist(), [False] * len(b), strict=True)]
        self.calls.appendList(new)
        self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.calls.get()), key=lambda r: (r[0], str(r[2])))
        us = np.array([r[0] for r in held], np.int64)
        upto = np.concatenate(([0], np.cumsum([r[1] is not None for r in held])))
        due = [i for i, r in enumerate(held) if not r[3] and r[0] <= reached]
        a = np.searchsorted(us, us[due] - QUOTA_HOURS * 3_600_000_000, side="left")
        b = np.searchsorted(us, us[due], side="right")
        sums = [None if upto[y] == upto[x] else round(math.fsum(r[1] for r in held[x:y] if r[1] is not None), 6) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        keep = [(*r[:3], r[3] or r[0] <= reached) for r in held if r[0] > reached - QUOTA_HOURS * 3_600_000_000]
        if keep:
            self.calls.put(keep)
        else:
            self.calls.clear()
        waiting = [r[0] for r in keep if not r[3]]
        # Without calls that wait, one more timer lets go of the last hours.
        if keep:
            self.handle.registerTimer(-(-min(waiting) // 1000) if waiting else -(-(keep[-1][0] + QUOTA_HOURS * 3_600_000_000) // 1000))
        if due:
            yield pd.DataFrame({"event_id": [held[i][2] for i in due], "user_id": key[0], "calls": b - a, "seconds": sums})

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``rolling_quota`` of a stream, row by row: an event is answered when the watermark, ``late`` behind the newest, has reached it.

    Events up to ``late`` out of order count as if they had come in order; later ones are dropped, and so is nothing else.
    Each service keeps its last 12 hours of calls and those that wait. Null ids of services form one; events without a time
    are dropped. The session needs the RocksDB state store provider (``spark.sql.streaming.stateStore.providerClass``).
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(F.col("ts").isNotNull())
    e = e.select("ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "user_id", F.col("value").cast("double").alias("value"))
    counted = e.groupBy("user_id").transformWithStateInPandas(_Quota(), f"event_id long, user_id {e.schema['user_id'].dataType.simpleString()}, calls long, seconds double", "Append", "EventTime")
    return counted.withColumn("allowed", _allowed())


def run_through(live: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows that ``build`` gives of all that ``live`` has now, from a Parquet sink in the shared folder."""
    spark = live.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = build(live)
    query = out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``(user_id, first_ts, last_ts, n)``: runs of events less than ``gap`` apart. On a stream give ``late``; a session closes with the watermark."""
    e = events if late is None else events.withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "first_ts", "last_ts", "n")


def tail_log(spark, folder: str) -> DataFrame:
    """The request log as a stream of the JSON lines that arrive in ``folder``; bad lines are dropped."""
    return spark.readStream.schema(REQUEST_LOG).option("mode", "DROPMALFORMED").json(folder)


def usage_stream(log: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Calls and tokens by role, stage and hour; run it in update mode."""
    g = log.withWatermark("time", late).groupBy(F.window("time", every).alias("hour"), "role", "stage")
    return g.agg(F.count(F.lit(1)).alias("calls"), F.sum("usage.input_tokens").alias("input_tokens"), F.sum("usage.output_tokens").alias("output_tokens"))


def audit_stream(cues: DataFrame, cfg: PostprocessConfig = PostprocessConfig(), late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Hard and comfort findings as cues arrive, by minute of ``arrived``."""
    s = metrics.sides(cues.withColumn("media_id", F.struct("media_id", "arrived")))
    hard, comfort = F.when(F.col("is_cjk"), cfg.max_cps_cjk).otherwise(cfg.max_cps_latin), F.when(F.col("is_cjk"), cfg.comfort_cps_cjk).otherwise(cfg.comfort_cps_latin)
    s = s.withColumn("kind", F.when(F.col("cps") > hard, "hard").when(F.col("cps") > comfort, "comfort")).where(F.col("kind").isNotNull())
    s = s.select(F.col("media_id.arrived").alias("arrived"), "kind", "is_cjk").withWatermark("arrived", late)
    return s.groupBy(F.window("arrived", every).alias("minute"), "kind", "is_cjk").agg(F.count(F.lit(1)).alias("n"))


def answer_once(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests whose key hasn't come within the watermark's reach."""
    return requests.withWatermark("time", late).dropDuplicatesWithinWatermark(["key"])
