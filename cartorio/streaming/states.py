"""Keyed stream operators. Each has a batch twin that defines what the stream must give in the end."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State of these operators lives in RocksDB: it outgrows memory with the number of keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def _micros(moment: datetime) -> int:
    return int(pd.Timestamp(moment).value // 1000)


def _millis(moment: datetime) -> int:
    return int(pd.Timestamp(moment).value // 1_000_000)


def _sorted(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame | None:
    frames = [frame for frame in rows if len(frame)]
    return pd.concat(frames).sort_values(order) if frames else None


class ReplayGuard(StatefulProcessor):
    """One record per key: who opened it, when, with which digest. A timer at the end of its life clears it, so
    state holds live keys only. Twin: ``intake.replay_guard``."""

    def __init__(self, ttl_hours: int = 24):
        self.ttl = pd.Timedelta(hours=ttl_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "opened_at timestamp, opened_by bigint, digest string, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _sorted(rows, ["uploaded_at", "upload_id"])
        if batch is None:
            return
        known = self.record.get() if self.record.exists() else None
        live = known
        out = []
        for row in batch.itertuples():
            if live is None or row.uploaded_at >= pd.Timestamp(live[0]).tz_localize(None) + self.ttl:
                live = (row.uploaded_at.to_pydatetime(), int(row.upload_id), row.digest, -(-_micros(row.uploaded_at + self.ttl) // 1000))
                outcome = "NEW"
            else:
                outcome = "REPLAY" if row.digest == live[2] else "CONFLICT"
            out.append((int(row.upload_id), outcome, live[1]))
        if live is not known:
            if known is not None:
                self.handle.deleteTimer(known[3])
            self.handle.registerTimer(live[3])
            self.record.update(live)
        yield pd.DataFrame(out, columns=["upload_id", "outcome", "answered_by"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.record.clear()
        return iter(())

    def close(self) -> None:
        pass


def replay_stream(uploads: DataFrame, ttl_hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Columns read: key, upload_id, digest, uploaded_at (timestamp). Uploads of a key must arrive in time order, ``delay`` late at most."""
    keyed = uploads.filter("key IS NOT NULL").withWatermark("uploaded_at", delay)
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ReplayGuard(ttl_hours), outputStructType="upload_id bigint, outcome string, answered_by bigint", outputMode="Append", timeMode="EventTime"
    )


class StuckWork(StatefulProcessor):
    """Last sign of life per job, with a timer for when it is too old. Twin: ``notices.stuck_work``."""

    def __init__(self, after_seconds: int = 300):
        self.after = after_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_at timestamp, status string, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _sorted(rows, ["seen_at", "status"])
        if batch is None:
            return iter(())
        newest = batch.iloc[-1]
        known = self.last.get() if self.last.exists() else None
        if known is None or (newest["seen_at"], newest["status"]) >= (pd.Timestamp(known[0]).tz_localize(None), known[1]):
            if known is not None and known[2]:
                self.handle.deleteTimer(known[2])
            timer = _millis(newest["seen_at"]) + self.after + 1 if newest["status"] == "RUNNING" else 0
            if timer:
                self.handle.registerTimer(timer)
            self.last.update((newest["seen_at"].to_pydatetime(), newest["status"], timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "details": ["STUCK_JOB_RECOVERED"]})

    def close(self) -> None:
        pass


def stuck_stream(heartbeats: DataFrame, after_seconds: int = 300, delay: str = "1 minute") -> DataFrame:
    """Columns read: job_id, seen_at (timestamp), status."""
    watched = heartbeats.withWatermark("seen_at", delay)
    return watched.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StuckWork(after_seconds), outputStructType="job_id bigint, details string", outputMode="Append", timeMode="EventTime"
    )


class AutoApprove(StatefulProcessor):
    """Pending requests with a timer at the end of the waiting time. Twin: ``lifecycle.auto_approve``."""

    def __init__(self, after_hours: int = 24):
        self.after = after_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _sorted(rows, ["at"])
        if batch is None:
            return iter(())
        for row in batch.itertuples():
            if row.status == "PENDING":
                self.due.update((_millis(row.at) + self.after,))
                self.handle.registerTimer(_millis(row.at) + self.after)
            elif self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
                self.due.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        from cartorio.operators.lifecycle import AUTO_APPROVER

        self.due.clear()
        yield pd.DataFrame({"request_id": [key[0]], "status": ["APPROVED"], "approved_by": [AUTO_APPROVER]})

    def close(self) -> None:
        pass


def approval_stream(requests: DataFrame, after_hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """Columns read: request_id, at (timestamp), status (PENDING opens, anything else closes)."""
    return requests.withWatermark("at", delay).groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=AutoApprove(after_hours), outputStructType="request_id bigint, status string, approved_by string", outputMode="Append", timeMode="EventTime"
    )


def depth_per_minute(jobs: DataFrame, delay: str | None = None, time: str = "at", width: str = "1 minute") -> DataFrame:
    """Jobs per status and minute; with a watermark delay the same plan runs on a stream."""
    watched = jobs.withWatermark(time, delay) if delay else jobs
    counted = watched.groupBy(F.window(time, width), "status").agg(F.count(F.lit(1)).alias("jobs"))
    return counted.select(F.col("window.start").alias("minute"), "status", "jobs")
