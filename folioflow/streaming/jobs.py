"""Jobs as streams with state and timers: approvals that time out, parents that follow their children.

Both give, at the end of the input, what the batch functions of ``operators.jobs`` give; rows are updates, the one of the
highest ``version`` of a key holds.  State lies in RocksDB, a value or a map entry for each job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import status_of
from ..plans.staging import new_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 60 * 60 * 1000
#: Up to so many entries of a map are read one by one, more by one pass over it; rows told at once.
FEW, TOLD_ROWS = 1000, 10_000


def _with_state(spark: SparkSession) -> None:
    """State with timers and maps needs RocksDB: for the session from then on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ms(ts: pd.Series) -> list[int]:
    return [int(t.timestamp() * 1000) for t in pd.to_datetime(ts, utc=True)]


class Approvals(StatefulProcessor):
    """State of one job: when it began, its first signal, the state last told and that telling's number."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started long, signal_at long, signal string, told string, version int")

    def _tell(self, key: tuple, started: int, at: int | None, signal: str | None, told: str | None, version: int, now: int) -> Iterator[pd.DataFrame]:
        deadline = started + self.days * DAY_MS
        inside = at is not None and at <= deadline
        state = ("APPROVED" if signal == "approve" else "REJECTED") if inside else "REJECTED" if deadline < now else "PENDING"
        version += state != told
        self.job.update((started, at, signal, state, version))
        if state != told:
            yield pd.DataFrame({"workflow_id": [key[0]], "state": [state], "version": [version]})

    def handleInputRows(self, key, rows, timerValues):
        started, at, signal, told, version = self.job.get() if self.job.exists() else (None, None, None, None, 0)
        before = started
        for batch in rows:
            times = _ms(batch["ts"])
            started = min(times) if started is None else min(started, *times)
            for t, s in zip(times, batch["signal"], strict=True):
                if isinstance(s, str) and (at is None or (t, s) < (at, signal)):
                    at, signal = t, s
        if started != before:
            if before is not None:
                self.handle.deleteTimer(before + self.days * DAY_MS + 1)
            # a timer fires, without any event of this job, once the watermark is past the deadline
            self.handle.registerTimer(started + self.days * DAY_MS + 1)
        yield from self._tell(key, started, at, signal, told, version, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.job.exists():
            yield from self._tell(key, *self.job.get(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def approvals_stream(events: DataFrame, *, days: int = 7, late: str = "2 hours") -> DataFrame:
    """workflow_id, state, version from a stream of events (workflow_id, ts, signal: approve, reject or null).

    A job begins with its earliest event.  The first signal within ``days`` decides; where none comes, a timer rejects the
    job when the watermark, moved by any job's events, passes the deadline.  Late events correct what was told.
    """
    _with_state(events.sparkSession)
    kind = events.schema["workflow_id"].dataType.simpleString()
    rows = events.select("workflow_id", F.col("ts").cast("timestamp").alias("ts"), "signal").withWatermark("ts", late)
    return rows.groupBy("workflow_id").transformWithStateInPandas(Approvals(days), f"workflow_id {kind}, state string, version int", "Update", "EventTime")


class Overrides(StatefulProcessor):
    """State of one child: its own last status, and for each parent what that saw last, with the numbers of their events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", "event_id long, status string")
        self.seen = handle.getMapState("seen", "workflow_id string", "event_id long, status string, told string, version int")

    def handleInputRows(self, key, rows, timerValues):
        event, status = self.own.get() if self.own.exists() else (None, None)
        before, last = status, {}
        # the rows are folded first: state is read and written once a parent, not once an event
        for batch in rows:
            newest = batch.sort_values("event_id", kind="stable").drop_duplicates(["own", "workflow_id"], keep="last")
            for workflow, own, number, new in zip(newest["workflow_id"], newest["own"], newest["event_id"], newest["status"], strict=True):
                if own:
                    if event is None or number > event:
                        event, status = int(number), new
                elif workflow not in last or number > last[workflow][0]:
                    last[workflow] = (int(number), new)
        if event is not None:
            self.own.update((event, status))
        known = self.seen.exists()
        held = {k[0]: v for k, v in self.seen.iterator()} if known and (status != before or len(last) > FEW) else {}
        if known and not held:
            held = {w: self.seen.getValue((w,)) for w in last if self.seen.containsKey((w,))}
        # a new own status reaches every parent, a parent's event that parent alone
        told = []
        for workflow in {**held, **last}:
            number, saw, said, version = held.get(workflow, (None, None, None, 0))
            newer = workflow in last and (number is None or last[workflow][0] > number)
            if not newer and status == before:
                continue
            if newer:
                number, saw = last[workflow]
            now = status if status is not None else saw
            if newer or now != said:
                self.seen.updateValue((workflow,), (number, saw, now, version + (now != said)))
            if now != said:
                told.append((workflow, key[0], now, version + 1))
        for start in range(0, len(told), TOLD_ROWS):
            yield pd.DataFrame(told[start : start + TOLD_ROWS], columns=["workflow_id", "ref", "status", "version"])

    def close(self) -> None:
        pass


def child_overrides_stream(events: DataFrame, own_ref: str) -> DataFrame:
    """workflow_id, ref, status, version: what a job shows of each child, the child's own status as soon as that is known.

    ``events``: workflow_id, ref, event_id, event_type.  A job's own status comes from its events about ``own_ref``.
    Every event goes to the child that it speaks of, and an own event to the job itself, so a child's news reach all parents.
    """
    _with_state(events.sparkSession)
    known = events.select("workflow_id", "ref", "event_id", status_of(F.col("event_type")).alias("status")).where("status is not null")
    roles = F.array(F.struct(F.col("ref").alias("child"), F.lit(False).alias("own")), F.struct(F.when(F.col("ref") == own_ref, F.col("workflow_id")).alias("child"), F.lit(True).alias("own")))
    routed = known.withColumn("role", F.explode(roles)).select("role.child", "role.own", "workflow_id", "event_id", "status").where("child is not null")
    return routed.groupBy("child").transformWithStateInPandas(Overrides(), "workflow_id string, ref string, status string, version int", "Update", "None")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a finished stream of updates that hold; it reads all that there is to read and ends."""
    spark = updates.sparkSession
    rows, checkpoint = new_path(spark, "updates"), new_path(spark, "stream")
    query = (
        updates.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")).start()
    )
    query.awaitTermination()
    others = [c for c in updates.columns if c not in (*keys, "version")]
    told = spark.read.schema(updates.schema).parquet(rows)
    return told.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("r")).select(*keys, "r.*")
