"""Streams with state and timers against the batch functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import jobs as batch
from folioflow.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, rows, schema, folder, files):
    """Rows in order as files, one to a batch."""
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{i:03d}")
    kinds = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_a_job_times_out_without_an_event_of_its_own(spark, tmp_path):
    rows = [("quiet", T0, None), ("yes", T0, None), ("yes", T0 + dt.timedelta(hours=5), "approve"), ("late", T0, None), ("other", T0 + dt.timedelta(days=3), None), ("late", T0 + dt.timedelta(days=3), "approve")]
    events = stream_of(spark, rows, "workflow_id string, ts timestamp, signal string", tmp_path, 3)
    found = jobs.latest(jobs.approvals_stream(events, days=2), ["workflow_id"]).collect()
    assert {r["workflow_id"]: r["state"] for r in found} == {"quiet": "REJECTED", "yes": "APPROVED", "late": "REJECTED", "other": "PENDING"}


@pytest.mark.parametrize("files", [1, 4])
def test_approvals_equal_the_batch(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [(rng.randint(0, 40), T0 + dt.timedelta(minutes=rng.randint(0, 6000)), rng.choice([None, None, None, None, "approve", "reject"])) for _ in range(200)]
    rows.append((99, T0 + dt.timedelta(minutes=6001), None))
    # files are out of order by less than the watermark waits
    ordered = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randint(0, 100)))
    schema = "workflow_id int, ts timestamp, signal string"
    found = jobs.latest(jobs.approvals_stream(stream_of(spark, ordered, schema, tmp_path, files), days=1), ["workflow_id"])
    table = spark.createDataFrame(rows, schema)
    started = table.groupBy("workflow_id").agg(F.min("ts").alias("started"))
    now = F.lit(T0 + dt.timedelta(minutes=6001 - 120)).cast("timestamp")
    expected = batch.approvals(started, table.where("signal is not null"), now, days=1)
    ours = {r["workflow_id"]: r["state"] for r in found.collect()}
    assert ours == {r["workflow_id"]: r["state"] for r in expected.collect()} and set(ours.values()) == {"APPROVED", "REJECTED", "PENDING"}


def test_children_reach_their_parents_as_they_come(spark, tmp_path):
    rng = random.Random(2)
    rows = [(str(rng.randint(0, 12)), str(rng.randint(0, 12)), i, rng.choice(["scheduled", "started", "completed", "failed", "noise"])) for i in range(400)]
    rows += [("13", "14", 1000, "started"), ("14", "0", 1001, "completed")]
    schema = "workflow_id string, ref string, event_id long, event_type string"
    found = jobs.latest(jobs.child_overrides_stream(stream_of(spark, rows, schema, tmp_path, 5), "0"), ["workflow_id", "ref"])
    view = batch.fold_status(spark.createDataFrame(rows, schema).withColumn("message", F.lit("")))
    expected = batch.child_overrides(view, view.where("ref = '0'")).select("workflow_id", "ref", "status")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert ("13", "14", "completed") in {tuple(r) for r in found.collect()}


def test_overrides_read_and_write_state_once_a_parent():
    """A hundred events of two parents take two writes of the map, and the last event counts."""
    import pandas as pd

    from folioflow.streaming.jobs import Overrides

    class Value:
        held, writes = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(Value):
        def __init__(self):
            self.held, self.writes = {}, 0

        def exists(self):
            return bool(self.held)

        def containsKey(self, key):
            return key in self.held

        def getValue(self, key):
            return self.held[key]

        def updateValue(self, key, value):
            self.held[key] = value
            self.writes += 1

        def keys(self):
            return iter(list(self.held))

        def iterator(self):
            return iter(list(self.held.items()))

    one = Overrides()
    one.own, one.seen = Value(), Map()
    batch = pd.DataFrame({"workflow_id": ["a", "b"] * 50, "own": [False] * 100, "event_id": range(100), "status": ["RUNNING"] * 98 + ["FAILED", "COMPLETED"]})
    told = pd.concat(one.handleInputRows(("c",), iter([batch[:60], batch[60:]]), None))
    assert sorted(told.itertuples(index=False, name=None)) == [("a", "c", "FAILED", 1), ("b", "c", "COMPLETED", 1)] and one.seen.writes == 2
    news = pd.DataFrame({"workflow_id": ["c"], "own": [True], "event_id": [7], "status": ["FAILED"]})
    told = pd.concat(one.handleInputRows(("c",), iter([news]), None))
    assert list(told.itertuples(index=False, name=None)) == [("b", "c", "FAILED", 2)]
    old = pd.DataFrame({"workflow_id": ["a"], "own": [False], "event_id": [3], "status": ["RUNNING"]})
    assert not list(one.handleInputRows(("c",), iter([old]), None)) and one.seen.writes == 3
