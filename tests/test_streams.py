import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from hammerline.plans import texts
from hammerline.streaming import streams

KIND = "user_id long, event_type string, ts timestamp, event_id long, value double"
DAY = dt.datetime(2024, 5, 1, 12)


def _land(spark, folder, rows):
    """One more file of the table."""
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def _event(user, kind, minutes, number, value=1.0):
    return (user, kind, DAY + dt.timedelta(minutes=minutes), number, value)


def _stream(spark, folder, files=1):
    return streams.landed(spark, str(folder), "events", files)


def _state(tmp_path):
    return f"file://{tmp_path}/state-{uuid.uuid4().hex}"


def test_latest_over_many_batches_late_rows_and_a_restart(spark, tmp_path):
    state = _state(tmp_path)
    run = lambda: {(r.user_id, r.event_type): r.event_id for r in streams.run_to_table(_stream(spark, tmp_path).drop("value"), "append", ["user_id", "event_type"], ["ts", "event_id"], state).collect()}
    _land(spark, tmp_path, [_event(1, "a", 10, 1), _event(2, "a", 10, 2)])
    _land(spark, tmp_path, [_event(1, "a", 30, 3)])
    assert run() == {(1, "a"): 3, (2, "a"): 2}
    _land(spark, tmp_path, [_event(1, "a", 20, 9), _event(2, "a", 10, 4), _event(None, "b", 0, 5)])  # late; a tie of time; a null key
    assert run() == {(1, "a"): 3, (2, "a"): 4, (None, "b"): 5}
    assert run() == {(1, "a"): 3, (2, "a"): 4, (None, "b"): 5}  # nothing new
    parts = spark.read.parquet(f"{state}/parts")
    assert sorted(r.part for r in parts.select("part").distinct().collect()) == [0, 1, 2] and parts.count() == 6


def test_a_batch_that_runs_again_replaces_its_part(spark, tmp_path):
    state = _state(tmp_path)
    _land(spark, tmp_path, [_event(1, "a", 10, 1)])
    rows = lambda: streams.run_to_table(_stream(spark, tmp_path), "append", folder=state)
    assert rows().count() == 1
    (tmp_path / state.rsplit("/", 1)[1] / "state" / "commits" / "0").unlink()  # written, but not yet committed when it stopped
    (tmp_path / state.rsplit("/", 1)[1] / "state" / "commits" / ".0.crc").unlink(missing_ok=True)
    _land(spark, tmp_path, [_event(1, "a", 11, 2)])
    assert sorted(r.event_id for r in rows().collect()) == [1, 2]


def test_stateless_stream_keeps_the_rows_of_all_batches(spark, tmp_path):
    for k in range(3):
        _land(spark, tmp_path, [_event(k, "a", k, k)])
    assert sorted(r.user_id for r in streams.run_to_table(_stream(spark, tmp_path), "append", folder=_state(tmp_path)).collect()) == [0, 1, 2]


def test_windowed_counts_go_on_after_a_restart(spark, tmp_path):
    state = _state(tmp_path)
    run = lambda: {(r.user_id, r.n, r.over) for r in streams.run_to_table(streams.rate_count(_stream(spark, tmp_path), 2), "complete", folder=state).collect()}
    _land(spark, tmp_path, [_event(1, "a", 0, 1), _event(2, "a", 0, 2)])
    assert run() == {(1, 1, False), (2, 1, False)}
    _land(spark, tmp_path, [_event(1, "a", 0, 3), _event(1, "b", 0.5, 4)])
    assert run() == {(1, 3, True), (2, 1, False)}


def test_a_stream_of_no_rows_has_an_empty_result(spark, tmp_path):
    _land(spark, tmp_path, [])
    found = streams.run_to_table(_stream(spark, tmp_path), "append", ["user_id"], ["event_id"], _state(tmp_path))
    assert found.count() == 0 and found.columns == _stream(spark, tmp_path).columns


def test_the_shared_folder_must_be_named_off_local_masters(spark):
    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        streams.shared_dir(Session())


def test_registered_streams_equal_batch_results(spark):
    folder = "/root/testdata/sf0.001"
    got = texts.QUERIES["stream_upsert_observations"](spark, folder)
    events = spark.read.parquet(f"{folder}/events.parquet")
    want = events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
