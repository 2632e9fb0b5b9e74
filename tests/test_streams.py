"""The commit log under kills and replays, sessions out of state, and rows behind the watermark."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.sources.sinks import ids_digest
from panelspark.streaming import commits, jobs, sessions

KIND = "event_id bigint, user_id bigint, event_type string, ts timestamp, value double"
START = dt.datetime(2024, 1, 1)


def file_of(spark, path, rows):
    made = [(i, u, k, None if h is None else START + dt.timedelta(hours=h), float(v)) for i, u, k, h, v in rows]
    spark.createDataFrame(made, KIND).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path):
    return spark.readStream.schema(spark.createDataFrame([], KIND).schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def landing(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    file_of(spark, path, [(1, 1, "a", 0, 1), (2, 1, "b", 1, 2), (2, 1, "b", 1, 2)])
    file_of(spark, path, [(2, 1, "b", 1, 2), (3, 2, "a", 2, -1), (4, 2, "b", 3, 4)])
    return path


def state(spark, path):
    rows = commits.committed(spark, path, "data", spark.createDataFrame([], KIND).schema)
    return sorted(r["event_id"] for r in rows.collect())


def test_commit_log_takes_each_key_once_and_rejects_apart(spark, landing, tmp_path):
    out = f"file://{tmp_path}/out"
    bad = F.when(F.col("value") < 0, "negative")
    rows = commits.collect(stream_of(spark, landing), out, "r1", ["event_id"], bad)
    assert sorted(r["event_id"] for r in rows.collect()) == [1, 2, 4]
    assert [(r["event_id"], r["reason"]) for r in commits.quarantined(spark, out, spark.createDataFrame([], KIND).schema).collect()] == [(3, "negative")]
    record = commits.runs(spark, out).first()
    assert (record["status"], record["batches"], record["n_in"], record["n_fresh"], record["n_rejected"]) == ("PARTIAL", 2, 6, 3, 1)
    file_of(spark, landing, [(9, 9, "a", 5, 1)])
    assert sorted(r["event_id"] for r in commits.collect(stream_of(spark, landing), out, "r1", ["event_id"], bad).collect()) == [1, 2, 4]
    again = commits.collect(stream_of(spark, landing), out, "r2", ["event_id"], bad)
    assert sorted(r["event_id"] for r in again.collect()) == [1, 2, 4, 9]
    told = {r["run"]: (r["n_in"], r["n_fresh"]) for r in commits.runs(spark, out).collect()}
    assert told == {"r1": (6, 3), "r2": (7, 1)}
    for bad_id in ("", "none", "a/b", "../x"):
        with pytest.raises(ValueError):
            commits.collect(stream_of(spark, landing), out, bad_id, ["event_id"])


def test_a_kill_between_data_and_commit_leaves_nothing_and_is_replayed(spark, landing, tmp_path, monkeypatch):
    out, real = f"file://{tmp_path}/out", commits.commit

    def dies(s, path, run, batch, counts):
        if batch == 1:
            raise RuntimeError("killed before the commit")
        real(s, path, run, batch, counts)

    monkeypatch.setattr(commits, "commit", dies)
    with pytest.raises(Exception, match="killed before the commit"):
        commits.collect(stream_of(spark, landing), out, "r1", ["event_id"])
    assert state(spark, out) == [1, 2]
    record = commits.runs(spark, out).first()
    assert record["status"] == "FAILED" and "killed" in record["note"] and record["batches"] == 1
    assert spark.read.parquet(f"{out}/data/run=r1/batch=1").count() == 2
    monkeypatch.setattr(commits, "commit", real)
    commits.collect(stream_of(spark, landing), out, "r1", ["event_id"])
    assert state(spark, out) == [1, 2, 3, 4]
    assert commits.runs(spark, out).first()["status"] == "COMPLETE"
    found = {r["event_type"]: (r["n"], r["digest"]) for r in commits.manifests(spark, out, spark.createDataFrame([], KIND).schema).collect()}
    whole = commits.committed(spark, out, "data", spark.createDataFrame([], KIND).schema).groupBy("event_type").agg(F.count("*").alias("n"), ids_digest(F.col("event_id")).alias("digest"))
    assert found == {r["event_type"]: (r["n"], r["digest"]) for r in whole.collect()}


def test_null_keys_and_empty_batches(spark, tmp_path):
    landing, out = f"file://{tmp_path}/landed", f"file://{tmp_path}/out"
    file_of(spark, landing, [(None, 1, "a", None, 1), (None, 1, "a", 1, 1)])
    file_of(spark, landing, [(None, 2, "a", 1, 1)])
    spark.createDataFrame([], KIND).coalesce(1).write.mode("append").parquet(landing)
    assert commits.collect(stream_of(spark, landing), out, "r1", ["event_id"]).count() == 1


def test_sessions_out_of_state_and_late_rows(spark, tmp_path):
    landing, out = f"file://{tmp_path}/landed", f"file://{tmp_path}/out"
    file_of(spark, landing, [(1, 7, "a", 0, 1), (2, 7, "a", 5, 1), (3, 7, "a", 11, 1), (4, None, "a", 2, 1)])
    file_of(spark, landing, [(5, 7, "a", 40, 1), (6, 8, "a", 200, 1)])
    file_of(spark, landing, [(11, 8, "a", 201, 1)])  # rows are late by the watermark of the batch before
    file_of(spark, landing, [(7, 7, "a", 3, 1), (8, 7, "a", 41, 1), (9, 8, "a", 204, 1), (10, 8, "a", None, 1)])
    rows, late = sessions.run_counting_late(sessions.closed_sessions(stream_of(spark, landing)), out)
    hours = lambda t: (t - START).total_seconds() / 3600
    found = sorted((r["user_id"] or 0, hours(r["start"]), hours(r["end"]), r["n"]) for r in rows.collect())
    # 5 and 11 are a whole gap apart; hours 3 and 41 come behind the watermark of hour 176; 200 to 204 is still open
    assert found == [(0, 2, 8, 1), (7, 0, 11, 2), (7, 11, 17, 1), (7, 40, 46, 1)]
    assert late == 2


def test_open_spans_merge_across_batches(spark, tmp_path):
    landing, out = f"file://{tmp_path}/landed", f"file://{tmp_path}/out"
    file_of(spark, landing, [(1, 7, "a", 0, 1), (2, 7, "a", 9, 1)])
    file_of(spark, landing, [(3, 7, "a", 5, 1)])
    file_of(spark, landing, [(4, 8, "a", 100, 1)])
    rows, late = sessions.run_counting_late(sessions.closed_sessions(stream_of(spark, landing)), out)
    assert [(r["user_id"], r["n"]) for r in rows.collect()] == [(7, 3)] and late == 0


def test_duplicates_within_and_beyond_the_watermark(spark, tmp_path):
    landing, out = f"file://{tmp_path}/landed", f"file://{tmp_path}/out"
    file_of(spark, landing, [(1, 1, "a", 0, 1)])
    file_of(spark, landing, [(1, 1, "a", 12, 1), (2, 1, "a", 240, 1)])
    file_of(spark, landing, [(4, 1, "a", 240, 1)])
    file_of(spark, landing, [(1, 1, "a", 241, 1), (3, 1, "a", 1, 1)])
    rows, late = sessions.run_counting_late(jobs.dedup_stream(stream_of(spark, landing), ["event_id"]), out)
    # the copy of hour 12 is dropped, that of hour 241 comes after the state forgot the first, and hour 1 is too late
    assert sorted((r["event_id"], r["ts"].day) for r in rows.collect()) == [(1, 1), (1, 11), (2, 11), (4, 11)]
    assert late == 1
