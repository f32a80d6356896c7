"""Sessions of a stream: state over runs, late rows, replay."""

from __future__ import annotations

from datetime import datetime, timedelta

from marlquarry.streaming import windows as W

START = datetime(2024, 1, 1)


def add(spark, folder, rows):
    spark.createDataFrame([(u, START + timedelta(hours=h)) for u, h in rows], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))


def found(df):
    return sorted((r.user_id, (r.session_start - START).total_seconds() / 3600, (r.session_end - START).total_seconds() / 3600, r.n) for r in df.collect())


def test_sessions_go_on_over_runs(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("in", "ticks", "out", "mark")]
    run = lambda: found(W.stream_sessions(spark, *paths))
    add(spark, paths[0], [(1, 0), (1, 2), (2, 1), (1, 20)])
    # The watermark stands at 19: what ended by 13 is closed, user 1's second session is open.
    assert run() == [(1, 0, 2, 2), (2, 1, 1, 1)]
    # Nothing new: nothing changes.
    assert run() == [(1, 0, 2, 2), (2, 1, 1, 1)]
    # The open session goes on from the checkpoint; a row within the delay joins, one far behind the watermark is dropped.
    add(spark, paths[0], [(1, 24), (2, 19.5), (2, 3)])
    add(spark, paths[0], [(1, 50)])
    want = [(1, 0, 2, 2), (1, 20, 24, 2), (2, 1, 1, 1), (2, 19.5, 19.5, 1)]
    assert run() == want
    # A tick closes the rest and is no session itself; running again leaves it so.
    W.close_sessions(spark, *paths[:2])
    assert run() == sorted([*want, (1, 50, 50, 1)])
    assert run() == sorted([*want, (1, 50, 50, 1)])


def test_a_stream_of_nothing(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("in", "ticks", "out", "mark")]
    spark.createDataFrame([], "user_id long, ts timestamp").write.parquet(paths[0])
    W.close_sessions(spark, *paths[:2])
    assert found(W.stream_sessions(spark, *paths)) == []
