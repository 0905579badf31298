"""Streams over restarts: replays, late rows, forgotten keys, cascades."""

from datetime import datetime, timedelta

import pytest

from lectern.streaming import observations as O

T0 = datetime(2024, 5, 1)
SCHEMA = "event_id long, url string, ts timestamp"


def _write(spark, rows, path):
    spark.createDataFrame([(e, u, T0 + timedelta(minutes=m)) for e, u, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_first_and_last_sight_over_restarts(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "shared")

    def run():
        with O.state_store(spark):
            out = O.drained(O.seen(O.poll(spark, source, SCHEMA, 5), "url", "ts", "event_id", timedelta(days=3)), "seen", "update", folder, "url")
        return {r.url: (r.first_seen - T0, r.last_seen - T0, r.n) for r in out.collect()}

    m = lambda x: timedelta(minutes=x)
    _write(spark, [(1, "a", 60), (2, "a", 90), (3, "b", 70)], source)
    assert run() == {"a": (m(60), m(90), 2), "b": (m(70), m(70), 1)}
    _write(spark, [(1, "a", 60), (4, "a", 30), (5, "b", 200)], source)  # a replay, a late row, a new one
    assert run() == {"a": (m(30), m(90), 3), "b": (m(70), m(200), 2)}
    assert run() == {"a": (m(30), m(90), 3), "b": (m(70), m(200), 2)}  # nothing new
    _write(spark, [(6, "c", 60 * 24 * 10)], source)  # far later: the others are forgotten
    run()
    _write(spark, [(7, "a", 60 * 24 * 10 + 5)], source)
    got = run()
    assert got["a"] == (m(60 * 24 * 10 + 5), m(60 * 24 * 10 + 5), 1) and got["c"][2] == 1
    assert O._PROVIDER not in {k for k, _ in spark.sparkContext.getConf().getAll()}


def test_copies_within_three_hours_of_an_origin(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "shared")
    rows = [(1, "x", 0), (2, "x", 179), (3, "x", 180), (4, "x", 361), (5, "y", 10), (6, "x", 180), (7, "y", 400)]
    got = set()
    for some in (rows[:3], rows[3:]):
        _write(spark, some, source)
        pairs = O.cascade_pairs(O.poll(spark, source, SCHEMA, 5), O.poll(spark, source, SCHEMA, 5), "url", "ts", "event_id")
        got = {(r.copy, r.origin, r.gap_s) for r in O.predecessors(O.drained(pairs, "cascade", "append", folder)).collect()}
    want = set()
    for e, u, t in rows:
        before = [(s, f) for f, v, s in rows if v == u and (s, f) < (t, e) and t - s <= 180]
        if before:
            s, f = max(before)
            want.add((e, f, (t - s) * 60))
    assert got == want


def test_streams_without_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(spark, [], source)
    with O.state_store(spark):
        assert O.drained(O.seen(O.poll(spark, source, SCHEMA), "url", "ts"), "none", "update", str(tmp_path), "url").count() == 0
    with pytest.raises(Exception, match="provider|RocksDB|state store|STATE_STORE"):
        O.drained(O.seen(O.poll(spark, source, SCHEMA), "url", "ts"), "other", "update", str(tmp_path), "url")
