"""Streams over several batches with late and repeated rows, against batch results."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidloom.streaming import silence, windows

START = datetime(2024, 1, 1)


def event(i, hours, user=1, kind="click"):
    return (i, START + timedelta(hours=hours), user, kind, 1.0, None)


BATCHES = [
    [event(1, 0), event(2, 1), event(3, 30)],
    [event(4, 29, 2), event(2, 1), event(5, 3), event(6, 60), event(6, 60)],  # 2 and 5 come after the watermark (6 h)
    [event(7, 40), event(6, 60), event(8, 35), event(9, 90, 2)],  # 35 h is before the watermark (36 h)
]


@pytest.fixture
def arrived(spark, tmp_path):
    def write(batch):
        spark.createDataFrame(batch, windows.EVENTS).write.mode("append").parquet(str(tmp_path / "in"))

    write(BATCHES[0])
    return write, windows.events(spark, str(tmp_path / "in"))


def test_late_and_repeated_rows(spark, arrived):
    write, stream = arrived
    take = windows.Arrivals(stream)
    take.run()
    counts = windows.Appended(take.in_time(), lambda s: windows.deduplicated(s).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")))
    counts.run()
    for batch in BATCHES[1:]:
        write(batch)
        take.run()
        counts.run()
    early = counts.rows().count()
    assert sorted((r.event_id, r.batch) for r in take.late_rows().collect()) == [(2, 1), (5, 1), (8, 2)]
    got = {r.window.start: r.n for r in counts.close().collect()}
    assert got == {START + timedelta(hours=h): 1 for h in (0, 1, 29, 30, 40, 60, 90)} and 0 < early < len(got)
    assert sum(op["numRowsDroppedByWatermark"] for p in counts.progress for op in p["stateOperators"]) == 0
    assert counts.state_rows()[-1] <= 2  # the mark's window and key


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    path, sizes = str(tmp_path / "in"), []
    run = None
    for day in range(8):
        spark.createDataFrame([event(100 * day + h, 24 * day + h) for h in range(24)], windows.EVENTS).write.mode("append").parquet(path)
        run = run or windows.Appended(windows.events(spark, path), windows.deduplicated)
        run.run()
        sizes.append(run.state_rows()[-1])
    assert max(sizes) <= 49 and sizes[-1] <= 49 and run.close().count() == 8 * 24


@pytest.fixture
def rocksdb(spark):
    with silence.rocksdb(spark):
        yield


def test_silence(spark, tmp_path, rocksdb):
    path = str(tmp_path / "in")
    minutes = lambda i, m, user: event(i, m / 60, user)
    batches = [
        [minutes(1, 0, 1), minutes(2, 3, 1), minutes(3, 20, 1), minutes(4, 0, 2)],
        [minutes(5, 10, 1), minutes(6, 26, 3), minutes(7, 18, 2)],  # 10 falls between rows that came before
        [minutes(8, 90, 3), minutes(9, 31, 1), minutes(10, 31, 1)],
        [minutes(11, 200, 2), minutes(12, 201, 2)],
    ]
    seen, run = [], None
    for batch in batches:
        spark.createDataFrame(batch, windows.EVENTS).write.mode("append").parquet(path)
        run = run or windows.Appended(windows.events(spark, path), lambda s: silence.silences(s, "user_id"), delay="30 minutes")
        run.run()
        seen.append(run.rows().count())
    got = sorted(tuple(r) for r in run.close().collect())
    want = sorted(tuple(r) for r in silence.silences_of_batch(spark.read.parquet(path), "user_id").collect())
    assert got == want and len(set(got)) == len(got) and seen[0] == 0 < seen[-1] < len(got)


def test_a_key_asks_for_little_of_its_state():
    """Each call to a state or timer is a message to the JVM; a key of a bounded stream makes five in all, whatever its rows."""
    calls = []

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return self

        def getListState(self, *_):  # noqa: N802
            return self

        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a))

    import pandas as pd

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815

    told = silence.Silence("k", 1_000_000)
    told.init(handle := Handle())
    handle.get = lambda *a: calls.append(("get", *a)) or next((c[1] for c in reversed(calls) if c[0] == "update"), None)
    assert list(told.handleInputRows((1,), iter([pd.DataFrame({"heard": [5_000_000, 5_500_000]})]), Now(0))) == []
    out = pd.concat(told.handleExpiredTimer((1,), Now(60_000), Now(5_000)))
    assert out["state"].tolist() == ["stale"] and out["at"].tolist() == [6_500_000]
    assert [c[0] for c in calls] == ["get", "registerTimer", "update", "get", "update"]
