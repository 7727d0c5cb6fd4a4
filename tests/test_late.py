import time
from datetime import datetime, timedelta

import pytest

from marlstone.streaming import late

SHAPE = "click_id long, ts timestamp, arrived_at timestamp, kind string"
DAY = datetime(2024, 1, 1)


def event(k, day, arrived=None, kind="view"):
    ts = None if day is None else DAY + timedelta(days=day)
    return (k, ts, DAY + timedelta(days=day if arrived is None else arrived), kind)


#: in the second month: one again, one late within a day, one beyond it, one beyond it and again
ROWS = [*(event(k, k) for k in range(31)), event(30, 30), event(None, 3), event(99, None, 4), event(30, 30, 40), event(50, 29.5, 31.5), event(51, 28, 32), event(3, 3, 33), *(event(100 + k, 32 + k) for k in range(5)), event(104, 36)]
KEPT = [*range(31), None, 50, 100, 101, 102, 103, 104]


def test_late_and_repeated_events(spark, tmp_path):
    events = spark.createDataFrame(ROWS, SHAPE)
    got, progress = late.replayed(events, f"file://{tmp_path}/t", "click_id", "ts", "arrived_at")
    assert sorted((r["click_id"] for r in got.collect()), key=str) == sorted(KEPT, key=str)
    runs = progress.orderBy("batch").collect()
    assert [r["rows"] for r in runs] == [34, 10] and [r["late"] for r in runs] == [0, 2]
    assert runs[1]["watermark"] == DAY + timedelta(days=29) and runs[1]["newest"] == DAY + timedelta(days=36) and runs[1]["lag_seconds"] == 7 * 86400


def test_a_run_that_fails_is_taken_again_whole(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/t"
    events = spark.createDataFrame(ROWS, SHAPE)
    month = "date_format(arrived_at, 'MM')"
    put = lambda m: events.where(f"{month} = '{m}'").write.mode("append").parquet(f"{out}/in")
    run = lambda: late.take(spark.readStream.schema(SHAPE).parquet(f"{out}/in"), out, "click_id", "ts", "24 hours")
    put("01")
    run()
    first = sorted(map(str, late.taken(spark, out, SHAPE).collect()))
    put("02")
    dedup = late.deduplicated
    with monkeypatch.context() as m:
        m.setattr(late, "deduplicated", lambda *a: dedup(*a).selectExpr("click_id", "ts", "arrived_at", "IF(click_id = 102, raise_error('down'), kind) AS kind"))
        with pytest.raises(Exception, match="down"):
            run()
    assert run()[0][1:3] == (10, 2) and run() == []
    assert sorted((r["click_id"] for r in late.taken(spark, out, SHAPE).collect()), key=str) == sorted(KEPT, key=str)
    assert set(first) <= set(map(str, late.taken(spark, out, SHAPE).collect()))


def test_a_listener_writes_the_lag(spark, tmp_path):
    lag = late.Lag(f"file://{tmp_path}/lag")
    spark.streams.addListener(lag)
    try:
        late.replayed(spark.createDataFrame(ROWS, SHAPE), f"file://{tmp_path}/t", "click_id", "ts", "arrived_at")
        for _ in range(50):
            if len(list((tmp_path / "lag").glob("*.json"))) >= 2 if (tmp_path / "lag").exists() else False:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(lag)
    rows = spark.read.json(f"{tmp_path}/lag").collect()
    assert sum(r["late"] for r in rows) == 2 and max(r["lag_seconds"] or 0 for r in rows) == 7 * 86400
