import pytest
from pyspark.sql import functions as F

from lakelens.streaming import windows


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_daily_counts_all_events(spark, data):
    got = windows.run_daily(spark, f"{data}/events.parquet")
    assert got.agg(F.sum("events")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


@pytest.mark.parametrize("f", [windows.daily, windows.sliding])
def test_windows_run(spark, data, f):
    assert run(spark, f(windows.read_events(spark, f"{data}/events.parquet")), f"w_{f.__name__}", "complete").count() > 0


def test_sessions_and_once(spark, data):
    e = windows.read_events(spark, f"{data}/events.parquet")
    assert run(spark, windows.sessions(e), "w_sessions", "append").count() > 0
    assert run(spark, windows.once(e).select("event_id"), "w_once", "append").count() == spark.read.parquet(f"{data}/events.parquet").select("event_id").distinct().count()


def test_append_new(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    windows.append_new(a, str(tmp_path / "t"), ["k"])
    windows.append_new(a.unionAll(spark.createDataFrame([(3, "c")], "k int, v string")), str(tmp_path / "t"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_ttl(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:00', 'old'), (1, TIMESTAMP_NTZ '2024-01-01 00:30:00', 'new'), (2, TIMESTAMP_NTZ '2023-12-31 00:00:00', 'gone') t(k, at, v)")
    got = windows.latest_with_ttl(rows, ["k"], "at", "1 HOUR", F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).collect()
    assert [(r.k, r.v) for r in got] == [(1, "new")]
