"""Streams whose files arrive one after another, with repeated and late ticks, and pauses between sessions."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodemark.streaming import bars as SB

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1)


def arrive(spark, path, rows):
    data = [(i, START + timedelta(minutes=m), 0, "a", float(v), "{}") for i, m, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_repeated_ticks_count_once(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 5, 10), (2, 20, 30), (1, 5, 10)])
    arrive(spark, tmp_path, [(2, 20, 30), (3, 70, 5)])
    got = SB.finished(spark, SB.windowed(SB.ticks(spark, str(tmp_path)), F.window("ts", "1 hour"))).orderBy("start").collect()
    assert [(r.open, r.high, r.close, r.n) for r in got] == [(10.0, 30.0, 30.0, 2), (5.0, 5.0, 5.0, 1)]


def test_sessions_end_with_a_pause(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 0, 1), (2, 10, 2), (3, 100, 3), (4, 105, 4), (5, 5000, 9)])
    rows = SB.ticks(spark, str(tmp_path), "10 minutes")
    got = SB.finished(spark, SB.windowed(rows, F.session_window("ts", "30 minutes")), "append").orderBy("start").collect()
    assert [(r.open, r.close, r.n) for r in got] == [(1.0, 2.0, 2), (3.0, 4.0, 2)]  # the last is not closed yet


def test_a_late_tick_is_dropped_and_counted_and_a_restart_goes_on(spark, tmp_path):
    """One file a batch: the tick of minute 1 comes after one of minute 6000 and is not counted; that of minute 5950 is within the two hours."""
    table, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrive(spark, table, [(1, 5, 10), (2, 20, 30)])
    arrive(spark, table, [(3, 6000, 1)])
    stream = lambda: SB.windowed(SB.ticks(spark, table, files_per_trigger=1), F.window("ts", "1 hour"))
    assert SB.run(stream(), out, state) == 0
    arrive(spark, table, [(4, 1, 9), (5, 5990, 7), (3, 6000, 1)])  # after a stop: state, watermark and known ticks are there
    assert SB.run(stream(), out, state) == 1
    got = SB.windows_of(spark, out, ["symbol"]).orderBy("start").collect()
    assert [(r.open, r.high, r.close, r.n) for r in got] == [(10.0, 30.0, 30.0, 2), (7.0, 7.0, 7.0, 1), (1.0, 1.0, 1.0, 1)]
    whole = SB.finished(spark, SB.windowed(SB.ticks(spark, table), F.window("ts", "1 hour"))).orderBy("start").first()
    assert (whole.n, whole.open) == (3, 9.0)  # all files as one batch: nothing is late


def test_store_keeps_its_length_and_replaces_bars(spark, tmp_path):
    """A freshly closed bar is added, one of a known time replaces it, older ones leave; a restart repeats nothing."""
    table, out, state = (str(tmp_path / x) for x in ("bars", "out", "state"))
    schema = f"symbol string, arrival timestamp, {SB.BAR}"

    def bars(rows):
        at = lambda h: START + timedelta(hours=h)
        data = [(s, at(a), at(h), v, v, v, v, 1) for s, a, h, v in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(table)

    def held():
        stream = SB.stored(spark.readStream.schema(schema).parquet(table), 3)
        SB.run(stream, out, state, "append")
        return {s: [(r.ts.hour, r.close) for r in SB.last_stored(spark, out).filter(F.col("symbol") == s).orderBy("ts").collect()] for s in "ab"}

    bars([("a", 1, 1, 1.0), ("a", 2, 2, 2.0), ("a", 3, 2, 2.5), ("b", 1, 1, 7.0)])
    assert held() == {"a": [(1, 1.0), (2, 2.5)], "b": [(1, 7.0)]}
    bars([("a", 5, 5, 5.0), ("a", 6, 1, 1.5), ("a", 7, 4, 4.0)])
    assert held() == {"a": [(2, 2.5), (4, 4.0), (5, 5.0)], "b": [(1, 7.0)]}
    assert held() == {"a": [(2, 2.5), (4, 4.0), (5, 5.0)], "b": [(1, 7.0)]}
