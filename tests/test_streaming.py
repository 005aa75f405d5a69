"""Streams give what the same frames give at once."""

import datetime as dt

from pyspark.sql import functions as F

from kinograph.streaming import signals


def test_spells_and_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("m", "firstHalf", t0 + dt.timedelta(milliseconds=200 * i), "home" if i < 6 or 8 <= i < 20 else "away", i != 15, None if i == 9 else i) for i in range(30)]
    df = spark.createDataFrame(rows, "match_id string, period string, ts timestamp, possession_team_role string, ball_alive boolean, measure int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def drained(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    key = lambda d: sorted((r.start_ts, r.n_frames) for r in d.collect())
    assert key(drained(signals.possession_spells(stream), "spells")) == key(signals.possession_spells(df)) == [(t0, 6), (t0 + dt.timedelta(seconds=1.6), 7), (t0 + dt.timedelta(seconds=3.2), 4)]
    w = signals.persistence_windows(df, "measure >= 5")
    got = {r.predicate_status for r in w.collect()}
    assert got == {"PASS", "FAIL", "UNKNOWN"}
    full = w.where(F.col("n_frames") == 5).orderBy("start_ts").collect()
    assert full[0].predicate_status == "FAIL" and full[-1].predicate_status == "PASS"
