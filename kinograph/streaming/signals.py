"""Signals over streaming frames: spells of possession as session windows, late frames within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def possession_spells(frames: DataFrame, perspective: str = "home", gap: str = "250 milliseconds", late: str = "10 seconds", least_seconds: float = 0.6) -> DataFrame:
    """Spells of possession in play (match_id, period, ts, possession_team_role, ball_alive).

    Frames of the side in play that are at most `gap` apart are one session; a
    frame of another state isn't in any, so it parts two spells where the gap is
    shorter than two frames' distance. Late frames count up to the watermark.
    """
    mine = frames.withWatermark("ts", late).where((F.col("possession_team_role") == perspective) & F.coalesce("ball_alive", F.lit(False)))
    s = mine.groupBy("match_id", "period", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_frames"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    s = s.withColumn("duration_seconds", (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6)
    return s.where(F.col("duration_seconds") >= least_seconds).drop("w")


def persistence_windows(frames: DataFrame, truth: str, length: str = "1 second", slide: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Sliding windows by whether a nullable truth holds in all their frames: PASS, FAIL if false in one, else UNKNOWN."""
    t = F.expr(truth)
    g = frames.withWatermark("ts", late).groupBy("match_id", "period", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n_frames"), F.count_if(t).alias("n_true"), F.count_if(~t).alias("n_false"))
    st = F.when(F.col("n_false") > 0, "FAIL").when(F.col("n_true") == F.col("n_frames"), "PASS").otherwise("UNKNOWN")
    return g.select("match_id", "period", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_frames", st.alias("predicate_status"))
