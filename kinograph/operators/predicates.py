"""Predicates over signals and episode sets. There is no `lt`: the reference algebra has none."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.islands import longest, persist_intervals
from ..functions.tri import FAIL, PASS, UNKNOWN, known, status
from ..sources.shared import cut
from ..sources.tables import ANCHOR, KEYS

_COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b}


def compare(operator: str, value: Column, threshold: Any, numeric: bool | None = None) -> Column:
    """The nullable truth of a comparison; NaN and null decide nothing."""
    if numeric if numeric is not None else isinstance(threshold, int | float) and not isinstance(threshold, bool):
        value = known(value.cast("double"))
    return _COMPARE[operator](value, F.lit(threshold))


def threshold(df: DataFrame, operator: str, field: str, value: Any, unit: str = "none") -> DataFrame:
    """df with predicate_status, predicate_value, predicate_threshold and predicate_unit."""
    col = F.col(field)
    seen = F.when(col == UNKNOWN, None).otherwise(col) if isinstance(value, str) else col
    truth = compare(operator, seen, value)
    return df.withColumns({"predicate_status": status(truth), "predicate_value": col.cast("string"), "predicate_threshold": F.lit(str(value)), "predicate_unit": F.lit(unit)})


def duration_frames(value: float, unit: str, rate: float) -> int:
    """Frames of a duration in seconds, milliseconds or frames, rounded up."""
    return max(1, math.ceil({"second": value * rate, "millisecond": value / 1000 * rate, "frame": value}[unit]))


def persists_for(df: DataFrame, truth: Column, value: float, unit: str, rate: float, keys=KEYS, order: str = "idx") -> DataFrame:
    """Intervals of frames in which the truth holds for the duration, surely, perhaps or not."""
    return persist_intervals(df, truth, duration_frames(value, unit, rate), keys, order).withColumnRenamed("persist_status", "predicate_status")


def record_persists(records: DataFrame, series: DataFrame, value: float, unit: str, rate: float) -> DataFrame:
    """Records with predicate_status: whether the truth of their own series (predicate_status on each frame of each anchor) holds for the duration without a break.

    The longest stretch is told, the first of equals. gate_passed: it lasts, and the record's own status is PASS.
    """
    n = duration_frames(value, unit, rate)
    found = longest(series, F.col("predicate_status") == PASS, ANCHOR)
    found = found.select(*ANCHOR, F.col("n").alias("_n"), F.col("start_frame_id").alias("persistence_start_frame_id"), F.col("end_frame_id").alias("persistence_end_frame_id"))
    out = records.join(found, list(ANCHOR), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    lasts = F.col("_n") >= n
    out = out.withColumns({"gate_passed": lasts & (F.col("predicate_status") == PASS), "persistence_seconds": F.round(F.col("_n") / F.lit(rate), 3)})
    out = out.withColumns({"predicate_status": F.when(lasts, PASS).otherwise(FAIL), "predicate_value": F.col("persistence_seconds").cast("string"), "predicate_threshold": F.lit(str(value)), "predicate_unit": F.lit(unit)}).drop("_n")
    return cut(out, "lasting")  # a row a record; rules, evidence and what follows read it


def _coverage(anchors: DataFrame, evaluations: DataFrame) -> DataFrame:
    """The evaluation of each anchor (the first by frame), or none."""
    missing = {"evaluation_status", "relation_count"} - set(evaluations.columns)
    if missing:
        raise ValueError(f"evaluations lack {sorted(missing)}: coverage can't be told")
    e = evaluations.groupBy(*ANCHOR).agg(F.min_by(F.struct("evaluation_status", "relation_count"), F.col("relation_count")).alias("_e"))
    return anchors.join(e, list(ANCHOR), "left")


def exists(anchors: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Whether an anchor has a relation; anchors that weren't evaluated are UNKNOWN."""
    out = _coverage(anchors, evaluations)
    s = F.coalesce(F.col("_e.evaluation_status"), F.lit(UNKNOWN))
    return out.withColumns({"predicate_status": s, "predicate_value": F.col("_e.relation_count").cast("string")}).drop("_e")


def count_at_least(anchors: DataFrame, evaluations: DataFrame, n: int) -> DataFrame:
    """Whether an anchor has n relations; UNKNOWN stays unless there are enough."""
    out = _coverage(anchors, evaluations)
    count, s = F.coalesce(F.col("_e.relation_count"), F.lit(0)), F.col("_e.evaluation_status")
    p = F.when(F.col("_e").isNull() | (s == UNKNOWN), UNKNOWN).when(count >= n, PASS).otherwise(FAIL)
    return out.withColumns({"predicate_status": p, "predicate_value": count.cast("string")}).drop("_e")
