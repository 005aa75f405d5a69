"""Composition of episode sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import anchor_id
from ..functions.tri import FAIL, PASS, UNKNOWN, Step, cascade
from ..sources.tables import ANCHOR, KEYS, Scope, put


def join_episode_sets(
    scope: Scope, left_episodes: DataFrame, right_episodes: DataFrame, left_key_field: str = "anchor_id", right_key_field: str = "anchor_id", left_status_field: str = "none", right_status_field: str = "none", required_status_value: str = "PASS",
    temporal_relation: str = "none", left_time_field: str = "anchor_frame_id", right_time_field: str = "anchor_frame_id", maximum_gap_seconds: float = 999.0, distinct_entity_fields: str = "none", same_entity_fields: str = "none",
) -> DataFrame:
    """Every row of the left with the one row of the right that has its key.

    No row with the key is FAIL, several are UNKNOWN. Right columns whose names
    the left has get the prefix right_ (right_2_ and so on where that is taken).
    The right is brought to one row a key before the join, so no pairs arise.
    """
    left = left_episodes.withColumn("join_key", F.col(left_key_field).cast("string"))
    names, taken = {}, {*left.columns}
    for c in right_episodes.columns:
        if c in KEYS:
            continue
        new, k = c, 1
        while new in taken:
            new, k = (f"right_{c}" if k == 1 else f"right_{k}_{c}"), k + 1
        taken.add(new)
        names[c] = new
    r = right_episodes.withColumn("join_key", F.col(right_key_field).cast("string")).where("join_key is not null")
    r = r.groupBy(*KEYS, "join_key").agg(F.count("*").alias("right_match_count"), F.first(F.struct(*names)).alias("_r"))
    a = left.join(r, [*KEYS, "join_key"], "left")
    a = put(a, right_match_count=F.coalesce("right_match_count", F.lit(0)))
    a = a.select("*", *[F.when(F.col("right_match_count") == 1, F.col(f"_r.{c}")).alias(n) for c, n in names.items()]).drop("_r")
    right = lambda c: F.col(names.get(c, c))
    steps: list[Step] = []
    if left_status_field != "none":
        s = F.col(left_status_field)
        steps += [(s.isNull() | (s == UNKNOWN), UNKNOWN, "left_status_unknown"), (s != required_status_value, FAIL, "left_status_not_met")]
    steps += [(F.col("join_key").isNull(), UNKNOWN, "key_unknown"), (F.col("right_match_count") == 0, FAIL, "no_match"), (F.col("right_match_count") > 1, UNKNOWN, "several_matches")]
    if right_status_field != "none":
        s = right(right_status_field)
        steps += [(s.isNull() | (s == UNKNOWN), UNKNOWN, "right_status_unknown"), (s != required_status_value, FAIL, "right_status_not_met")]
    lt, rt = F.col(left_time_field), right(right_time_field)
    a = put(a, left_time_frame_id=lt, right_time_frame_id=rt)
    a = put(a, temporal_gap_seconds=(F.col("right_time_frame_id") - F.col("left_time_frame_id")) / F.lit(scope.frame_rate_hz))
    gap = F.col("temporal_gap_seconds")
    if temporal_relation == "left_ends_before_right":
        steps += [(gap.isNull(), UNKNOWN, "time_unknown"), ((gap < 0) | (gap > maximum_gap_seconds), FAIL, "not_before")]
    elif temporal_relation == "left_starts_before_right":
        steps += [(gap.isNull(), UNKNOWN, "time_unknown"), (gap < 0, FAIL, "not_before")]
    elif temporal_relation == "overlaps":
        ls, le, rs, re_ = F.col("start_frame_id"), F.col("end_frame_id"), right("start_frame_id"), right("end_frame_id")
        steps += [(ls.isNull() | le.isNull() | rs.isNull() | re_.isNull(), UNKNOWN, "time_unknown"), ((ls > re_) | (rs > le), FAIL, "no_overlap")]
    here = set(a.columns)
    value = lambda c: F.col(c).cast("string") if c in here else F.lit(None).cast("string")
    if distinct_entity_fields != "none":
        vs = F.array(*[value(c) for c in distinct_entity_fields.split(",")])
        a = put(a, distinct_entity_values=vs, distinct_entities_status=F.when(F.size(F.array_compact(vs)) < F.size(vs), UNKNOWN).when(F.size(F.array_distinct(vs)) < F.size(vs), FAIL).otherwise(PASS))
        steps += [(F.col("distinct_entities_status") == UNKNOWN, UNKNOWN, "entity_unknown"), (F.col("distinct_entities_status") == FAIL, FAIL, "entities_not_distinct")]
    if same_entity_fields != "none":
        x, y = (value(c) for c in same_entity_fields.split("="))
        a = put(a, same_entity_values=F.array(x, y), same_entity_status=F.when(x.isNull() | y.isNull(), UNKNOWN).when(x == y, PASS).otherwise(FAIL))
        steps += [(F.col("same_entity_status") == UNKNOWN, UNKNOWN, "entity_unknown"), (F.col("same_entity_status") == FAIL, FAIL, "entities_differ")]
    s, r = cascade(steps, PASS, "joined")
    a = put(a, join_status=s, join_reason=r, left_anchor_id=F.col("anchor_id"))
    own_right = names.get("anchor_id", "right_anchor_id")
    if own_right != "right_anchor_id":
        a = put(a, right_anchor_id=F.col(own_right))
    a = put(a, entity_refs=F.array_compact(F.array("left_anchor_id", F.col("right_anchor_id"))))
    return put(a, anchor_id=anchor_id(refs=F.col("entity_refs")))


def change_across_anchor(
    anchors: DataFrame, before_evaluations: DataFrame, after_evaluations: DataFrame, before_value_field: str = "line_compactness_m", after_value_field: str = "line_compactness_m", before_status_field: str = "line_status", after_status_field: str = "line_status",
    required_status_value: str = "PASS", change_mode: str = "increase_at_least", minimum_change_m: float = 4.0, maximum_before_value_m: float = 80.0,
) -> DataFrame:
    """Whether a measurement changes enough from one evaluation of an anchor to another."""

    def side(df: DataFrame, value: str, status: str, name: str) -> DataFrame:
        s = F.lit(PASS) if status == "none" else F.col(status)
        return df.groupBy(*ANCHOR).agg(F.min_by(F.struct(F.col(value).cast("double").alias("v"), s.alias("s")), F.col("anchor_frame_id")).alias(name))

    a = anchors.join(side(before_evaluations, before_value_field, before_status_field, "_b"), list(ANCHOR), "left").join(side(after_evaluations, after_value_field, after_status_field, "_a"), list(ANCHOR), "left")
    a = put(a, before_value=F.col("_b.v"), after_value=F.col("_a.v"))
    a = put(a, delta_value=F.col("after_value") - F.col("before_value"))
    d = {"increase_at_least": F.col("delta_value"), "decrease_at_least": -F.col("delta_value"), "absolute_delta_at_least": F.abs("delta_value")}[change_mode]
    steps: list[Step] = []
    for name in ("_b", "_a"):
        s = F.col(f"{name}.s")
        word = "before" if name == "_b" else "after"
        steps += [(s.isNull() | (s == UNKNOWN), UNKNOWN, f"{word}_unknown"), (s != required_status_value, FAIL, f"{word}_status_not_met")]
    steps += [(F.col("delta_value").isNull(), UNKNOWN, "value_unknown"), (F.col("before_value") > maximum_before_value_m, FAIL, "before_above_maximum"), (d >= minimum_change_m, PASS, "changed")]
    s, r = cascade(steps, FAIL, "change_below_minimum")
    return put(a, change_status=s, change_reason=r, change_mode=F.lit(change_mode), minimum_change_m=F.lit(float(minimum_change_m)), maximum_before_value_m=F.lit(float(maximum_before_value_m)), before_value_field=F.lit(before_value_field), after_value_field=F.lit(after_value_field)).drop("_b", "_a")
