"""Possession, transitions, zones and outcomes on the analysis stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.identity import anchor_id
from ..functions.islands import runs, spaced
from ..functions.tri import FAIL, PASS, UNKNOWN, cascade, frames_rounded, frames_up
from ..sources.shared import cut
from ..sources.tables import ANCHOR, KEYS, Scope, attach, frame_of, located, put


def _has(scope: Scope, role: str | None = None) -> Column:
    """The side has the ball in play. Whatever is not the home side's counts as the away side's, so `alive` gates it."""
    return (F.col("role") == (role or scope.perspective)) & F.col("alive")


def possession_segment(scope: Scope) -> DataFrame:
    """Maximal stretches of possession in play, of the minimum length; anchored at their first frame."""
    rate = scope.analysis_rate_hz
    found = runs(scope.stream(), _has(scope), KEYS, max(1, frames_rounded(scope.minimum_possession_seconds, rate)))
    found = put(
        found, possession_start_frame_id=F.col("start_frame_id"), possession_end_frame_id=F.col("end_frame_id"), possession_duration_seconds=F.col("n") / F.lit(rate), anchor_frame_id=F.col("start_frame_id"),
        entity_refs=F.array().cast("array<string>"), team_role=F.lit(scope.perspective),
    )
    return put(found, anchor_id=anchor_id())


def transition_anchor(scope: Scope, transition_type: str = "regain", minimum_prior_possession_seconds: float = 0.4, zone_filter: str = "any", zone_boundary_buffer_m: float = 0.5) -> DataFrame:
    """Changes of possession. A dead ball, or a spell before that is too short, is UNKNOWN; then the zone decides."""
    before, after = (scope.defending, scope.perspective) if transition_type == "regain" else (scope.perspective, scope.defending)
    n = max(1, frames_up(minimum_prior_possession_seconds, scope.analysis_rate_hz))
    w = Window.partitionBy(*KEYS).orderBy("idx")
    held = F.count_if((F.col("role") == before) & F.col("alive")).over(w.rowsBetween(-n, -1))
    s = scope.stream().withColumns({"previous_team_role": F.lag("role").over(w), "previous_frame_id": F.lag("frame_id").over(w), "prior_possession_frame_count": held})
    a = s.where((F.col("previous_team_role") == before) & (F.col("role") == after))
    a = put(a, anchor_frame_id=F.col("frame_id"), start_frame_id=F.col("frame_id"), end_frame_id=F.col("frame_id"), transition_frame_id=F.col("frame_id"), entity_refs=F.array().cast("array<string>"), team_role=F.lit(scope.perspective), new_team_role=F.col("role"), transition_type=F.lit(transition_type))
    a = put(a, anchor_id=anchor_id())
    gates = [(~F.col("alive"), UNKNOWN, "dead_ball"), (F.col("prior_possession_frame_count") < n, UNKNOWN, "prior_possession_not_established")]
    if zone_filter != "any":
        a = structured_zone(scope, a, "anchor_frame_id", zone_filter, zone_boundary_buffer_m)
        gates += [(F.col("zone_status") == UNKNOWN, UNKNOWN, "zone_unknown"), (F.col("zone_status") == FAIL, FAIL, "outside_zone")]
    status, reason = cascade(gates, PASS, "transition")
    a = put(a, transition_status=status, transition_reason=reason, minimum_prior_possession_seconds=F.lit(float(minimum_prior_possession_seconds)))
    return scope.timed(a, transition_match_time_ms="anchor_frame_id").drop("frame_id", "idx", "role", "alive", "ball_x", "ball_y")


def structured_zone(scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", zone_name: str = "own_half", zone_boundary_buffer_m: float = 0.5) -> DataFrame:
    """The zone of the ball along the attack; near a boundary of the zone it is UNKNOWN."""
    a = anchors.withColumn("_f", frame_of(anchors, frame_field)).where("_f is not null").drop("attacking_direction")
    role = F.coalesce(F.col("team_role"), F.lit(scope.perspective)) if "team_role" in a.columns else F.lit(scope.perspective)
    a = put(located(scope, a, "_f", "ball", "_b"), _r=role).join(scope.signs().select(*KEYS, F.col("team_role").alias("_r"), F.col("sign").alias("attacking_direction")), [*KEYS, "_r"], "left")
    a = put(a, zone_ball_x_m=F.col("_b_x"), zone_ball_y_m=F.col("_b_y"), zone_normalized_ball_x_m=F.col("_b_x") * F.col("attacking_direction"))
    inside, close = geo.zone(F.col("zone_normalized_ball_x_m"), zone_name, zone_boundary_buffer_m)
    s, r = cascade(
        [(F.col("_b_x").isNull(), UNKNOWN, "missing_ball"), (F.col("attacking_direction").isNull(), UNKNOWN, "missing_direction"), (close, UNKNOWN, "near_boundary"), (inside, PASS, "inside_zone")], FAIL, "outside_zone"
    )
    return put(a, zone_status=s, zone_reason=r, zone_name=F.lit(zone_name), zone_frame_id=F.col("_f"), zone_boundary_buffer_m=F.lit(float(zone_boundary_buffer_m))).drop("_f", "_r", "_b_x", "_b_y", "_b_role")


def _windows(scope: Scope, anchors: DataFrame, n: int, frame: str = "anchor_frame_id") -> DataFrame:
    """The stream's rows of each anchor's window of n samples from its frame on, with pos from 0.

    An equi-join on the sample number: windows are short, so each anchor's
    numbers are spelled out.
    """
    s = scope.stream()
    first = s.select(*KEYS, F.col("frame_id").alias(frame), F.col("idx").alias("_i"))
    at = anchors.select(*ANCHOR, frame).join(first, [*KEYS, frame]).withColumn("idx", F.explode(F.sequence(F.col("_i"), F.col("_i") + n - 1)))
    return at.join(s, [*KEYS, "idx"]).withColumn("pos", F.col("idx") - F.col("_i"))


def outcome_window(
    scope: Scope, anchors: DataFrame, maximum_window_seconds: float = 8.0, minimum_settled_possession_seconds: float = 4.0, required_anchor_status_field: str = "transition_status", required_anchor_status_value: str = "PASS",
) -> DataFrame:
    """Whether possession settles after an anchor: an unbroken spell within the window."""
    n, need = frames_up(maximum_window_seconds, scope.analysis_rate_hz) + 1, max(1, frames_up(minimum_settled_possession_seconds, scope.analysis_rate_hz))
    field = required_anchor_status_field
    gated = field != "none" and field in anchors.columns
    going = anchors.where(F.col(field) == required_anchor_status_value) if gated else anchors
    win = _windows(scope, going, n)
    base = win.groupBy(*ANCHOR).agg(
        F.count("*").alias("_n"), F.min("frame_id").alias("outcome_window_start_frame_id"), F.max("frame_id").alias("outcome_window_end_frame_id"),
        F.min(F.when(F.col("alive") & (F.col("role") != scope.perspective), F.col("frame_id"))).alias("loss_frame_id"), F.min(F.when(~F.col("alive"), F.col("frame_id"))).alias("stoppage_frame_id"),
    )
    spells = runs(win, _has(scope), ANCHOR, need, "pos")
    first = spells.groupBy(*ANCHOR).agg(F.min(F.struct("start_frame_id", "end_frame_id")).alias("_s"))
    out = attach(attach(anchors, base), first)
    steps = []
    if gated:
        steps = [(F.col(field) == UNKNOWN, UNKNOWN, "required_status_unknown"), (F.col(field) != required_anchor_status_value, FAIL, "required_status_not_met")]
    own = [
        (F.coalesce("_n", F.lit(0)) < need, UNKNOWN, "window_too_short"),
        (F.col("_s").isNotNull(), PASS, "settled"),
        (F.col("loss_frame_id").isNotNull(), FAIL, "possession_lost"),
        (F.col("stoppage_frame_id").isNotNull(), FAIL, "stoppage"),
        (F.col("_n") < n, UNKNOWN, "window_beyond_period"),
    ]
    s, r = cascade([*steps, *own], FAIL, "not_settled")
    out = put(out, outcome_window_status=s, outcome_window_reason=r, settled_start_frame_id=F.col("_s.start_frame_id"), settled_end_frame_id=F.col("_s.end_frame_id"), maximum_window_seconds=F.lit(float(maximum_window_seconds)), minimum_settled_possession_seconds=F.lit(float(minimum_settled_possession_seconds)))
    phase = F.when(F.col("outcome_window_status") == PASS, "SETTLED").when(F.col("outcome_window_status") == FAIL, "NOT_SETTLED").otherwise(UNKNOWN)
    return put(out, possession_phase_status=phase, required_anchor_status_field=F.lit(field), required_anchor_status_value=F.lit(required_anchor_status_value)).drop("_n", "_s")


def ball_lateral_fraction(scope: Scope) -> DataFrame:
    """The ball's distance from the long axis, as a share of half the width, on each analysis frame."""
    side = F.when(F.col("ball_y") > 0, F.lit(1)).when(F.col("ball_y") < 0, F.lit(-1)).when(F.col("ball_y").isNotNull(), F.lit(0))
    return scope.stream().withColumns({"fraction": F.abs("ball_y") / geo.HALF_WIDTH_M, "wide_entry_y_m": F.col("ball_y"), "ball_side": side})


def defensive_outfield_centroid(scope: Scope) -> DataFrame:
    """Mean y and number of the defending outfield players on each frame."""
    rows = scope.players(scope.defending)
    return rows.groupBy(*KEYS, "frame_id", "team_role").agg(F.avg("y_m").alias("centroid_y"), F.count("*").alias("n_players"))


def wide_entries(scope: Scope, possession: DataFrame, entries: DataFrame, prior_central_fraction: float = 0.45, minimum_wide_dwell_seconds: float = 1.2, baseline_window_seconds: float = 0.8) -> DataFrame:
    """Moments of a possession at which the ball goes wide and stays so, having been central in the two seconds before.

    entries: episodes (start_idx, end_idx) in which the ball is wide. Everything is looked at inside the possession; a moment needs
    the baseline and the dwell before it, and the dwell behind it.
    """
    rate = scope.analysis_rate_hz
    dwell, base, prior = (frames_rounded(x, rate) for x in (minimum_wide_dwell_seconds, baseline_window_seconds, 2.0))
    seg = possession.select(*KEYS, F.col("start_idx").alias("_s0"), F.col("end_idx").alias("_s1"), "possession_start_frame_id", "possession_end_frame_id")
    # Possessions of a half don't overlap, nor do wide episodes: both are spelled out by the samples they hold.
    rows = seg.withColumn("idx", F.explode(F.sequence("_s0", "_s1"))).join(scope.stream().select(*KEYS, "idx", "frame_id", "ball_y"), [*KEYS, "idx"])
    wide = entries.select(*KEYS, F.col("end_idx").alias("_w1"), F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    rows = rows.join(wide, [*KEYS, "idx"], "left").withColumn("_wide", F.col("_w1").isNotNull())
    w = Window.partitionBy(*KEYS, "_s0").orderBy("idx")
    before, central = w.rowsBetween(-prior, -1), F.abs("ball_y") < prior_central_fraction * geo.HALF_WIDTH_M
    rows = rows.withColumns({
        "_rise": F.col("_wide") & ~F.coalesce(F.lag("_wide").over(w), F.lit(False)), "_lasts": F.count_if("_wide").over(w.rowsBetween(0, max(0, dwell - 1))) >= dwell, "_central": F.count_if(central).over(before) > 0,
        "baseline_start_frame_id": F.min("frame_id").over(w.rowsBetween(-base, -1)), "baseline_end_frame_id": F.lag("frame_id").over(w), "prior_central_start_frame_id": F.min("frame_id").over(before),
    })
    at, n = F.col("idx") - F.col("_s0"), F.col("_s1") - F.col("_s0") + 1
    found = rows.where((at >= max(base, dwell, 1)) & (at < n - dwell) & F.col("_rise") & F.col("_lasts") & F.col("_central"))
    sign = F.when(F.col("ball_y") >= 0, 1).otherwise(-1)
    found = put(found, entry_idx=F.col("idx"), wide_entry_frame_id=F.col("frame_id"), side_sign=sign, ball_side=F.when(sign > 0, "right").otherwise("left"), wide_entry_y_m=F.round("ball_y", 3))
    found = put(found, wide_dwell_seconds=F.round((F.least("_w1", "_s1") - F.col("idx") + 1) / F.lit(rate), 3), possession_duration_seconds=F.round(n / F.lit(rate), 3))
    return found.drop("idx", "frame_id", "ball_y", "_wide", "_w1", "_rise", "_lasts", "_central", "_s0").withColumnRenamed("_s1", "segment_end_idx")


def signed_lateral_shift(
    scope: Scope, possession: DataFrame, entries: DataFrame, centroid: DataFrame | None = None, prior_central_fraction: float = 0.45, minimum_wide_dwell_seconds: float = 1.2, baseline_window_seconds: float = 0.8, shift_search_window_seconds: float = 4.0,
) -> tuple[DataFrame, DataFrame]:
    """How far the defending block moves towards the side that the ball goes wide to, and the shift on each frame behind that.

    The baseline is the mean centroid before the entry; the anchor is the frame with the largest shift towards the side within the
    search window, the earliest of equals. Frames without a centroid have no shift. quality_status is `fail` where a frame has fewer
    defenders than the host asks for. The second frame has a row for each anchor and frame: match_id, period, anchor_id, idx, frame_id, signed_shift.
    """
    base, search = (frames_rounded(x, scope.analysis_rate_hz) for x in (baseline_window_seconds, shift_search_window_seconds))
    c = (defensive_outfield_centroid(scope) if centroid is None else centroid).select(*KEYS, "frame_id", "centroid_y", "n_players")
    s = scope.stream().select(*KEYS, "idx", "frame_id").join(c, [*KEYS, "frame_id"], "left")
    e = wide_entries(scope, possession, entries, prior_central_fraction, minimum_wide_dwell_seconds, baseline_window_seconds)
    near = e.withColumn("idx", F.explode(F.sequence(F.col("entry_idx") - base, F.least(F.col("segment_end_idx"), F.col("entry_idx") + search - 1)))).join(s, [*KEYS, "idx"])
    by = Window.partitionBy(*KEYS, "entry_idx")
    behind = F.col("idx") < F.col("entry_idx")
    near = near.withColumns({
        "_base": F.avg(F.when(behind, F.col("centroid_y"))).over(by), "minimum_defender_count": F.min("n_players").over(by), "end_frame_id": F.max("frame_id").over(by), "_first": F.min(F.when(~behind, F.col("frame_id"))).over(by),
    })
    near = near.where(~behind & F.col("_base").isNotNull() & F.col("centroid_y").isNotNull()).withColumn("signed_shift", F.col("side_sign") * (F.col("centroid_y") - F.col("_base")))
    best = F.max(F.struct("signed_shift", (-F.col("frame_id")).alias("f"))).over(by)
    near = near.withColumns({"_best": best["signed_shift"], "anchor_frame_id": -best["f"], "start_frame_id": F.col("baseline_start_frame_id"), "entity_refs": F.array().cast("array<string>"), "team_role": F.lit(scope.perspective)})
    near = cut(near.withColumn("anchor_id", anchor_id()), "shifts")  # one row a frame of each search window, read by records and series
    a = near.where(F.col("frame_id") == F.col("anchor_frame_id"))
    a = put(a, baseline_defensive_centroid_y_m=F.round("_base", 3), signed_shift_metres=F.round("_best", 3), block_shift_score=F.round("_best", 6), shift_search_start_frame_id=F.col("_first"), shift_search_end_frame_id=F.col("end_frame_id"))
    enough = F.coalesce(F.col("minimum_defender_count") >= scope.minimum_outfield_players_per_team, F.lit(False))
    a = put(a, quality_status=F.when(enough, "pass").otherwise("fail")).drop("idx", "frame_id", "centroid_y", "n_players", "_base", "_first", "_best", "signed_shift")
    return a, near.select(*ANCHOR, "idx", "frame_id", "signed_shift")


def outcome_classification(scope: Scope, shifts: DataFrame, horizon: float = 6.0, opposite_side_fraction: float = 0.35, retained_after_switch_seconds: float = 1.0, dedupe_window_seconds: float = 8.0) -> DataFrame:
    """What becomes of the possession after a shift: STOPPAGE, SWITCHED, LOST_BEFORE_SWITCH or RETAINED_NO_SWITCH, within the horizon.

    accepted: no stoppage, and enough defenders. Shifts of a possession whose entry is less than the dedupe window behind the
    last accepted one go: a fold over the entries of one possession.
    """
    rate = scope.analysis_rate_hz
    n, keep = frames_rounded(horizon, rate), frames_rounded(retained_after_switch_seconds, rate)
    win = _windows(scope, shifts, n).join(shifts.select(*ANCHOR, "side_sign"), list(ANCHOR))
    w = Window.partitionBy(*ANCHOR).orderBy("pos")
    win = win.withColumn("_kept", F.count_if(_has(scope)).over(w.rowsBetween(0, max(0, keep - 1))) >= keep)
    dead, lost = F.min(F.when(~F.col("alive"), F.col("pos"))), F.min(F.when(F.col("alive") & (F.col("role") != scope.perspective), F.col("pos")))
    switch = F.col("side_sign") * F.col("ball_y") <= -opposite_side_fraction * geo.HALF_WIDTH_M
    frames = F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pos", "frame_id"))))  # of the horizon
    got = win.groupBy(*ANCHOR).agg(dead.alias("_dead"), lost.alias("_lost"), F.min(F.when(switch, F.struct("pos", "_kept"))).alias("_sw"), F.max("pos").alias("_end"), frames.alias("_frames"))
    out = attach(shifts, got).where("_end is not null")
    d, lo, sw = F.col("_dead"), F.col("_lost"), F.col("_sw.pos")
    stopped = d.isNotNull() & (sw.isNull() | (d < sw)) & (lo.isNull() | (d < lo))
    label, at = F.when(stopped, "STOPPAGE"), F.when(stopped, d)
    for test, name, pos in ((F.coalesce(F.col("_sw._kept"), F.lit(False)), "SWITCHED", sw), (lo.isNotNull(), "LOST_BEFORE_SWITCH", lo)):
        label, at = label.when(test, name), at.when(test, pos)
    out = put(out, classification=label.otherwise("RETAINED_NO_SWITCH"), outcome_frame_id=F.col("_frames")[at.otherwise(F.col("_end"))])
    out = put(out, accepted=(F.col("classification") != "STOPPAGE") & (F.col("quality_status") == "pass")).drop("_dead", "_lost", "_sw", "_end", "_frames")
    out = cut(out, "outcomes")
    window, of = F.lit(int(round(dedupe_window_seconds * scope.frame_rate_hz))), [*KEYS, "possession_start_frame_id"]
    kept = out.where("accepted").groupBy(*of).agg(spaced(F.array_sort(F.collect_set("wide_entry_frame_id")), window).alias("_kept"))
    entry = F.col("wide_entry_frame_id")
    close = F.exists(F.coalesce("_kept", F.array().cast("array<bigint>")), lambda k: (k < entry) & (entry - k < window))
    return out.join(kept, of, "left").where(~close).drop("_kept")
