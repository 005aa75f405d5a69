"""Geometry and kinematics at an anchor's frame.

All keep every anchor that has a frame: evidence is joined from the left, and
what is missing makes a status UNKNOWN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.identity import anchor_id
from ..functions.tri import FAIL, PASS, UNKNOWN, cascade, frames_up, negated
from ..sources.shared import cut as written
from ..sources.tables import ANCHOR, KEYS, Scope, attach, frame_of, located, put


def _at(anchors: DataFrame, field: str) -> DataFrame:
    return anchors.withColumn("_f", frame_of(anchors, field)).where("_f is not null")


def _seen(scope: Scope, anchors: DataFrame, role: Column | None, outfield: bool = True) -> DataFrame:
    """Players at each anchor's frame `_f`, of the team `role` if given: the anchor's columns and player_id, team_role, x_m, y_m."""
    found = scope.players(outfield=outfield).withColumnRenamed("frame_id", "_f").withColumnRenamed("team_role", "p_role")
    rows = anchors.join(found, [*KEYS, "_f"])
    return rows if role is None else rows.where(F.col("p_role") == role)


def _other(role: Column) -> Column:
    return F.when(role == "home", "away").when(role == "away", "home")


def _scope_role(scope: Scope, candidate_scope: str, anchor_role: Column) -> Column | None:
    return {
        "perspective_outfield": F.lit(scope.perspective),
        "defending_outfield": F.lit(scope.defending),
        "opposition_outfield_to_anchor_team": _other(anchor_role),
        "same_team_outfield_as_anchor": anchor_role,
        "all_outfield": None,
    }[candidate_scope]


def _anchor_role(scope: Scope, anchors: DataFrame) -> Column:
    return F.coalesce(F.col("team_role"), F.lit(scope.perspective)) if "team_role" in anchors.columns else F.lit(scope.perspective)


def _id(anchors: DataFrame, field: str) -> Column:
    return F.col(field) if field in anchors.columns else F.lit(None).cast("string")


def tracking_quality(scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id") -> DataFrame:
    """PASS if the ball and all entities the anchor refers to have a row at its frame, else UNKNOWN."""
    a = _at(anchors, frame_field)
    refs = F.coalesce("entity_refs", F.array().cast("array<string>")) if "entity_refs" in a.columns else F.array().cast("array<string>")
    a = located(scope, a.withColumn("expected_entity_ids", F.array_sort(F.array_distinct(refs))), "_f", "ball", "_ball")
    each = a.select(*ANCHOR, "_f", F.explode("expected_entity_ids").alias("entity_id"))
    here = each.join(scope.entities().select(*KEYS, F.col("frame_id").alias("_f"), "entity_id").distinct(), [*KEYS, "_f", "entity_id"])
    found = here.groupBy(*ANCHOR).agg(F.collect_set("entity_id").alias("_have"))
    out = attach(a, found)
    out = put(out, missing_entity_ids=F.array_except("expected_entity_ids", F.coalesce("_have", F.array().cast("array<string>"))), ball_position_present=F.col("_ball_x").isNotNull())
    s, r = cascade([(~F.col("ball_position_present"), UNKNOWN, "missing_ball"), (F.size("missing_entity_ids") > 0, UNKNOWN, "missing_entities")], PASS, "complete")
    return put(out, tracking_quality_status=s, tracking_quality_reason=r, tracking_quality_frame_id=F.col("_f")).drop("_f", "_have", "_ball_x", "_ball_y", "_ball_role")


def pairwise_distance(scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", entity_a_field: str = "receiver_id", entity_b_field: str = "ball", maximum_distance_m: float = 10.0) -> DataFrame:
    """Distance of two entities; PASS up to the maximum, UNKNOWN if one is missing."""
    a = _at(anchors, frame_field)
    b_id = F.lit("ball") if entity_b_field == "ball" else _id(a, entity_b_field)
    a = put(a, entity_a_id=_id(a, entity_a_field), entity_b_id=b_id)
    a = located(scope, located(scope, a, "_f", "entity_a_id", "_a"), "_f", F.col("entity_b_id"), "_b")
    d = geo.dist(F.col("_a_x"), F.col("_a_y"), F.col("_b_x"), F.col("_b_y"))
    a = put(a, distance_m=d)
    s, r = cascade([(F.col("_a_x").isNull(), UNKNOWN, "missing_entity_a"), (F.col("_b_x").isNull(), UNKNOWN, "missing_entity_b"), (F.col("distance_m") <= maximum_distance_m, PASS, "within_distance")], FAIL, "beyond_distance")
    return put(a, pairwise_distance_status=s, pairwise_distance_reason=r, distance_frame_id=F.col("_f"), maximum_distance_m=F.lit(float(maximum_distance_m))).drop("_f", "_a_x", "_a_y", "_a_role", "_b_x", "_b_y", "_b_role")


def marking(
    scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", target_player_id_field: str = "receiver_id", candidate_scope: str = "opposition_outfield_to_anchor_team",
    maximum_marking_distance_m: float = 3.0, minimum_observed_marker_candidates: int = 6,
) -> DataFrame:
    """The nearest opponent of a player: PASS if within the maximum, unmarked_status the reverse; ties go to the smaller id."""
    a = located(scope, put(_at(anchors, frame_field), target_player_id=_id(anchors, target_player_id_field)), "_f", "target_player_id", "_t")
    role = _scope_role(scope, candidate_scope, F.col("_t_role"))
    near = _seen(scope, a.select(*ANCHOR, "_f", "target_player_id", "_t_x", "_t_y", "_t_role"), role).where("player_id <> target_player_id")
    d = geo.dist(F.col("x_m"), F.col("y_m"), F.col("_t_x"), F.col("_t_y"))
    best = near.groupBy(*ANCHOR).agg(F.min(F.struct(d.alias("d"), "player_id")).alias("_m"), F.count("*").alias("_n"))
    out = attach(a, best)
    out = put(out, observed_marker_candidate_count=F.coalesce("_n", F.lit(0)), nearest_marker_id=F.col("_m.player_id"), nearest_marker_distance_m=F.col("_m.d"))
    s, r = cascade(
        [
            (F.col("_t_x").isNull(), UNKNOWN, "missing_target"),
            (F.col("observed_marker_candidate_count") < minimum_observed_marker_candidates, UNKNOWN, "too_few_candidates"),
            (F.col("nearest_marker_distance_m") <= maximum_marking_distance_m, PASS, "marker_within_distance"),
        ],
        FAIL,
        "no_marker_within_distance",
    )
    out = put(out, marking_status=s, marking_reason=r, marking_frame_id=F.col("_f"), candidate_scope=F.lit(candidate_scope), target_player_team_role=F.col("_t_role"), candidate_team_role=role if role is not None else F.lit(None).cast("string"),
              maximum_marking_distance_m=F.lit(float(maximum_marking_distance_m)), minimum_observed_marker_candidates=F.lit(int(minimum_observed_marker_candidates)))
    return put(out, unmarked_status=negated(F.col("marking_status")), coverage_status=F.when(F.col("marking_status") == UNKNOWN, "INCOMPLETE").otherwise("SUFFICIENT")).drop("_f", "_t_x", "_t_y", "_t_role", "_m", "_n")


def cover_shadow(
    scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", target_entity_field: str = "receiver_id", candidate_scope: str = "opposition_outfield_to_anchor_team", maximum_lane_distance_m: float = 2.0,
    minimum_projection_fraction: float = 0.05, minimum_lane_length_m: float = 5.0, minimum_observed_defenders: int = 6,
) -> DataFrame:
    """Whether a defender stands in the lane from the ball to a player: by the line's perpendicular, between its ends."""
    edge = min(max(minimum_projection_fraction, 0.0), 0.49)
    a = put(_at(anchors, frame_field), target_entity_id=_id(anchors, target_entity_field))
    a = located(scope, located(scope, a, "_f", "ball", "_b"), "_f", "target_entity_id", "_t")
    a = put(a, lane_length_m=geo.dist(F.col("_b_x"), F.col("_b_y"), F.col("_t_x"), F.col("_t_y")))
    role = _scope_role(scope, candidate_scope, F.col("_t_role"))
    # Goalkeepers can stand in a lane as well.
    seen = _seen(scope, a.select(*ANCHOR, "_f", "_b_x", "_b_y", "_t_x", "_t_y", "_t_role"), role, outfield=True)
    xs = (F.col("x_m"), F.col("y_m"), F.col("_b_x"), F.col("_b_y"), F.col("_t_x"), F.col("_t_y"))
    seen = put(seen, _t01=geo.along(*xs), _d=geo.to_line(*xs))
    screens = (F.col("_t01") >= edge) & (F.col("_t01") <= 1 - edge) & (F.col("_d") <= maximum_lane_distance_m)
    ev = F.struct(F.round("_d", 6).alias("distance_m"), F.round("_t01", 6).alias("fraction"), "player_id", F.col("x_m").alias("x_m"), F.col("y_m").alias("y_m"))
    found = seen.groupBy(*ANCHOR).agg(F.count("*").alias("_n"), F.min(F.when(screens, ev)).alias("_s"), F.array_sort(F.collect_list(F.when(screens, ev))).alias("screening_defender_evidence"))
    out = put(attach(a, found), observed_defender_count=F.coalesce(F.col("_n"), F.lit(0)))
    s, r = cascade(
        [
            (F.col("_b_x").isNull(), UNKNOWN, "missing_ball"),
            (F.col("_t_x").isNull(), UNKNOWN, "missing_target"),
            (F.col("lane_length_m") < minimum_lane_length_m, UNKNOWN, "lane_too_short"),
            (F.col("observed_defender_count") < minimum_observed_defenders, UNKNOWN, "too_few_defenders"),
            (F.col("_s").isNotNull(), PASS, "defender_in_lane"),
        ],
        FAIL,
        "no_defender_in_lane",
    )
    out = put(
        out, cover_shadow_status=s, cover_shadow_reason=r, cover_shadow_frame_id=F.col("_f"), screening_defender_id=F.col("_s.player_id"), screening_defender_distance_to_lane_m=F.col("_s.distance_m"),
        screening_defender_projection_fraction=F.col("_s.fraction"), screening_defender_point=geo.point(F.col("_s.x_m"), F.col("_s.y_m")), ball_point=geo.point(F.col("_b_x"), F.col("_b_y")), target_point=geo.point(F.col("_t_x"), F.col("_t_y")),
        screening_projection_point=geo.point(F.col("_b_x") + F.col("_s.fraction") * (F.col("_t_x") - F.col("_b_x")), F.col("_b_y") + F.col("_s.fraction") * (F.col("_t_y") - F.col("_b_y"))),
    )
    return put(out, passing_lane_denial_status=F.col("cover_shadow_status")).drop("_f", "_b_x", "_b_y", "_b_role", "_t_x", "_t_y", "_t_role", "_n", "_s")


def space_region_generation(
    scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", zone_scope: str = "any", grid_step_m: float = 8.0, minimum_opponent_distance_m: float = 8.0, minimum_teammate_distance_m: float = 4.0,
    minimum_open_points: int = 1, maximum_candidate_points: int = 5, minimum_observed_players_per_team: int = 6,
) -> DataFrame:
    """Points of a grid that are far enough from all players, the best of them by distance.

    The grid is a constant of the plan (some 130 points at 8 m); the players of
    a frame are gathered once (at most two teams) and meet its anchors, so points
    meet players inside a row and nothing is shuffled by point or by anchor.
    """
    a = _at(anchors, frame_field)
    role = _anchor_role(scope, a)
    a = put(a, _role=role).join(scope.signs().withColumnRenamed("team_role", "_role"), [*KEYS, "_role"], "left")
    who = scope.gathered(a.select(*KEYS, F.col("_f").alias("frame_id")).distinct()).withColumnRenamed("frame_id", "_f")
    out = a.drop("_ps", "_own", "_opp").join(who, [*KEYS, "_f"], "left")
    out = put(out, _own=F.filter("_ps", lambda p: p["team_role"] == F.col("_role")), _opp=F.filter("_ps", lambda p: p["team_role"] != F.col("_role"))).drop("_ps")
    out = put(out, observed_teammate_count=F.coalesce(F.size("_own"), F.lit(0)), observed_opponent_count=F.coalesce(F.size("_opp"), F.lit(0)))

    def axis(half: float) -> list[float]:
        pts = [-half + i * grid_step_m for i in range(int(2 * half / grid_step_m + 1e-9) + 1)]
        return pts if abs(pts[-1] - half) < 1e-9 else [*pts, half]

    xs, ys = axis(geo.HALF_LENGTH_M), axis(geo.HALF_WIDTH_M)
    # A point's distance to a player is put together from the squares along either axis, which each player has once.
    square = lambda at, c: F.transform(F.array(*map(F.lit, at)), lambda v: (c - v) * (c - v))
    squares = lambda arr: F.transform(arr, lambda q: F.struct(square(xs, q["x_m"]).alias("dx"), square(ys, q["y_m"]).alias("dy")))
    out = put(out, _o=squares(F.col("_opp")), _t=squares(F.col("_own")))
    both = lambda q, p: F.get(q["dx"], p["i"]) + F.get(q["dy"], p["j"])
    grid = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, x in enumerate(xs) for j, y in enumerate(ys)])
    # Most points have somebody near: they are left out by the first such player, before any distance is ranked.
    some = lambda arr, p, least: F.exists(arr, lambda q: F.coalesce(F.sqrt(both(q, p)) < least, F.lit(False)))
    grid = F.filter(grid, lambda p: ~(some(F.col("_o"), p, minimum_opponent_distance_m) | some(F.col("_t"), p, minimum_teammate_distance_m)))
    near = lambda arr, p: F.sqrt(F.array_min(F.transform(arr, lambda q: both(q, p))))
    scored = F.transform(grid, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), near(F.col("_o"), p).alias("o"), near(F.col("_t"), p).alias("t")))
    inside = (lambda p: F.lit(True)) if zone_scope == "any" else (lambda p: geo.zone(p["x"] * F.col("sign"), zone_scope, 0.0)[0])
    kept = F.filter(scored, lambda p: inside(p) & (p["o"] >= minimum_opponent_distance_m) & (p["t"] >= minimum_teammate_distance_m))
    ranked = F.sort_array(F.transform(kept, lambda p: F.struct((-F.round(p["o"] + 0.5 * p["t"], 3)).alias("a"), (-p["x"] * F.col("sign")).alias("b"), F.abs(p["y"]).alias("c"), p["x"].alias("x_m"), p["y"].alias("y_m"), p["o"].alias("nearest_opponent_m"), p["t"].alias("nearest_teammate_m"))))
    out = put(out, _kept=F.slice(ranked, 1, int(maximum_candidate_points)))
    out = put(out, open_space_region_count=F.coalesce(F.size("_kept"), F.lit(0)))
    s, r = cascade(
        [
            (F.col("sign").isNull(), UNKNOWN, "missing_direction"),
            (F.least("observed_teammate_count", "observed_opponent_count") < minimum_observed_players_per_team, UNKNOWN, "too_few_players"),
            (F.col("open_space_region_count") >= minimum_open_points, PASS, "open_points"),
        ],
        FAIL,
        "too_few_open_points",
    )
    first = F.get("_kept", F.lit(0))
    out = put(
        out, open_space_status=s, open_space_reason=r, space_frame_id=F.col("_f"), representative_open_space_point=geo.point(first["x_m"], first["y_m"]), representative_nearest_opponent_distance_m=first["nearest_opponent_m"],
        representative_nearest_teammate_distance_m=first["nearest_teammate_m"], open_space_candidate_points=F.transform("_kept", lambda p: F.struct(p["x_m"].alias("x_m"), p["y_m"].alias("y_m"))), zone_scope=F.lit(zone_scope),
    )
    return out.drop("_f", "_role", "sign", "_own", "_opp", "_o", "_t", "_kept")


def _lookback(seconds: float) -> int:
    return max(1, frames_up(max(seconds, 0.04), geo.FRAME_RATE))


def velocity(scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", entity_id_field: str = "receiver_id", lookback_seconds: float = 0.4) -> DataFrame:
    """Displacement over the frames before; PASS if both ends are there, else UNKNOWN."""
    k = _lookback(lookback_seconds)
    dt = k / geo.FRAME_RATE
    a = put(_at(anchors, frame_field), velocity_entity_id=_id(anchors, entity_id_field))
    a = put(a, _g=F.col("_f") - k)
    a = located(scope, located(scope, a, "_f", "velocity_entity_id", "_p"), "_g", "velocity_entity_id", "_q")
    a = put(a, velocity_vx_mps=(F.col("_p_x") - F.col("_q_x")) / dt, velocity_vy_mps=(F.col("_p_y") - F.col("_q_y")) / dt)
    s, r = cascade([(F.col("_p_x").isNull() | F.col("_q_x").isNull(), UNKNOWN, "missing_endpoint")], PASS, "observed")
    a = put(a, speed_mps=F.sqrt(F.col("velocity_vx_mps") * F.col("velocity_vx_mps") + F.col("velocity_vy_mps") * F.col("velocity_vy_mps")), velocity_status=s, velocity_reason=r, velocity_frame_id=F.col("_f"), velocity_lookback_frames=F.lit(k), velocity_dt_seconds=F.lit(dt))
    return a.drop("_f", "_g", "_p_x", "_p_y", "_p_role", "_q_x", "_q_y", "_q_role")


def acceleration(
    scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", entity_id_field: str = "receiver_id", lookback_seconds: float = 0.4, minimum_abs_delta_speed_mps: float = 0.4,
    minimum_abs_acceleration_mps2: float = 0.75, maximum_player_speed_mps: float = 10.0, maximum_abs_acceleration_mps2: float = 12.0,
) -> DataFrame:
    """Change of speed between two windows next to each other; impossible values are UNKNOWN, small ones FAIL both ways."""
    k = _lookback(lookback_seconds)
    dt = k / geo.FRAME_RATE
    a = put(_at(anchors, frame_field), acceleration_entity_id=_id(anchors, entity_id_field))
    a = put(a, _g=F.col("_f") - k, _h=F.col("_f") - 2 * k)
    for frame, name in (("_f", "_p"), ("_g", "_q"), ("_h", "_r")):
        a = located(scope, a, frame, "acceleration_entity_id", name)
    speed = lambda u, v: F.round(geo.dist(F.col(f"{u}_x"), F.col(f"{u}_y"), F.col(f"{v}_x"), F.col(f"{v}_y")) / dt, 3)
    a = put(a, current_speed_mps=speed("_p", "_q"), previous_speed_mps=speed("_q", "_r"))
    a = put(a, delta_speed_mps=F.col("current_speed_mps") - F.col("previous_speed_mps"))
    a = put(a, acceleration_mps2=F.col("delta_speed_mps") / dt)
    unknown = [
        (F.col("delta_speed_mps").isNull(), UNKNOWN, "missing_window"),
        (F.greatest("current_speed_mps", "previous_speed_mps") > maximum_player_speed_mps, UNKNOWN, "impossible_speed"),
        (F.abs("acceleration_mps2") > maximum_abs_acceleration_mps2, UNKNOWN, "impossible_acceleration"),
        ((F.abs("delta_speed_mps") < minimum_abs_delta_speed_mps) | (F.abs("acceleration_mps2") < minimum_abs_acceleration_mps2), FAIL, "below_threshold"),
    ]
    up = F.col("delta_speed_mps") > 0
    s, r = cascade([*unknown, (up, PASS, "accelerating")], FAIL, "decelerating")
    t, _ = cascade([*unknown, (~up, PASS, "decelerating")], FAIL, "accelerating")
    a = put(a, acceleration_status=s, acceleration_reason=r, deceleration_status=t, acceleration_frame_id=F.col("_f"), previous_velocity_frame_id=F.col("_g"), current_velocity_frame_id=F.col("_f"), acceleration_dt_seconds=F.lit(dt))
    return a.drop("_f", "_g", "_h", *[f"{n}_{c}" for n in ("_p", "_q", "_r") for c in ("x", "y", "role")])


def off_ball_run(
    scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", candidate_scope: str = "same_team_outfield_as_anchor", lookahead_seconds: float = 1.2, minimum_run_displacement_m: float = 4.0, minimum_run_speed_mps: float = 3.0,
    minimum_ball_distance_m: float = 5.0, minimum_observed_candidates: int = 6, maximum_missing_candidate_ratio: float = 0.35,
) -> DataFrame:
    """The best run of a player away from the ball, over the frames to come.

    Candidates are those seen at either end, less the passer, carrier and relay
    player. The best passes, then is longest, then fastest, then has the smallest id. The row
    gets an anchor id of its own, over the run.
    """
    k = max(1, frames_up(max(lookahead_seconds, 0.2), geo.FRAME_RATE))
    dt = k / geo.FRAME_RATE
    a = _at(anchors, frame_field)
    role = _scope_role(scope, candidate_scope, _anchor_role(scope, a))
    a = put(a, _role=role, _g=F.col("_f") + k)
    a = a.join(scope.signs().withColumnRenamed("team_role", "_role"), [*KEYS, "_role"], "left").join(scope.last_frames(), list(KEYS), "left")
    a = written(located(scope, located(scope, a, "_f", "ball", "_b0"), "_g", "ball", "_b1"), "run_ends")  # read for either end and for the result
    not_ids = F.array_compact(F.array(*[_id(a, c) for c in ("passer_id", "carrier_id", "relay_player_id", "input_passer_id")]))
    base = a.select(*ANCHOR, "_f", "_g", "_role", "sign", "_b0_x", "_b0_y", "_b1_x", "_b1_y", not_ids.alias("_not"))
    players = scope.players()
    ends = []
    for frame, at in (("_f", 0), ("_g", 1)):
        p = players.select(*KEYS, F.col("frame_id").alias(frame), F.col("team_role").alias("_role"), "player_id", "x_m", "y_m")
        ends.append(base.join(p, [*KEYS, frame, "_role"]).where(~F.array_contains("_not", F.col("player_id"))).select(*base.columns, "player_id", F.lit(at).alias("end"), "x_m", "y_m"))
    both = ends[0].unionByName(ends[1]).groupBy(*[c for c in base.columns if c != "_not"], "player_id").agg(
        *[F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{c[0]}{e}") for e in (0, 1) for c in ("x_m", "y_m")]
    )
    seen = F.col("x0").isNotNull() & F.col("x1").isNotNull()
    disp = geo.dist(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    both = put(both, seen=seen, disp=disp, d0=geo.dist(F.col("x0"), F.col("y0"), F.col("_b0_x"), F.col("_b0_y")), d1=geo.dist(F.col("x1"), F.col("y1"), F.col("_b1_x"), F.col("_b1_y")))
    st, why = cascade(
        [
            (F.least("d0", "d1") < minimum_ball_distance_m, FAIL, "too_near_ball"),
            (F.col("disp") < minimum_run_displacement_m, FAIL, "displacement_below_minimum"),
            (F.col("disp") / dt < minimum_run_speed_mps, FAIL, "speed_below_minimum"),
        ],
        PASS,
        "run",
    )
    ev = F.struct(
        F.when(st == PASS, 0).otherwise(1).alias("a"), (-F.col("disp")).alias("b"), F.col("player_id").alias("player_id"), st.alias("status"), why.alias("reason"), "disp", "x0", "y0", "x1", "y1", "d0", "d1"
    )
    best = both.groupBy(*ANCHOR).agg(F.count_if("seen").cast("int").alias("observed_candidate_count"), F.count("*").cast("int").alias("expected_candidate_count"), F.min(F.when(F.col("seen"), ev)).alias("_best"))
    out = attach(a, best)
    out = put(out, observed_candidate_count=F.coalesce("observed_candidate_count", F.lit(0)), expected_candidate_count=F.coalesce("expected_candidate_count", F.lit(0)))
    out = put(out, missing_candidate_count=F.col("expected_candidate_count") - F.col("observed_candidate_count"), missing_candidate_ratio=1 - F.col("observed_candidate_count") / F.when(F.col("expected_candidate_count") > 0, F.col("expected_candidate_count")))
    s, r = cascade(
        [
            (F.col("_role").isNull(), UNKNOWN, "unknown_team"),
            (F.col("_g") > F.col("last_frame_id"), UNKNOWN, "window_beyond_period"),
            (F.col("_b0_x").isNull() | F.col("_b1_x").isNull(), UNKNOWN, "missing_ball"),
            (F.col("expected_candidate_count") == 0, UNKNOWN, "no_candidates"),
            (F.col("observed_candidate_count") < minimum_observed_candidates, UNKNOWN, "too_few_candidates"),
            (F.col("missing_candidate_ratio") > maximum_missing_candidate_ratio, UNKNOWN, "too_many_missing"),
            (F.col("_best.status") == PASS, PASS, "run"),
        ],
        FAIL,
        "no_run",
    )
    b = lambda n: F.col(f"_best.{n}")
    out = put(
        out, off_ball_run_status=s, off_ball_run_reason=F.when(s == FAIL, F.coalesce(b("reason"), F.lit("no_run"))).otherwise(r), source_anchor_id=F.col("anchor_id"), run_player_id=b("player_id"), run_start_frame_id=F.col("_f"), run_end_frame_id=F.col("_g"),
        run_start_point=geo.point(b("x0"), b("y0")), run_end_point=geo.point(b("x1"), b("y1")), run_duration_seconds=F.lit(dt), run_displacement_m=b("disp"), run_forward_progression_m=(b("x1") - b("x0")) * F.col("sign"), run_lateral_displacement_m=F.abs(b("y1") - b("y0")),
        run_speed_mps=b("disp") / dt, run_start_ball_distance_m=b("d0"), run_end_ball_distance_m=b("d1"), candidate_scope=F.lit(candidate_scope), candidate_team_role=F.col("_role"), _refs=F.array_compact(F.array(b("player_id"))),
    )
    out = put(out, anchor_frame_id=F.col("_f"), start_frame_id=F.col("_f"), end_frame_id=F.col("_g"))
    out = put(out, anchor_id=anchor_id(refs=F.array_union(F.col("_refs"), F.array("source_anchor_id"))), entity_refs=F.col("_refs"))
    return out.drop("_f", "_g", "_role", "sign", "last_frame_id", "_best", "_refs", *[f"{n}_{c}" for n in ("_b0", "_b1") for c in ("x", "y", "role")])


def off_ball_run_type(scope: Scope, runs: DataFrame, minimum_forward_progression_m: float = 4.0, minimum_lateral_displacement_m: float = 2.0, minimum_observed_defenders: int = 6) -> DataFrame:
    """Whether a run is diagonal, and whether it goes behind the opponents' last line (the deepest outfield player)."""
    a = put(runs, _other=_other(F.col("candidate_team_role"))).join(scope.signs().withColumnRenamed("team_role", "candidate_team_role"), [*KEYS, "candidate_team_role"], "left")
    a = runs = written(a, "runs")  # read for either line and for the result
    for frame, name in (("run_start_frame_id", "start"), ("run_end_frame_id", "end")):
        p = scope.players().select(*KEYS, F.col("frame_id").alias(frame), F.col("team_role").alias("_other"), "x_m")
        deep = runs.select(*ANCHOR, frame, "_other", "sign").join(p, [*KEYS, frame, "_other"]).groupBy(*ANCHOR).agg(F.max(F.col("x_m") * F.col("sign")).alias(f"_line_{name}"), F.count("*").cast("int").alias(f"defensive_line_candidate_count_{name}"))
        a = put(attach(a, deep), **{f"defensive_line_candidate_count_{name}": F.coalesce(F.col(f"defensive_line_candidate_count_{name}"), F.lit(0)), f"defensive_line_{name}_x_m": F.col(f"_line_{name}") * F.col("sign")})
    a = put(a, run_start_beyond_line=F.col("run_start_point.x_m") * F.col("sign") > F.col("_line_start"), run_end_beyond_line=F.col("run_end_point.x_m") * F.col("sign") > F.col("_line_end"))
    line_unknown = (F.least("defensive_line_candidate_count_start", "defensive_line_candidate_count_end") < minimum_observed_defenders) | F.col("sign").isNull()
    fwd = F.col("run_forward_progression_m") >= minimum_forward_progression_m
    base = [(F.col("off_ball_run_status") == UNKNOWN, UNKNOWN, "run_unknown"), (F.col("off_ball_run_status") == FAIL, FAIL, "no_run")]
    d, _ = cascade([*base, (fwd & (F.col("run_lateral_displacement_m") >= minimum_lateral_displacement_m), PASS, "")], FAIL, "")
    b, _ = cascade([*base, (line_unknown, UNKNOWN, ""), (~F.col("run_start_beyond_line") & F.col("run_end_beyond_line") & fwd, PASS, "")], FAIL, "")
    a = put(a, diagonal_run_status=d, run_in_behind_status=b)
    any_ = (F.col("diagonal_run_status") == PASS) | (F.col("run_in_behind_status") == PASS)
    s, r = cascade([*base, (any_, PASS, "typed"), (F.col("run_in_behind_status") == UNKNOWN, UNKNOWN, "line_unknown")], FAIL, "untyped")
    labels = F.array_compact(F.array(F.when(F.col("run_in_behind_status") == PASS, "run_in_behind"), F.when(F.col("diagonal_run_status") == PASS, "diagonal_run")))
    return put(a, off_ball_run_type_status=s, off_ball_run_type_reason=r, observed_run_type_labels=labels, source_off_ball_run_anchor_id=F.col("anchor_id"), attacking_direction=F.col("sign")).drop("_other", "sign", "_line_start", "_line_end")


def time_to_arrival(
    scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", target_mode: str = "entity", target_entity_field: str = "receiver_id", target_x_field: str = "reception_ball_x_m", target_y_field: str = "reception_ball_y_m",
    candidate_scope: str = "defending_outfield", maximum_arrival_seconds: float = 2.0, maximum_player_speed_mps: float = 7.0, minimum_observed_candidates: int = 1,
) -> DataFrame:
    """The least time in which a candidate reaches a target at the maximum speed. Goalkeepers are candidates as well."""
    a = put(_at(anchors, frame_field), _tid=_id(anchors, target_entity_field))
    if target_mode == "fields":
        a = put(a, _t_x=F.col(target_x_field).cast("double"), _t_y=F.col(target_y_field).cast("double"), _t_role=F.lit(None).cast("string"))
    else:
        a = located(scope, a, "_f", "ball" if target_mode == "ball" else "_tid", "_t")
    role = _scope_role(scope, candidate_scope, _anchor_role(scope, a))
    a = put(a, _role=role) if role is not None else put(a, _role=F.lit(None).cast("string"))
    seen = _seen(scope, a.select(*ANCHOR, "_f", "_role", "_tid", "_t_x", "_t_y"), F.col("_role") if role is not None else None, outfield=False)
    seen = seen.where(~F.coalesce(F.col("player_id") == F.col("_tid"), F.lit(False)) if target_mode == "entity" else F.lit(True))
    t = geo.dist(F.col("x_m"), F.col("y_m"), F.col("_t_x"), F.col("_t_y")) / (maximum_player_speed_mps if maximum_player_speed_mps > 0 else 1.0)
    found = seen.groupBy(*ANCHOR).agg(
        F.min(F.struct(t.alias("t"), "player_id")).alias("_best"), F.array_sort(F.collect_set("player_id")).alias("observed_candidate_player_ids"), F.array_sort(F.collect_set(F.when(t <= maximum_arrival_seconds, F.col("player_id")))).alias("arrival_player_ids")
    )
    out = put(attach(a, found), minimum_arrival_seconds=F.col("_best.t"), nearest_arrival_player_id=F.col("_best.player_id"))
    s, r = cascade(
        [
            (F.lit(maximum_player_speed_mps <= 0), UNKNOWN, "no_speed"),
            (F.col("_t_x").isNull() | F.col("_t_y").isNull(), UNKNOWN, "missing_target"),
            (F.coalesce(F.size("observed_candidate_player_ids"), F.lit(0)) < minimum_observed_candidates, UNKNOWN, "too_few_candidates"),
            (F.col("minimum_arrival_seconds") <= maximum_arrival_seconds, PASS, "reachable"),
        ],
        FAIL,
        "not_reachable",
    )
    out = put(out, time_to_arrival_status=s, time_to_arrival_reason=r, arrival_frame_id=F.col("_f"), target_point=geo.point(F.col("_t_x"), F.col("_t_y")), candidate_scope=F.lit(candidate_scope))
    return out.drop("_f", "_tid", "_t_x", "_t_y", "_t_role", "_role", "_best")


def team_compactness(scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", player_scope: str = "defending_outfield", maximum_team_width_m: float = 45.0, maximum_team_depth_m: float = 35.0, minimum_observed_players: int = 8) -> DataFrame:
    """Extent of a team's outfield players across and along the pitch."""
    a = _at(anchors, frame_field)
    seen = _seen(scope, a.select(*ANCHOR, "_f"), _scope_role(scope, player_scope, F.lit(scope.perspective)))
    found = seen.groupBy(*ANCHOR).agg(F.count("*").cast("int").alias("observed_player_count"), (F.max("y_m") - F.min("y_m")).alias("team_width_m"), (F.max("x_m") - F.min("x_m")).alias("team_depth_m"))
    out = put(attach(a, found), observed_player_count=F.coalesce("observed_player_count", F.lit(0)), team_area_m2=F.col("team_width_m") * F.col("team_depth_m"))
    s, r = cascade(
        [
            (F.col("observed_player_count") < minimum_observed_players, UNKNOWN, "too_few_players"),
            (F.col("team_width_m") > maximum_team_width_m, FAIL, "too_wide"),
            (F.col("team_depth_m") > maximum_team_depth_m, FAIL, "too_deep"),
        ],
        PASS,
        "compact",
    )
    return put(out, team_compactness_status=s, team_compactness_reason=r, team_compactness_frame_id=F.col("_f"), player_scope=F.lit(player_scope)).drop("_f")


def lane_occupancy(
    scope: Scope, anchors: DataFrame, frame_field: str = "anchor_frame_id", player_scope: str = "perspective_outfield", required_occupied_lane_count: int = 0, required_lane_ids: list[int] | None = None, required_lane_counts: dict[int, int] | None = None,
) -> DataFrame:
    """Which of five lanes hold players. Missing, doubled or impossible positions are UNKNOWN."""
    a = _at(anchors, frame_field)
    seen = _seen(scope, a.select(*ANCHOR, "_f"), _scope_role(scope, player_scope, F.lit(scope.perspective)))
    bad = F.col("x_m").isNull() | F.col("y_m").isNull() | F.isnan("x_m") | F.isnan("y_m")
    seen = put(seen, lane=geo.lane(F.col("y_m")), _bad=bad)
    found = seen.groupBy(*ANCHOR).agg(
        F.count("*").cast("int").alias("_n"), F.count_distinct("player_id").alias("_ids"), F.count_if(F.col("player_id").isNull() | (F.col("player_id") == "")).alias("_noid"), F.count_if("_bad").alias("_nbad"), F.count_if(F.col("lane").isNull() & ~F.col("_bad")).alias("_outside"),
        F.array_sort(F.collect_set("lane")).alias("occupied_lanes"), F.array_sort(F.collect_list(F.struct("player_id", "lane"))).alias("player_lane_assignments"), *[F.count_if(F.col("lane") == i).alias(f"_l{i}") for i in range(5)],
    )
    out = put(attach(a, found), occupied_lane_count=F.coalesce(F.size("occupied_lanes"), F.lit(0)))
    short = F.col("occupied_lane_count") < required_occupied_lane_count
    for i in required_lane_ids or ():
        short = short | ~F.array_contains("occupied_lanes", i)
    for i, n in (required_lane_counts or {}).items():
        short = short | (F.col(f"_l{i}") < n)
    s, r = cascade(
        [
            (F.coalesce("_n", F.lit(0)) == 0, UNKNOWN, "no_players"),
            (F.col("_noid") > 0, UNKNOWN, "invalid_player_id"),
            (F.col("_nbad") > 0, UNKNOWN, "invalid_coordinates"),
            (F.col("_ids") < F.col("_n"), UNKNOWN, "duplicate_players"),
            (F.col("_outside") > 0, UNKNOWN, "outside_lanes"),
            (short, FAIL, "requirement_not_met"),
        ],
        PASS,
        "requirement_met",
    )
    counts = F.create_map(*[x for i in range(5) for x in (F.lit(i), F.coalesce(F.col(f"_l{i}"), F.lit(0)))])
    out = put(out, lane_occupancy_status=s, lane_occupancy_reason=r, lane_evaluation_frame_id=F.col("_f"), lane_counts=counts, lane_player_scope=F.lit(player_scope), required_occupied_lane_count=F.lit(int(required_occupied_lane_count)))
    return out.drop("_f", "_n", "_ids", "_noid", "_nbad", "_outside", *[f"_l{i}" for i in range(5)])


def switch_of_play(scope: Scope, anchors: DataFrame, minimum_lateral_displacement_m: float = 25.0, minimum_start_lateral_m: float = 12.0, minimum_end_lateral_m: float = 12.0, maximum_duration_seconds: float = 8.0) -> DataFrame:
    """Whether a pass takes the ball from one side to the other, by its release and reception points."""
    a = put(anchors, _y0=F.col("release_ball_point.y_m"), _y1=F.col("reception_ball_point.y_m"))
    a = put(a, release_lateral_side=geo.side(F.col("_y0"), 1.0), reception_lateral_side=geo.side(F.col("_y1"), 1.0), lateral_displacement_m=F.abs(F.col("_y1") - F.col("_y0")))
    a = put(a, switch_duration_seconds=(F.col("controlled_reception_frame_id") - F.col("physical_release_frame_id")) / geo.FRAME_RATE)
    s, r = cascade(
        [
            (F.col("_y0").isNull() | F.col("_y1").isNull() | F.col("switch_duration_seconds").isNull(), UNKNOWN, "missing_endpoint"),
            ((F.col("release_lateral_side") == "CENTER") | (F.col("reception_lateral_side") == "CENTER"), FAIL, "central_endpoint"),
            (F.col("release_lateral_side") == F.col("reception_lateral_side"), FAIL, "same_side"),
            (F.col("lateral_displacement_m") < minimum_lateral_displacement_m, FAIL, "displacement_below_minimum"),
            ((F.abs("_y0") < minimum_start_lateral_m) | (F.abs("_y1") < minimum_end_lateral_m), FAIL, "endpoint_not_wide"),
            (F.col("switch_duration_seconds") > maximum_duration_seconds, FAIL, "too_slow"),
        ],
        PASS,
        "switched",
    )
    return put(a, switch_status=s, switch_reason=r, release_frame_id=F.col("physical_release_frame_id"), reception_frame_id=F.col("controlled_reception_frame_id")).drop("_y0", "_y1")


def local_number_relation(
    scope: Scope, anchors: DataFrame, frame_field: str = "controlled_reception_frame_id", radius_m: float = 10.0, minimum_difference: int = 1, minimum_perspective_players: int = 0, maximum_defending_players: int = 99,
) -> DataFrame:
    """Players of both teams around the ball. Missing, doubled or impossible evidence is UNKNOWN."""
    a = located(scope, _at(anchors, frame_field), "_f", "ball", "_b")
    seen = _seen(scope, a.select(*ANCHOR, "_f", "_b_x", "_b_y"), None)
    own, opp = F.col("p_role") == scope.perspective, F.col("p_role") == scope.defending
    near = geo.dist(F.col("x_m"), F.col("y_m"), F.col("_b_x"), F.col("_b_y")) <= radius_m
    bad = F.col("x_m").isNull() | F.col("y_m").isNull() | F.isnan("x_m") | F.isnan("y_m")
    found = seen.groupBy(*ANCHOR).agg(
        F.count_if(own).alias("_own"), F.count_if(opp).alias("_opp"), (F.count("*") - F.count_distinct("player_id")).alias("_twice"), F.count_if(bad).alias("_bad"), F.count_if(own & near).cast("int").alias("perspective_count"), F.count_if(opp & near).cast("int").alias("defending_count"),
        F.array_sort(F.collect_set(F.when(own & near, F.col("player_id")))).alias("perspective_in_region_player_ids"), F.array_sort(F.collect_set(F.when(opp & near, F.col("player_id")))).alias("defending_in_region_player_ids"),
        F.array_sort(F.collect_set(F.when(own, F.col("player_id")))).alias("perspective_player_ids"), F.array_sort(F.collect_set(F.when(opp, F.col("player_id")))).alias("defending_player_ids"),
    )
    out = put(attach(a, found), local_number_difference=F.col("perspective_count") - F.col("defending_count"))
    s, r = cascade(
        [
            (F.col("_b_x").isNull(), UNKNOWN, "missing_reference"),
            (F.coalesce(F.least("_own", "_opp"), F.lit(0)) == 0, UNKNOWN, "missing_players"),
            (F.col("_bad") > 0, UNKNOWN, "invalid_coordinates"),
            (F.col("_twice") > 0, UNKNOWN, "duplicate_players"),
            ((F.col("local_number_difference") >= minimum_difference) & (F.col("perspective_count") >= minimum_perspective_players) & (F.col("defending_count") <= maximum_defending_players), PASS, "relation_holds"),
        ],
        FAIL,
        "relation_fails",
    )
    return put(out, local_number_status=s, local_number_reason=r, local_number_frame_id=F.col("_f"), reference_point=geo.point(F.col("_b_x"), F.col("_b_y")), radius_m=F.lit(float(radius_m))).drop("_f", "_b_x", "_b_y", "_b_role", "_own", "_opp", "_twice", "_bad")


