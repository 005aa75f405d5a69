"""Kernels on small hand-made cases: boundaries, missing and doubled evidence, mirrored and shuffled input."""

import random

import pytest
from pyspark.sql import functions as F

from kinograph.functions import islands, tri
from kinograph.functions.identity import anchor_id, stable_hash
from kinograph.operators import actions, compose, geometry, lines, possession, relations
from kinograph.plans import recipes
from kinograph.sources import build
from kinograph.sources.tables import SCHEMAS, Scope, Tables

M = ("m", "firstHalf")
POS = "match_id string, period string, frame_id long, team_role string, entity_id string, entity_type string, x_m double, y_m double"


def scope_of(spark, frames, sign=1, keepers=("hg", "ag"), perspective="home", swap=1, shuffle=False, events=None, alive=True, unknown=()):
    """frames: {frame: {entity: (x, y)}}; entities beginning with h or a are players, ball is the ball. swap=-1 mirrors both axes."""
    rows = [(*M, f, "ball" if e == "ball" else ("home" if e[0] == "h" else "away"), e, "ball" if e == "ball" else "player", None if x is None else x * swap, None if y is None else y * swap) for f, ps in frames.items() for e, xy in ps.items() for x, y in [xy]]
    if shuffle:
        random.Random(1).shuffle(rows)
    ids = sorted({r[4] for r in rows if r[5] == "player"})
    players = spark.createDataFrame([("m", i, None if i in unknown else i in keepers) for i in ids] or [("m", "x", True)], "match_id string, player_id string, is_goalkeeper boolean")
    sides = spark.createDataFrame([(*M, "home", sign * swap), (*M, "away", -sign * swap)], "match_id string, period string, team_role string, attack_x_sign int")
    fr = spark.createDataFrame([(*M, f, f"2024-01-01T00:{f * 40 // 60000:02d}:{f * 40 // 1000 % 60:02d}.{f * 40 % 1000:03d}Z") for f in frames], "match_id string, period string, frame_id long, timestamp_utc string")
    state = spark.createDataFrame([(*M, f, "home", alive) for f in frames], "match_id string, period string, frame_id long, possession_team_role string, ball_alive boolean")
    return Scope(Tables(positions=spark.createDataFrame(rows, POS), players=players, orientation=sides, frames=fr, ball_state=state, events=events), perspective)


def anchors_of(spark, *rows, **cols):
    """One anchor for each (id, frame)."""
    df = spark.createDataFrame([(*M, i, f, f, f) for i, f in rows], "match_id string, period string, anchor_id string, anchor_frame_id long, start_frame_id long, end_frame_id long")
    return df.withColumns({k: F.lit(v) for k, v in cols.items()}) if cols else df


def one(df, *cols):
    r = df.collect()
    assert len(r) == 1
    return tuple(r[0][c] for c in cols) if len(cols) > 1 else r[0][cols[0]]


LINE = {"a1": (20.0, -9.0), "a2": (20.5, -3.0), "a3": (21.0, 3.0), "a4": (21.9, 9.0), "a5": (5.0, 0.0), "ag": (50.0, 0.0), "h1": (0.0, 0.0), "hg": (-50.0, 0.0), "ball": (0.0, 0.0)}


@pytest.mark.parametrize("swap", [1, -1])
@pytest.mark.parametrize("shuffle", [False, True])
def test_defensive_line(spark, swap, shuffle):
    s = scope_of(spark, {100: LINE}, swap=swap, shuffle=shuffle)
    got = one(lines.defensive_line_model(s, anchors_of(spark, ("a", 100))), "line_status", "normalized_line_x_m", "defensive_line_player_ids", "line_compactness_m")
    assert got[0] == "PASS" and got[1] == pytest.approx(20.85) and got[2] == ["a1", "a2", "a3", "a4"] and got[3] == pytest.approx(1.9)


@pytest.mark.parametrize(
    ("change", "status", "reason"),
    [
        ({"a4": (22.1, 9.0)}, "FAIL", "no_line"),
        ({"a4": (22.0, 9.0)}, "PASS", "line"),
        ({"ball": None}, "UNKNOWN", "missing_ball"),
        ({"a1": None, "a2": None}, "UNKNOWN", "too_few_defenders"),
        ({**{f"a{i}": (19.0, float(i)) for i in range(1, 5)}, **{f"a{i}": (30.0, float(i)) for i in range(6, 10)}}, "UNKNOWN", "ambiguous_line"),
        ({"ball": (20.0, 0.0)}, "FAIL", "no_line"),
    ],
)
def test_defensive_line_cases(spark, change, status, reason):
    frame = {k: v for k, v in (LINE | change).items() if v is not None}
    assert one(lines.defensive_line_model(scope_of(spark, {100: frame}), anchors_of(spark, ("a", 100))), "line_status", "line_reason") == (status, reason)


def test_multi_line(spark):
    frame = {"ball": (0.0, 0.0)} | {f"a{i}": (10.0 + i % 3, float(i)) for i in range(3)} | {f"a{i}": (25.0, float(i)) for i in range(3, 6)}
    s = scope_of(spark, {100: frame})
    a = anchors_of(spark, ("a", 100), physical_release_frame_id=100)
    assert one(lines.multi_line_model(s, a), "multi_line_status", "normalized_line_x_m", "observed_line_count") == ("PASS", 25.0, 2)
    assert one(lines.multi_line_model(s, a, target_line_rank=3), "multi_line_status") == "FAIL"


@pytest.mark.parametrize(("x", "want"), [(20.85 + 0.6, "AHEAD"), (20.85 + 0.4, "LEVEL"), (20.85 - 0.6, "BEHIND"), (None, "UNKNOWN")])
@pytest.mark.parametrize("swap", [1, -1])
def test_relative_position(spark, x, want, swap):
    frame = dict(LINE) | ({"h1": (x, 5.0)} if x is not None else {})
    if x is None:
        del frame["h1"]
    s = scope_of(spark, {100: frame}, swap=swap)
    a = anchors_of(spark, ("a", 100), receiver_id="h1", controlled_reception_frame_id=100)
    assert one(lines.relative_position_to_line(s, lines.defensive_line_model(s, a), a), "relative_position_status") == want


def test_marking_ties_and_bounds(spark):
    s = scope_of(spark, {1: {"h1": (0.0, 0.0), "a2": (3.0, 0.0), "a1": (-3.0, 0.0), "ag": (1.0, 0.0)}})
    a = anchors_of(spark, ("a", 1), receiver_id="h1")
    assert one(geometry.marking(s, a, minimum_observed_marker_candidates=2), "marking_status", "unmarked_status", "nearest_marker_id") == ("PASS", "FAIL", "a1")
    assert one(geometry.marking(s, a, minimum_observed_marker_candidates=3), "marking_status", "unmarked_status") == ("UNKNOWN", "UNKNOWN")


def test_lanes_are_half_open(spark):
    s = scope_of(spark, {1: {"h1": (0.0, -34.0), "h2": (0.0, -20.4), "h3": (0.0, 34.0)}, 2: {"h1": (0.0, 35.0)}})
    assert one(geometry.lane_occupancy(s, anchors_of(spark, ("a", 1)), required_occupied_lane_count=3), "occupied_lanes", "lane_occupancy_status") == ([0, 1, 4], "PASS")
    assert one(geometry.lane_occupancy(s, anchors_of(spark, ("a", 2))), "lane_occupancy_reason") == "outside_lanes"
    assert one(geometry.lane_occupancy(s, anchors_of(spark, ("a", 3))), "lane_occupancy_status") == "UNKNOWN"


def test_kinematics(spark):
    s = scope_of(spark, {100 - k: {"h1": (x, 0.0)} for k, x in ((0, 4.0), (10, 1.0), (20, 0.0))})
    a = anchors_of(spark, ("a", 100), receiver_id="h1")
    assert one(geometry.velocity(s, a), "speed_mps", "velocity_status") == (7.5, "PASS")
    assert one(geometry.acceleration(s, a), "delta_speed_mps", "acceleration_status", "deceleration_status") == (5.0, "UNKNOWN", "UNKNOWN")
    assert one(geometry.acceleration(s, a, maximum_abs_acceleration_mps2=13.0), "acceleration_status", "deceleration_status") == ("PASS", "FAIL")
    assert one(geometry.velocity(s, anchors_of(spark, ("a", 90), receiver_id="h2")), "velocity_status") == "UNKNOWN"


def test_pressure_needs_time_distance_and_heading(spark):
    frames = {f: {"h1": (0.0, 0.0), "a1": (6.0 - (f - 80) * 0.1, 0.0)} for f in range(80, 121)}
    s = scope_of(spark, frames)
    a = anchors_of(spark, ("a", 120), receiver_id="h1", controlled_reception_frame_id=120)
    assert one(relations.pressure_on_carrier(s, a), "pressure_status", "nearest_defender_distance_m") == ("PASS", pytest.approx(2.0))
    assert one(relations.pressure_on_carrier(s, a, minimum_pressure_duration_seconds=0.4), "pressure_status") == "PASS"
    assert one(relations.pressure_on_carrier(s, a, minimum_pressure_duration_seconds=1.0), "pressure_reason") == "too_brief"
    assert one(relations.pressure_on_carrier(s, anchors_of(spark, ("a", 85), receiver_id="h1", controlled_reception_frame_id=85)), "pressure_reason") == "missing_lookback"


def test_support_needs_to_stay(spark):
    near = lambda f: (3.0, 0.0) if 10 <= f <= 30 else (20.0, 0.0)
    s = scope_of(spark, {f: {"ball": (0.0, 0.0), "h2": near(f), "h1": (0.0, 0.0)} for f in range(0, 120)})
    a = anchors_of(spark, ("a", 5), controlled_reception_frame_id=5, receiver_id="h1")
    assert one(relations.support_arrival_relation(s, a), "support_arrival_status", "supporting_player_ids", "first_arrival_frame_id") == ("PASS", ["h2"], 10)
    assert one(relations.support_arrival_relation(s, a, minimum_duration_seconds=1.0), "support_arrival_status") == "FAIL"
    assert one(relations.support_arrival_relation(s, a.withColumn("line_break_status", F.lit("FAIL")), required_anchor_status_field="line_break_status"), "support_arrival_status") == "FAIL"


def _event(i, kind, frame, player, recipient, team="home", done="successfullyCompleted"):
    ms = frame * 40 + 15
    return (*M, team, i, kind, ms / 1000, None, player, f"2024-01-01T00:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z", f'{{"Evaluation": "{done}", "Player": "{player}", "Recipient": "{recipient}"}}')


def _events(spark, *rows):
    return spark.createDataFrame(list(rows), "match_id string, period string, team_role string, row_index int, event_type string, gameclock_seconds double, team_id string, player_id string, timestamp string, qualifier_json string")


def passing(dx=20.0, gone=(), stop=1.0):
    """h1 passes to h2 between frames 110 and 130; five opponents stand between them and goal."""
    out = {}
    for f in range(60, 330):
        s = min(max((f - 110) / 20, 0.0), stop)
        out[f] = {"h1": (0.0, 0.0), "h2": (dx, 0.0), "h3": (-30.0, 20.0), "hg": (-45.0, 0.0), "ag": (50.0, 0.0), **{f"a{i}": (4.0 + 2 * i, 15.0 + i) for i in range(1, 6)}}
        if f not in gone:
            out[f]["ball"] = (0.5 + s * (dx - 1.0), 0.0)
    return out


def test_controlled_pass_and_bypass(spark):
    s = scope_of(spark, passing(), events=_events(spark, _event(1, "Play_Pass", 112, "h1", "h2")))
    p = actions.controlled_pass_episode(s)
    got = one(p, "controlled_pass_status", "physical_release_frame_id", "controlled_reception_frame_id", "forward_progression_m")
    assert got[0] == "PASS" and 110 <= got[1] <= 113 and 126 <= got[2] <= 130 and got[3] > 12
    b = recipes.high_bypass_completed_pass(s, p, 8.0, 5)
    assert one(b, "evaluation_status", "opponents_bypassed_count", "bypassed_player_ids", "high_bypass_status") == ("PASS", 5, [f"a{i}" for i in range(1, 6)], "PASS")


@pytest.mark.parametrize(
    ("kw", "status"),
    [({"stop": 0.6}, "FAIL"), ({"gone": range(114, 300, 3)}, "UNKNOWN")],
)
def test_pass_that_is_not_received(spark, kw, status):
    s = scope_of(spark, passing(**kw), events=_events(spark, _event(1, "Play_Pass", 112, "h1", "h2")))
    assert one(actions.controlled_pass_episode(s), "controlled_pass_status") == status


def test_window_cut_by_the_period_is_unknown(spark):
    frames = {f: v for f, v in passing(stop=0.6).items() if f < 160}
    s = scope_of(spark, frames, events=_events(spark, _event(1, "Play_Pass", 112, "h1", "h2")))
    assert one(actions.controlled_pass_episode(s), "controlled_reception_status", "reception_reason") == ("UNKNOWN", "window_truncated")
    assert one(actions.controlled_pass_episode(s, compat=True), "controlled_reception_status") == "FAIL"


def test_unknown_goalkeeper_makes_bypass_unknown(spark):
    s = scope_of(spark, passing(), events=_events(spark, _event(1, "Play_Pass", 112, "h1", "h2")), unknown=("a3",))
    assert one(relations.opponents_bypassed_by_action(s, actions.controlled_pass_episode(s)), "evaluation_status", "unknown_reason") == ("UNKNOWN", "unknown_goalkeeper")


def test_events_without_a_frame_are_left_out_or_unknown(spark):
    e = _events(spark, _event(1, "Play_Pass", 112, "h1", "h2"), _event(2, "Play_Pass", 900, "h1", "h2"), _event(3, "CornerKick_X", 900, "h1", "h2"), _event(4, "Play_Pass", 113, "h1", "h2", done="unsuccessful"))
    s = scope_of(spark, passing(), events=e)
    assert one(actions.action_event_anchor(s), "event_row_index", "event_anchor_frame_id") == (1, 112)
    got = {r.event_row_index: r.set_piece_structure_reason for r in actions.set_piece_structure(s).collect()}
    assert got == {1: "non_set_piece", 2: "non_set_piece", 3: "unaligned", 4: "non_set_piece"}


def test_join_of_episode_sets(spark):
    s = Scope(Tables())
    left = anchors_of(spark, ("a", 10), ("b", 20), ("c", 30)).withColumn("k", F.col("anchor_id"))
    right = anchors_of(spark, ("x", 15), ("y", 5), ("z", 6)).withColumn("k", F.when(F.col("anchor_id") == "x", "a").otherwise("b"))
    got = {r.left_anchor_id: (r.join_status, r.join_reason, r.right_anchor_frame_id) for r in compose.join_episode_sets(s, left, right, "k", "k", temporal_relation="left_ends_before_right").collect()}
    assert got == {"a": ("PASS", "joined", 15), "b": ("UNKNOWN", "several_matches", None), "c": ("FAIL", "no_match", None)}


def test_islands_against_a_state_machine(spark):
    rng = random.Random(7)
    seqs = [[rng.random() < 0.6 for _ in range(rng.randint(1, 14))] for _ in range(60)]
    df = spark.createDataFrame([(k, i, i, v) for k, s in enumerate(seqs) for i, v in enumerate(s)], "k int, idx long, frame_id long, v boolean")
    for o, c in ((1, 1), (2, 2), (2, 1), (3, 2)):
        got = sorted((r.k, r.start_frame_id, r.end_frame_id) for r in islands.hysteresis(df, F.col("v"), o, c, ["k"]).collect())
        want = []
        for k, s in enumerate(seqs):
            hits, start = [], None
            run, miss = [], 0
            for i, v in enumerate(s):
                if start is None:
                    run = [*run, i] if v else []
                    if len(run) == o:
                        start, hits, miss = run[0], ([run[0], i] if o > 1 else [i]), 0
                elif v:
                    hits.append(i)
                    miss = 0
                else:
                    miss += 1
                    if miss == c:
                        if len(hits) >= o:
                            want.append((k, start, hits[-1]))
                        start, run = None, []
            if start is not None and len(hits) >= o:
                want.append((k, start, hits[-1]))
        assert got == sorted(want)


def test_persistence_marks_what_may_be(spark):
    seq = [True, True, None, True, False, True, True, True]
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(seq)], "k int, idx long, frame_id long, v boolean")
    got = [r.persist_status for r in islands.persists(df, F.col("v"), 3, ["k"]).orderBy("idx").collect()]
    assert got == ["UNKNOWN"] * 4 + ["FAIL"] + ["PASS"] * 3


def test_ids_are_those_of_canonical_json(spark):
    df = spark.createDataFrame([("m", "firstHalf", 7, None, 9, ["b", "a"])], "match_id string, period string, anchor_frame_id long, start_frame_id long, end_frame_id long, refs array<string>")
    want = stable_hash({"match_id": "m", "period": "firstHalf", "anchor_frame_id": 7, "start_frame_id": None, "end_frame_id": 9, "entity_refs": ["a", "b"]})[:16]
    assert df.select(anchor_id(refs=F.col("refs")).alias("i")).first().i == want


def test_tri_state(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (3.0,)], "x double")
    got = [r.s for r in df.select(tri.status(tri.known(F.col("x")) > 2).alias("s")).collect()]
    assert got == ["UNKNOWN", "UNKNOWN", "FAIL", "PASS"]
    both = spark.createDataFrame([("PASS", "UNKNOWN"), ("FAIL", "UNKNOWN"), ("PASS", "PASS")], "a string, b string")
    assert [r.s for r in both.select(tri.all_of([F.col("a"), F.col("b")]).alias("s")).collect()] == ["UNKNOWN", "FAIL", "PASS"]
    assert (tri.frames_rounded(0.5, 5), tri.frames_up(0.4, 25), tri.frames_up(0.41, 25)) == (2, 10, 11)


def test_corridor_and_entry(spark):
    frames = {f: {"ball": (0.0, -10.0 if f < 50 else 10.0), "h1": (0.0, -10.0), "h2": (20.0, 10.0), "a1": (10.0, 20.0 if f < 25 else 0.0)} for f in range(0, 100)}
    s = scope_of(spark, frames)
    ep, ev = relations.geometric_progressive_corridor(s, anchors_of(spark, ("a", 0)), 2.0, 5.0, 5.0, 60.0, 3.0)
    got = one(ep, "target_player_id", "open_frame_id", "close_frame_id", "destination_side")
    assert got == ("h2", 0, 20, "right") and one(ev, "evaluation_status", "relation_count") == ("PASS", 1)
    assert one(relations.relation_destination_entry(s, ep, 3.0), "entry_status", "destination_entry_frame_id") == ("PASS", 50)
    assert one(relations.relation_destination_entry(s, ep, 1.0), "entry_status") == "FAIL"


def test_tables_are_built_from_raw_files(spark, tmp_path):
    frame = lambda n, x, extra="": f'<Frame N="{n}" T="2024-01-01T00:00:0{n}Z" X="{x}" Y="1.0" {extra}/>'
    tracking = "<Positions>" + "".join(
        f'<FrameSet GameSection="firstHalf" MatchId="m1" TeamId="{t}" PersonId="{p}">{"".join(frame(n, x, e) for n, x, e in fs)}</FrameSet>'
        for t, p, fs in (("BALL", "b", [(1, 0, 'BallPossession="1" BallStatus="1"'), (2, 1, 'BallPossession="2" BallStatus="0"')]), ("T1", "p1", [(1, 5, ""), (2, "NaN", "")]), ("REF", "r", [(1, 9, "")]))
    ) + "</Positions>"
    info = '<Info><MatchInformation><General MatchId="m1" MatchTitle="A:B"/><Environment PitchX="105" PitchY="68"/><Teams><Team TeamId="T1" TeamName="A" Role="home"><Players><Player PersonId="p1" PlayingPosition="TW" Starting="true"/><Player PersonId="p2"/></Players></Team></Teams></MatchInformation></Info>'
    (tmp_path / "tracking.xml").write_text(tracking)
    (tmp_path / "info.xml").write_text(info)
    root = f"file://{tmp_path}/canonical"
    build.build(spark, {"tracking": f"file://{tmp_path}/tracking.xml", "information": f"file://{tmp_path}/info.xml"}, root)
    build.build(spark, {"tracking": f"file://{tmp_path}/tracking.xml", "information": f"file://{tmp_path}/info.xml"}, root)  # replaces, doesn't add
    read = lambda t: getattr(Tables.read(spark, root), t)
    assert sorted((r.entity_id, r.frame_id, r.entity_type, r.team_role) for r in read("positions").collect()) == [("b", 1, "ball", "ball"), ("b", 2, "ball", "ball"), ("p1", 1, "player", "home")]
    assert [(r.possession_team_role, r.ball_alive) for r in read("ball_state").orderBy("frame_id").collect()] == [("home", True), ("away", False)]
    assert {r.player_id: r.is_goalkeeper for r in read("players").collect()} == {"p1": True, "p2": None}
    lock = build.source_lock(spark, f"file://{tmp_path}/*.xml")
    assert lock.count() == 2 and build.lock_differences(lock, lock).count() == 0
    q = build.quality_report(read("positions"), read("frames")).first()
    assert (q.rows, q.player_rows, q.frame_parity) == (3, 1, True)
    raw = build.framesets(spark, f"file://{tmp_path}/tracking.xml").where("entity_id = 'p1' and frame_id = 1")
    assert build.parity_samples(raw, read("positions")).where("equal").count() == 1


def test_zone_buffers(spark):
    s = scope_of(spark, {1: {"ball": (17.9, 0.0)}, 2: {"ball": (18.1, 0.0)}, 3: {"ball": (0.0, 0.0)}})
    got = {r.anchor_id: r.zone_status for r in possession.structured_zone(s, anchors_of(spark, ("a", 1), ("b", 2), ("c", 3), ("d", 4)), zone_name="final_third").collect()}
    assert got == {"a": "UNKNOWN", "b": "PASS", "c": "FAIL", "d": "UNKNOWN"}
