"""Clocks, limits and gates of runs, and the operators that cut rows before they gather them."""

import random
import types

import pytest
from pyspark.sql import functions as F

from kinograph.functions.islands import spaced_rows
from kinograph.operators import emission, possession
from kinograph.sources import shared
from kinograph.sources.driver_views import pass_scope
from kinograph.sources.tables import Scope, Tables

STATE = "match_id string, period string, frame_id long, possession_team_role string, ball_alive boolean"


def _scope(spark, frames, **kw):
    rows = [("m", "firstHalf", f, "home" if k % 20 >= 5 else "away", True) for k, f in enumerate(frames)]
    state = spark.createDataFrame(rows, STATE)
    return Scope(Tables(ball_state=state, frames=state.select("match_id", "period", "frame_id"), positions=None), analysis_rate_hz=5, frame_rate_hz=25, minimum_possession_seconds=0.4, **kw)


def test_a_gap_in_the_analysis_stream_stops_the_run(spark):
    whole = list(range(10_000, 10_200))
    assert possession.possession_segment(_scope(spark, whole)).count() > 0
    broken = [*whole, *range(10_230, 10_400)]
    with pytest.raises(Exception, match="gap in the analysis stream: m firstHalf"):
        possession.possession_segment(_scope(spark, broken)).collect()
    assert possession.possession_segment(_scope(spark, broken, maximum_analysis_gap_ms=5000.0)).count() > 0


def test_times_count_from_the_first_frame_of_the_period(spark):
    out = possession.transition_anchor(_scope(spark, range(10_000, 10_200)), "regain", 0.2).collect()
    assert out and all(r.transition_match_time_ms == (r.anchor_frame_id - 10_000) * 40 for r in out)


def test_passes_are_timed_from_the_first_frame(spark):
    from kinograph.operators.actions import controlled_pass_episode

    scope = pass_scope(spark, "/root/testdata/sf0.001")
    first = {(r.match_id, r.period): r.first_frame_id for r in scope.first_frames().collect()}
    rows = controlled_pass_episode(scope).where("physical_release_frame_id is not null").limit(50).collect()
    assert rows and all(r.release_match_time_ms == (r.physical_release_frame_id - first[r.match_id, r.period]) * 40 for r in rows)


def test_inspection_finds_an_anchor_by_match_time(spark):
    a = spark.createDataFrame([("m", "firstHalf", "a1", 10_025), ("m", "firstHalf", "a2", 10_100)], "match_id string, period string, anchor_id string, anchor_frame_id long")
    frames = spark.createDataFrame([("m", "firstHalf", f) for f in range(10_000, 10_200)], "match_id string, period string, frame_id long")
    traces = emission.trace(a, "p", a.withColumns({"predicate_status": F.lit("PASS"), "predicate_value": F.lit("1")}))
    results = a.where("anchor_id = 'a1'").withColumn("classification", F.lit("X"))
    look = lambda ms: emission.inspect_target(a, traces, results, "m", "firstHalf", ms, 400, frames).first()
    assert (look(1000).anchor_id, look(1000).target_status, look(1000).distance_ms) == ("a1", "MATCH", 0.0)
    assert look(3900).target_status == "NON_MATCH" and look(401_000).target_status == "NO_COMPATIBLE_ANCHOR"


def test_an_anchor_with_too_many_relations_stops_the_run(spark):
    rows = [("m", "firstHalf", "a", i) for i in range(4)] + [("m", "firstHalf", "b", 1)]
    ep = spark.createDataFrame(rows, "match_id string, period string, anchor_id string, relation_count int")
    assert emission.limited_relations(ep, 4, "corridor").count() == 5
    with pytest.raises(Exception, match="corridor exceeded max_relations_per_anchor=3: anchor a has 4"):
        emission.limited_relations(ep, 3, "corridor").collect()
    assert emission.limited_counts(ep, 3, "corridor").count() == 5
    with pytest.raises(Exception, match="max_relations_per_anchor=2"):
        emission.limited_counts(ep, 2, "corridor").collect()


def test_intervals_cover_frames_whatever_their_length(spark):
    rng = random.Random(4)
    spans, at = [], 0
    for _ in range(30):
        n = rng.choice([1, 5, 255, 256, 257, 3000])
        spans.append(("m", "firstHalf", at, at + n - 1, rng.choice(["PASS", "FAIL", "UNKNOWN"])))
        at += n + rng.choice([0, 1, 300])
    anchors = [("m", "firstHalf", f"a{i}", rng.randrange(at)) for i in range(300)]
    got = emission.interval_trace(
        spark.createDataFrame(anchors, "match_id string, period string, anchor_id string, anchor_frame_id long"), "p", spark.createDataFrame(spans, "match_id string, period string, start_frame_id long, end_frame_id long, predicate_status string")
    )
    want = {a: next((s for *_, lo, hi, s in spans if lo <= f <= hi), "UNKNOWN") for _, _, a, f in anchors}
    assert {r.anchor_id: r.predicate_status for r in got.collect()} == want


def test_spaced_rows_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(2000)) for k in ("a", "b", "c") for _ in range(300)] + [("d", 5)]
    want = set()
    for key in "abcd":
        last = None
        for f in sorted({f for k, f in rows if k == key}):
            if last is None or f - last >= 8:
                last = f
                want.add((key, f))
    assert {tuple(r) for r in spaced_rows(spark.createDataFrame(rows, "k string, f long"), ["k"], "f", 8).collect()} == want


def test_many_matches_are_joined_not_listed(spark):
    rows = spark.createDataFrame([(f"m{i}", "firstHalf", i) for i in range(300)], "match_id string, period string, frame_id long")
    t = Tables(frames=rows)
    assert t.only([f"m{i}" for i in range(0, 300, 2)], ["firstHalf"]).frames.count() == 150 == t.only([f"m{i}" for i in range(0, 300, 2)], ["firstHalf", "secondHalf"]).frames.count()
    r = rows.withColumns({"anchor_id": F.col("match_id"), "anchor_frame_id": F.col("frame_id"), "classification": F.lit("X")})
    order = [f"m{i}" for i in reversed(range(300))]
    assert [x.match_id for x in emission.ordered(r, order, "plan", 5).collect()] == order[:5]


def test_positions_of_frames_that_no_span_has_are_not_grouped(spark):
    from kinograph.operators.actions import control_frames

    scope = pass_scope(spark, "/root/testdata/sf0.001")
    spans = spark.createDataFrame([("u1", "firstHalf", "e", "home", "h0", 45)], "match_id string, period string, pass_episode_id string, team_role string, who string, frame_id long")
    plan = control_frames(scope, spans, 2.5, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("collect_list") :]


def test_a_cluster_without_a_shared_folder_is_refused():
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session)


def test_tables_of_a_step_are_dropped_and_the_last_is_kept(spark):
    since = shared.written()
    one, two = shared.cut(spark.range(5), "one"), shared.cut(spark.range(7), "two")
    shared.drop(since, but_last=1)
    assert two.count() == 7 and shared.written() == since + 1
    with pytest.raises(Exception):  # noqa: B017  any reader's error
        one.count()


def test_exploded_frames_are_not_broadcast(spark):
    """Frames that are exploded from few rows look small to the optimizer; their joins merge all the same."""
    from kinograph.operators import actions

    scope = pass_scope(spark, "/root/testdata/sf0.001")
    joins = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join " in line]
    assert [j for j in joins(actions.nearest_frames(scope, scope.tables.events)) if "_bucket" in j and "SortMergeJoin" in j]
    few = scope.tables.events.select("match_id", "period", "team_role", F.col("player_id").alias("who"), F.concat_ws(":", "match_id", "row_index").alias("pass_episode_id"))
    found = joins(actions.control_frames(scope, actions._window(few, F.lit(1).cast("long"), F.lit(99).cast("long")), 2.5, 1.0))
    assert len(found) == 2 and all("SortMergeJoin" in j for j in found)


def test_bundles_gather_frames_once_and_are_compressed(spark, tmp_path):
    from kinograph.sources import build

    results = spark.createDataFrame([("m", "firstHalf", f, f"r{f}") for f in (5, 6)], "match_id string, period string, anchor_frame_id long, result_id string")
    rows = [("m", "firstHalf", f, "home", "player", p, 1.0, 2.0) for f in range(1, 9) for p in ("p2", "p1")]
    positions = spark.createDataFrame(rows, "match_id string, period string, frame_id long, team_role string, entity_type string, entity_id string, x_m double, y_m double")
    build.evidence_bundle(results, positions, str(tmp_path), 1, 1)
    parts = [p.name for p in (tmp_path / "replay").glob("part-*")]
    assert parts and all(p.endswith(".json.gz") for p in parts)
    out = spark.read.json(str(tmp_path / "replay")).collect()
    assert sorted((r.result_id, r.frame_id) for r in out) == [(f"r{f}", f + k) for f in (5, 6) for k in (-1, 0, 1)]
    assert all([e.entity_id for e in r.entities] == ["p1", "p2"] for r in out)


def test_runs_are_computed_once(spark):
    """Ends and lines read the anchors and runs from tables instead of deriving them again."""
    from kinograph.plans import registered

    since = shared.written()
    registered.QUERIES["off_ball_run_type"](spark, "/root/testdata/sf0.001")
    assert shared.written() - since == 2


def test_alignment_writes_no_positions(spark):
    from kinograph.plans import registered

    since = shared.written()
    registered.QUERIES["nearest_frame_alignment"](spark, "/root/testdata/sf0.001")
    assert shared.written() == since


def _broadcast(df):
    """What the plan of df broadcasts, as it is before any of it has run."""
    plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    return [line.strip() for line in plan if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def _passes(scope):
    """Passes of the events' schema as controlled_pass_episode writes them, in a table that looks small."""
    e = scope.tables.events
    return e.select(
        "match_id", "period", "team_role", "gameclock_seconds", F.col("row_index").alias("event_row_index"), F.concat_ws(":", "match_id", "period", F.col("row_index").cast("string")).alias("pass_episode_id"), F.col("player_id").alias("passer_id"), F.concat(F.lit("h"), (F.col("row_index") % 4).cast("string")).alias("receiver_id"),
        F.col("row_index").cast("long").alias("event_anchor_frame_id"), F.col("row_index").cast("long").alias("physical_release_frame_id"), F.col("row_index").cast("long").alias("controlled_reception_frame_id"), F.lit(1.0).alias("forward_progression_m"), F.lit("PASS").alias("controlled_pass_status"),
    )


def _written_plans(monkeypatch, module):
    """The frames that the module's operators write, by name, instead of writing them."""
    seen = {}
    monkeypatch.setattr(module, "written", lambda df, name="cut": seen.setdefault(name, df))
    return seen


def test_passes_and_positions_of_controlled_passes_are_not_broadcast(spark, monkeypatch):
    """passes were broadcast to their nearest frames, positions to their passes, as their tables look small."""
    from kinograph.operators import actions

    scope = pass_scope(spark, "/root/testdata/sf0.001")
    seen = _written_plans(monkeypatch, actions)
    actions.controlled_pass_episode(scope)
    assert not [j for j in _broadcast(seen["passes"]) if "row_index" in j or "_bucket" in j]
    assert not [j for j in _broadcast(seen["controlled"]) if "frame_id" in j.split("],")[0]]


def test_releases_and_balls_of_carries_are_not_broadcast(spark, monkeypatch):
    """all releases were broadcast to the receptions, and all balls to the analysis stream, which doesn't read them here."""
    from kinograph.operators import actions

    scope = pass_scope(spark, "/root/testdata/sf0.001")
    seen = _written_plans(monkeypatch, actions)
    carries = actions.carry_episode(scope, _passes(scope))
    assert not [j for j in _broadcast(seen["carries"]) if "_bucket" in j]
    assert not [j for j in _broadcast(carries) if "frame_id" in j.split("],")[0]]


def test_events_and_positions_of_relays_are_not_broadcast(spark, monkeypatch):
    """the numbers of events, one a row, were broadcast to the passes."""
    from kinograph.operators import actions

    scope = pass_scope(spark, "/root/testdata/sf0.001")
    seen = _written_plans(monkeypatch, actions)
    relays = actions.one_touch_relay_episode(scope, _passes(scope))
    assert not [j for j in _broadcast(seen["relays"]) if "row_index" in j]
    assert not [j for j in _broadcast(relays) if "frame_id" in j.split("],")[0]]


def test_passes_of_chains_are_not_broadcast(spark):
    """the passes were broadcast to their relays."""
    from kinograph.operators import actions

    passes = _passes(pass_scope(spark, "/root/testdata/sf0.001", tracked=False))
    relays = passes.select("match_id", "period", F.col("pass_episode_id").alias("relay_pass_episode_id"), F.lit("PASS").alias("one_touch_relay_status"))
    assert not _broadcast(actions.pass_chain_episode(relays, passes))


def test_located_positions_are_not_broadcast(spark):
    """positions, written in little room, were broadcast to the relays whose places are looked up."""
    from kinograph.sources.tables import located

    scope = pass_scope(spark, "/root/testdata/sf0.001")
    assert not _broadcast(located(scope, _passes(scope), "event_anchor_frame_id", "passer_id", "_p"))


def test_intervals_keep_no_groups(spark):
    """a hash table of all stretches was kept beside the sorted rows."""
    from kinograph.functions.islands import intervals

    df = spark.createDataFrame([("a", f) for f in (1, 2, 4, 7, 9, 9, 20)] + [("b", 5), ("b", None)], "k string, frame_id long")
    out = intervals(df, ["k"], 2)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.start_frame_id, r.end_frame_id, r.n_frames) for r in out.collect()}
    assert got == {("a", 1, 4, 3), ("a", 7, 9, 3), ("a", 20, 20, 1), ("b", 5, 5, 1), ("b", None, None, 1)}
def test_space_regions_meet_frames_that_were_gathered_once(spark):
    """players were dealt out to frames, again to anchors, and then met the anchors once more."""
    from kinograph.plans import registered

    plan = registered.QUERIES["space_region_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "anchor_id" in line]


