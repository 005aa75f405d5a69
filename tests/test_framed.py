"""Scopes whose frames are kept whole and dealt out by match: positions are neither written nor sent around, and results are those of positions."""

import random

from pyspark.sql import functions as F

from kinograph.operators import actions, relations
from kinograph.plans import registered
from kinograph.sources import shared
from kinograph.sources.driver_views import pass_scope

SF = "/root/testdata/sf0.001"


def _frames_sent(df) -> list[bool]:
    """For each place of the plan where frames are listed from events: whether they are shuffled before they meet anything."""
    above, out = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, text) for d, text in above if d < depth]
        if "Generate explode" in line and "[t#" in line:
            out.append("Exchange" in next(text for _, text in reversed(above) if any(w in text for w in ("Exchange", "Join", "Window", "Aggregate"))))
        above.append((depth, line))
    return out


def _rows(df):
    return sorted(map(str, df.collect()))


def test_set_pieces_send_and_write_no_positions(spark):
    """all positions were written and then shuffled for the few that stand at restarts."""
    since = shared.written()
    assert _frames_sent(registered.QUERIES["set_piece_structure"](spark, SF)) == [False, False]
    assert shared.written() == since


def test_set_pieces_are_those_of_positions(spark):
    want, got = (actions.set_piece_structure(pass_scope(spark, SF, framed=framed), 3) for framed in (False, True))
    assert got.columns == want.columns and _rows(got) == _rows(want)


def _plans(monkeypatch):
    """The frames that the actions write, by name, instead of writing them."""
    seen = {}
    monkeypatch.setattr(actions, "written", lambda df, name="cut": seen.setdefault(name, df))
    return seen


def test_controlled_passes_tell_a_players_frames_once(spark, monkeypatch):
    """positions were shuffled for each search and each point of a pass, and each pass had a row for every frame of its windows."""
    scope, seen = pass_scope(spark, SF, framed=True), _plans(monkeypatch)
    since = shared.written()
    actions.controlled_pass_episode(scope)
    assert shared.written() == since
    who = scope.tables.events.select("match_id", "period", "team_role", F.col("player_id").alias("who")).distinct()
    assert set(_frames_sent(actions.control_runs(scope, who, 2.5, 1.0))) == {False}
    assert list(seen) == ["passes", "controls", "releases", "controlled"]


def test_spans_meet_runs_once_whatever_their_length(spark):
    rng = random.Random(3)
    spans = [(i, lo, lo + rng.choice([-1, 0, 5, 40, 200])) for i in range(60) for lo in [rng.randrange(1000)]]
    runs = [(lo, lo + rng.choice([0, 3, 49, 50, 400])) for lo in (rng.randrange(-100, 1100) for _ in range(60))]
    want = sorted((i, a, b) for i, lo, hi in spans for a, b in runs if lo <= hi and a <= hi and b >= lo)
    s = spark.createDataFrame([("m", *x) for x in spans], "m string, i int, _lo long, _hi long")
    got = actions.overlapping(s, spark.createDataFrame([("m", *x) for x in runs], "m string, run_start long, run_end long"), ["m"], 50)
    assert sorted((r.i, r.run_start, r.run_end) for r in got.collect()) == want


def test_presences_are_told_from_changes(spark):
    """all players of all frames were sorted for their intervals, and positions were shuffled for both ends of a pass."""
    scope = pass_scope(spark, SF, framed=True)
    got = relations._presences(scope)
    assert _frames_sent(got) == [False]
    want = relations.active_intervals(pass_scope(spark, SF)).select("match_id", "period", "team_role", "player_id", "start_frame_id", "end_frame_id")
    assert [r[:] for r in sorted(got.select("match_id", "period", "team_role", "player_id", "run_start", "run_end").collect())] == [r[:] for r in sorted(want.collect())]


def _few(scope):
    """A row for some events, as passes and carries are read from written tables."""
    return scope.tables.events.drop("_part").select("match_id", "period", "team_role", F.col("player_id").alias("who"), F.col("row_index").cast("long").alias("frame_id"), F.concat_ws(":", "match_id", "row_index").alias("pass_episode_id"))


def test_frames_of_carries_are_seen_where_they_lie(spark):
    """all positions were shuffled twice for the frames of carries."""
    scope = pass_scope(spark, SF, framed=True)
    few = scope.dealt(_few(scope)).select("_part", "match_id", "period", "team_role", "who", "pass_episode_id", (F.col("frame_id") * 40).alias("a"))
    spans = lambda df: actions._window(df, F.col("a"), F.col("a") + 50).drop("a")
    got = actions.control_frames(scope, spans(few), 2.5, 1.0)
    assert _frames_sent(got) == [False]
    want = actions.control_frames(pass_scope(spark, SF), spans(few.drop("_part")), 2.5, 1.0)
    assert _rows(got.select(*want.columns)) == _rows(want)


def _passes(scope):
    """Passes of the events' schema as controlled_pass_episode writes them."""
    e = scope.tables.events.drop("_part")
    at = F.col("row_index").cast("long") * 40 + 8
    return e.select(
        "match_id", "period", "team_role", "gameclock_seconds", F.col("row_index").alias("event_row_index"), F.concat_ws(":", "match_id", "period", F.col("row_index").cast("string")).alias("pass_episode_id"), F.col("player_id").alias("passer_id"),
        F.get_json_object("qualifier_json", "$.Recipient").alias("receiver_id"), at.alias("event_anchor_frame_id"), at.alias("physical_release_frame_id"),
    )


def test_touches_are_seen_where_frames_lie(spark, monkeypatch):
    """all balls and players were shuffled for the few frames around relays."""
    scope = pass_scope(spark, SF, framed=True)
    passes = _passes(scope)
    want = actions.one_touch_relay_episode(pass_scope(spark, SF), passes)
    got = actions.one_touch_relay_episode(scope, passes)
    assert got.count() > 0 and _rows(got) == _rows(want)
    seen = _plans(monkeypatch)
    actions.one_touch_relay_episode(scope, passes)
    assert list(seen) == ["relays", "touches"] and _frames_sent(seen["touches"]) == [False]


def test_chains_read_relays_from_a_table(spark):
    """relays were derived again, from all positions, where chains read them."""
    scope = pass_scope(spark, SF, framed=True)
    relays = actions.one_touch_relay_episode(scope, _passes(scope))
    assert "Exchange" not in relays._jdf.queryExecution().executedPlan().toString() and relays.count() > 0


def test_places_at_few_frames_are_cut_out(spark):
    """lines and places at relays were looked up in all positions, three times."""
    scope = pass_scope(spark, SF, framed=True)
    few = _few(scope).where("frame_id % 7 = 0")
    cut, whole = scope.at(few, "frame_id").tables.positions, pass_scope(spark, SF).tables.positions
    keys = ["match_id", "period", "frame_id"]
    assert 0 < cut.count() < whole.count() / 100
    assert _rows(cut) == _rows(whole.join(few.select(*keys).distinct(), keys, "left_semi").select(*cut.columns))
