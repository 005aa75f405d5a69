"""Proof selection and evidence of witnesses on cases where other rules would differ."""

import random

import pytest
from pyspark.sql import functions as F

from kinograph.operators import emission
from kinograph.plans import bind, compile, recipes
from kinograph.sources.tables import Tables

ROW = "match_id string, period string, anchor_frame_id long, anchor_id string, classification string, result_id string"


def greedy(rows, overall, per_match):
    """One after the other: two switched, two that were not, then all, while neither limit is reached."""
    rows = sorted(rows)
    taken, by = [], {}
    for some in ([r for r in rows if r[4] == "SWITCHED"][:2], [r for r in rows if r[4] in emission.NOT_SWITCHED][:2], rows):
        for r in some:
            if len(taken) < overall and by.get(r[0], 0) < per_match and all(r[5] != t[5] for t in taken):
                taken.append(r)
                by[r[0]] = by.get(r[0], 0) + 1
    return sorted(taken)


@pytest.mark.parametrize("seed", range(5))
def test_proof_is_filled_in_order(spark, seed):
    rng = random.Random(seed)
    labels = ["SWITCHED", "RETAINED_NO_SWITCH", "LOST_BEFORE_SWITCH", "STOPPAGE", "OTHER"]
    rows = [(f"m{rng.randint(0, 4)}", "firstHalf", i, f"a{i}", rng.choices(labels, (1, 1, 1, 4, 4))[0], f"r{i}") for i in range(rng.choice([3, 12, 60]))]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    for overall, per_match in ((16, 5), (5, 1), (2, 2), (8, 2)):
        assert [tuple(r) for r in emission.proof_selection(df, overall, per_match).select(*[c.split()[0] for c in ROW.split(", ")]).collect()] == greedy(rows, overall, per_match)


def test_the_first_two_of_all_come_before_the_rest(spark):
    """Both switched ones are of the last match; other labels are no second pick."""
    rows = [("a", "firstHalf", i, f"a{i}", "STOPPAGE", f"ra{i}") for i in range(9)] + [("z", "firstHalf", i, f"z{i}", "SWITCHED" if i > 7 else "LOST_BEFORE_SWITCH", f"rz{i}") for i in range(10)]
    got = [r.anchor_id for r in emission.proof_selection(spark.createDataFrame(rows, ROW), 7, 5).collect()]
    assert got == ["a0", "a1", "a2", "z0", "z1", "z8", "z9"]


def test_evidence_is_that_of_the_witness(spark):
    key = "match_id string, period string, anchor_id string, "
    anchors = spark.createDataFrame([("m", "h", x, 7) for x in "abcd"], key + "anchor_frame_id long")
    episodes = spark.createDataFrame([("m", "h", "a", 7, "r1", 1.0), ("m", "h", "a", 7, "r2", 2.0), ("m", "h", "b", 7, "r3", 3.0), ("m", "h", "b", 7, None, 4.0), ("m", "h", "c", 7, "r5", 5.0), ("m", "h", "c", 7, "r6", None)], key + "anchor_frame_id long, relation_id string, v double")
    evaluations = spark.createDataFrame([("m", "h", "a", "r2"), ("m", "h", "b", "r9"), ("m", "h", "c", None)], key + "witness_relation_id string")
    trace = spark.createDataFrame([("m", "h", "c", 7, "r6"), ("m", "h", "x", 7, "r1")], key + "anchor_frame_id long, witness_relation_id string")
    w = emission.witnesses(anchors, [trace], evaluations)
    assert {r.anchor_id: r.relation_id for r in w.collect()} == {"a": "r2", "b": "r9", "c": "r6"}
    signal = spark.createDataFrame([("m", "h", 7, 0.5), ("m", "h", 8, 0.6)], "match_id string, period string, frame_id long, fraction double")
    got = emission.project(anchors, [(episodes, "v", "v", True, w), (episodes, "v", "first", False), (signal, "fraction", "fraction", True)])
    # b: of the witness there is no episode, but one without a relation; c: the witness's field is null, and so missing
    assert {r.anchor_id: (r.v, r.first, r.fraction, r.evidence_missing) for r in got.collect()} == {"a": (2.0, 1.0, 0.5, 0), "b": (4.0, 4.0, 0.5, 0), "c": (None, 5.0, 0.5, 1), "d": (None, None, 0.5, 1)}


def test_plan_takes_the_relation_that_the_entry_chose(spark, tmp_path):
    """Two lines are open at one anchor; the evidence of the relation is that of the one that the ball went to, not the longest."""
    pos = [("m", "firstHalf", f, r, e, "ball" if e == "ball" else "player", x, y) for f in range(400) for e, r, x, y in (
        ("ball", "ball", 0.0, 0.0 if f < 60 else 20.0), ("h1", "home", 0.0, 0.0), ("h2", "home", 20.0, -25.0), ("h3", "home", 20.0, 20.0), ("a1", "away", 10.0, 30.0 if 5 < f else 12.0), ("hg", "home", -50.0, 0.0), ("ag", "away", 50.0, 0.0))]
    state = [("m", "firstHalf", f, "home", True) for f in range(400)]
    made = {"positions": (pos, "match_id string, period string, frame_id long, team_role string, entity_id string, entity_type string, x_m double, y_m double"), "ball_state": (state, "match_id string, period string, frame_id long, possession_team_role string, ball_alive boolean")}
    for name, (rows, ddl) in made.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}")
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in made}
    players = spark.createDataFrame([("m", e, e in ("hg", "ag")) for e in ("h1", "h2", "h3", "a1", "hg", "ag")], "match_id string, player_id string, is_goalkeeper boolean")
    sides = spark.createDataFrame([("m", "firstHalf", "home", 1), ("m", "firstHalf", "away", -1)], "match_id string, period string, team_role string, attack_x_sign int")
    t = Tables(**read, players=players, orientation=sides, frames=read["ball_state"].select("match_id", "period", "frame_id"))
    import dataclasses

    doc = recipes.corridor_document(["m"])
    episodes = recipes.SignalRef("corridor", "episodes")
    plan = dataclasses.replace(doc.draft_plan, requested_evidence=[recipes.EvidenceRequest(episodes, "target_player_id"), recipes.EvidenceRequest(episodes, "destination_region")])
    doc = dataclasses.replace(doc, draft_plan=plan, default_invocation=dataclasses.replace(doc.default_invocation, periods=["firstHalf"]))
    got = compile.compile_plan(bind.bind_document(doc), t)
    both = {r.target_player_id for r in got.nodes["corridor"]["episodes"].collect()}
    assert {"h2", "h3"} <= both
    entry = got.nodes["entry"]["entry_status"].select("target_player_id", F.col("entry_status")).collect()
    assert [(r.target_player_id, r.entry_status) for r in entry] == [("h3", "PASS")]
    assert [(r.target_player_id, r.destination_region) for r in got.results.collect()] == [("h3", "right_half_space")]
