"""The registered queries of the operators over the derived views, each with its SQL for an independent engine."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.islands import hysteresis, spaced_rows
from ..operators import actions, compose, emission, geometry, lines, possession, predicates, relations
from ..sources import build
from ..sources.shared import scratch
from ..sources.driver_views import pass_scope, pass_sql, signal_scope, sql_of, tracking_scope
from . import recipes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def _with(views: str, sql: str) -> str:
    extra = {
        "outfield": "SELECT * FROM trk WHERE player_id <> 'p7'",
        "sgn": "SELECT 'home' AS team_role, 1 AS sign UNION ALL SELECT 'away', -1",
        "st": "SELECT *, frame_id - 1 AS idx, role = 'home' AND alive AS has FROM sig",
        "lastf": "SELECT match_id, max(frame_id) AS last_frame_id FROM frames GROUP BY match_id",
    }
    parts = [f"{v} AS ({extra[v] if v in extra else sql_of(v)})" for v in views.split()]
    return "WITH " + ",\n".join(parts) + (",\n" if sql.lstrip().startswith(("--", "x_")) else "\n") + sql


def query(name: str, views: str | None = None, oracle: str | None = None):
    """Register a query; oracle begins with the name of a further common table (x_...) or with SELECT."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = _with(views, oracle) if views else oracle
        return f

    return add


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# Possession and signals


@query(
    "possession_segment", "sig st",
    """x_g AS (SELECT *, idx - row_number() OVER (PARTITION BY match_id ORDER BY idx) AS g FROM st WHERE has)
SELECT match_id, min(frame_id) AS anchor_frame_id, max(frame_id) AS end_frame_id, round(CAST(count(*) AS DOUBLE) / 5, 6) AS possession_duration_seconds FROM x_g GROUP BY match_id, g HAVING count(*) >= 3""",
)
def possession_segment(spark, sf_dir):
    scope, _ = signal_scope(spark, sf_dir, minimum_possession_seconds=0.6)
    return possession.possession_segment(scope).select("match_id", "anchor_frame_id", "end_frame_id", _r("possession_duration_seconds"))


_TRANSITION = """x_w AS (SELECT *, lag(role) OVER w AS pr, sum(CASE WHEN role = '{a}' AND alive THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS held FROM st WINDOW w AS (PARTITION BY match_id ORDER BY idx))
SELECT match_id, frame_id AS anchor_frame_id, CASE WHEN NOT alive THEN 'UNKNOWN' WHEN held < 2 THEN 'UNKNOWN' ELSE 'PASS' END AS transition_status FROM x_w WHERE pr = '{a}' AND role = '{b}'"""


def _transition(kind):
    def run(spark, sf_dir):
        scope, _ = signal_scope(spark, sf_dir)
        return possession.transition_anchor(scope, kind, 0.4).select("match_id", "anchor_frame_id", "transition_status")

    return run


query("transition_regain", "sig st", _TRANSITION.replace("{a}", "away").replace("{b}", "home"))(_transition("regain"))
query("transition_loss", "sig st", _TRANSITION.replace("{a}", "home").replace("{b}", "away"))(_transition("loss"))


@query(
    "transition_zone", "sig st",
    """x_w AS (SELECT *, lag(role) OVER w AS pr, sum(CASE WHEN role = 'away' AND alive THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS held FROM st WINDOW w AS (PARTITION BY match_id ORDER BY idx))
SELECT match_id, frame_id AS anchor_frame_id, CASE WHEN NOT alive OR held < 2 THEN 'UNKNOWN' WHEN ball_x IS NULL OR abs(ball_x - 17.5) <= 0.5 THEN 'UNKNOWN' WHEN ball_x > 17.5 THEN 'PASS' ELSE 'FAIL' END AS transition_status FROM x_w WHERE pr = 'away' AND role = 'home'""",
)
def transition_zone(spark, sf_dir):
    scope, _ = signal_scope(spark, sf_dir)
    return possession.transition_anchor(scope, "regain", 0.4, "final_third").select("match_id", "anchor_frame_id", "transition_status")


_OUTCOME = """x_a AS (SELECT match_id, idx AS i, frame_id AS anchor_frame_id FROM (SELECT *, lag(role) OVER (PARTITION BY match_id ORDER BY idx) AS pr FROM st) t WHERE pr = 'away' AND role = 'home'),
x_s AS (SELECT a.match_id, a.anchor_frame_id, s.idx - a.i AS pos, s.* EXCLUDE (match_id) FROM x_a a JOIN st s ON s.match_id = a.match_id AND s.idx BETWEEN a.i AND a.i + 5),
x_run AS (SELECT match_id, anchor_frame_id, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY match_id, anchor_frame_id ORDER BY pos) AS g FROM x_s WHERE has) t GROUP BY match_id, anchor_frame_id, g),
x_b AS (SELECT match_id, anchor_frame_id, count(*) AS n, max(CASE WHEN alive AND role <> 'home' THEN 1 ELSE 0 END) AS lost, max(CASE WHEN NOT alive THEN 1 ELSE 0 END) AS dead FROM x_s GROUP BY match_id, anchor_frame_id),
x_m AS (SELECT match_id, anchor_frame_id, max(n) AS best FROM x_run GROUP BY match_id, anchor_frame_id)
SELECT b.match_id, b.anchor_frame_id, CASE WHEN b.n < 3 THEN 'UNKNOWN' WHEN coalesce(best, 0) >= 3 THEN 'PASS' WHEN lost = 1 THEN 'FAIL' WHEN dead = 1 THEN 'FAIL' WHEN b.n < 6 THEN 'UNKNOWN' ELSE 'FAIL' END AS outcome_window_status FROM x_b b LEFT JOIN x_m m USING (match_id, anchor_frame_id)"""


@query("outcome_window_settled", "sig st", _OUTCOME)
def outcome_window_settled(spark, sf_dir):
    scope, _ = signal_scope(spark, sf_dir)
    a = possession.transition_anchor(scope, "regain", 0.0).drop("transition_status")
    return possession.outcome_window(scope, a, 1.0, 0.6, "none").select("match_id", "anchor_frame_id", "outcome_window_status")


@query("ball_lateral_fraction", "sig st", "SELECT match_id, frame_id, round(abs(ball_y) / 34, 6) AS fraction, CAST(sign(ball_y) AS INTEGER) AS ball_side FROM st")
def ball_lateral_fraction(spark, sf_dir):
    scope, _ = signal_scope(spark, sf_dir)
    return possession.ball_lateral_fraction(scope).select("match_id", "frame_id", _r("fraction"), "ball_side")


@query("defensive_outfield_centroid", "trk outfield", "SELECT match_id, frame_id, round(avg(y_m), 6) AS centroid_y, count(*) AS n_players FROM outfield WHERE team_role = 'away' GROUP BY match_id, frame_id")
def defensive_outfield_centroid(spark, sf_dir):
    scope, _ = tracking_scope(spark, sf_dir)
    return possession.defensive_outfield_centroid(scope).select("match_id", "frame_id", _r("centroid_y"), "n_players")


def _compared(op, value):
    def run(spark, sf_dir):
        _, sig = signal_scope(spark, sf_dir)
        return predicates.threshold(sig, op, "measure", value).select("match_id", "frame_id", "predicate_status")

    return run


for _op, _sym in (("gt", ">"), ("gte", ">="), ("lte", "<=")):
    query(f"threshold_{_op}", "sig", f"SELECT match_id, frame_id, CASE WHEN measure IS NULL THEN 'UNKNOWN' WHEN measure {_sym} 45.24 THEN 'PASS' ELSE 'FAIL' END AS predicate_status FROM sig")(_compared(_op, 45.24))


def _enum(op):
    def run(spark, sf_dir):
        _, sig = signal_scope(spark, sf_dir)
        e = sig.withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("UNKNOWN"))
        return predicates.threshold(e, op, "kind", "click").select("match_id", "frame_id", "predicate_status")

    return run


for _op, _sym in (("eq", "="), ("neq", "<>")):
    query(f"enum_{_op}", "sig", f"SELECT match_id, frame_id, CASE WHEN event_type = 'error' THEN 'UNKNOWN' WHEN event_type {_sym} 'click' THEN 'PASS' ELSE 'FAIL' END AS predicate_status FROM sig")(_enum(_op))


@query(
    "persists_for_measure", "sig st",
    """x_v AS (SELECT *, measure >= 20 AS v FROM st),
x_w AS (SELECT *, count(*) OVER w AS c, sum(CASE WHEN v THEN 1 ELSE 0 END) OVER w AS t, sum(CASE WHEN NOT v THEN 1 ELSE 0 END) OVER w AS f FROM x_v WINDOW w AS (PARTITION BY match_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
x_s AS (SELECT *, coalesce(max(CASE WHEN c < 3 THEN NULL WHEN t = 3 THEN 2 WHEN f = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS s FROM x_w),
x_g AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY idx) - row_number() OVER (PARTITION BY match_id, s ORDER BY idx) AS g FROM x_s)
SELECT match_id, min(frame_id) AS start_frame_id, max(frame_id) AS end_frame_id, count(*) AS n_frames, CASE s WHEN 2 THEN 'PASS' WHEN 1 THEN 'UNKNOWN' ELSE 'FAIL' END AS predicate_status FROM x_g GROUP BY match_id, s, g""",
)
def persists_for_measure(spark, sf_dir):
    _, sig = signal_scope(spark, sf_dir)
    truth = predicates.compare("gte", F.col("measure"), 20.0)
    return predicates.persists_for(sig, truth, 0.6, "second", 5, order="frame_id").select("match_id", "start_frame_id", "end_frame_id", "n_frames", "predicate_status")


@query(
    "hysteresis_episodes", "sig st",
    """x_h AS (SELECT *, lag(idx) OVER (PARTITION BY match_id ORDER BY idx) AS p FROM st WHERE measure >= 30),
x_g AS (SELECT *, sum(CASE WHEN p IS NULL OR idx - p - 1 >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY idx) AS g FROM x_h),
x_r AS (SELECT *, idx - row_number() OVER (PARTITION BY match_id, g ORDER BY idx) AS r FROM x_g),
x_p AS (SELECT *, row_number() OVER (PARTITION BY match_id, g, r ORDER BY idx) AS k FROM x_r),
x_o AS (SELECT *, min(CASE WHEN k = 2 THEN idx END) OVER (PARTITION BY match_id, g) AS o FROM x_p)
SELECT match_id, min(frame_id) AS start_frame_id, max(frame_id) AS end_frame_id, count(*) AS passes FROM x_o WHERE o IS NOT NULL AND idx >= o - 1 GROUP BY match_id, g HAVING count(*) >= 2""",
)
def hysteresis_episodes(spark, sf_dir):
    _, sig = signal_scope(spark, sf_dir)
    return hysteresis(sig, F.col("measure") >= 30, 2, 2, ["match_id"], order="frame_id").select("match_id", "start_frame_id", "end_frame_id", "passes")


@query(
    "active_intervals", "trk",
    """x_d AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY match_id, team_role, player_id ORDER BY frame_id) <= 2 THEN 0 ELSE 1 END AS s FROM trk),
x_g AS (SELECT *, sum(s) OVER (PARTITION BY match_id, team_role, player_id ORDER BY frame_id) AS g FROM x_d)
SELECT match_id, team_role, player_id, min(frame_id) AS start_frame_id, max(frame_id) AS end_frame_id, count(*) AS n_frames FROM x_g GROUP BY match_id, team_role, player_id, g""",
)
def active_intervals(spark, sf_dir):
    scope, _ = tracking_scope(spark, sf_dir)
    return relations.active_intervals(scope).select("match_id", "team_role", "player_id", "start_frame_id", "end_frame_id", "n_frames")


@query("greedy_dedupe", "sig", """SELECT match_id, CAST(frame_id AS BIGINT) AS entry_frame_id FROM (
WITH RECURSIVE r AS (SELECT match_id, min(frame_id) AS frame_id FROM sig WHERE event_type = 'purchase' GROUP BY match_id UNION ALL
SELECT n.match_id, n.f FROM (SELECT r.match_id, (SELECT min(s.frame_id) FROM sig s WHERE s.match_id = r.match_id AND s.event_type = 'purchase' AND s.frame_id - r.frame_id >= 8) AS f FROM r) n WHERE n.f IS NOT NULL) SELECT * FROM r) t""")  # fmt: skip
def greedy_dedupe(spark, sf_dir):
    _, sig = signal_scope(spark, sf_dir)
    return spaced_rows(sig.where("event_type = 'purchase'"), ["match_id"], "frame_id", 8).withColumnRenamed("frame_id", "entry_frame_id")


@query(
    "action_chain", "sig",
    """x_n AS (SELECT *, lead(role) OVER (PARTITION BY match_id ORDER BY epoch(ts), event_id) AS nr, lead(epoch(ts)) OVER (PARTITION BY match_id ORDER BY epoch(ts), event_id) - epoch(ts) AS gap FROM sig WHERE alive)
SELECT match_id, frame_id AS anchor_frame_id, CASE WHEN gap <= 7200 THEN 'PASS' ELSE 'FAIL' END AS action_chain_status FROM x_n WHERE nr = role AND gap >= 0""",
)
def action_chain(spark, sf_dir):
    from ..operators.actions import action_chain as chain

    scope, sig = signal_scope(spark, sf_dir)
    a = sig.where("alive").select("match_id", "period", F.concat_ws(":", "match_id", "frame_id").alias("anchor_id"), F.col("frame_id").alias("anchor_frame_id"), F.col("role").alias("team_role"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("gameclock_seconds"), F.col("event_id").alias("event_row_index"))
    return chain(scope, a, 7200.0).select("match_id", "start_frame_id", "action_chain_status").withColumnRenamed("start_frame_id", "anchor_frame_id")


# Predicates over relations, rules and policies


def _evaluations(sig):
    """An evaluation for each click: how many of the next three events are views; UNKNOWN if one of them is an error."""
    w = Window.partitionBy("match_id").orderBy("frame_id").rowsBetween(1, 3)
    e = sig.withColumns({"relation_count": F.count_if(F.col("event_type") == "view").over(w), "_bad": F.count_if(~F.col("alive")).over(w)}).where("event_type = 'click'")
    s = F.when(F.col("_bad") > 0, "UNKNOWN").when(F.col("relation_count") > 0, "PASS").otherwise("FAIL")
    return e.select("match_id", "period", F.concat_ws(":", "match_id", "frame_id").alias("anchor_id"), F.col("frame_id").alias("anchor_frame_id"), s.alias("evaluation_status"), "relation_count")


def _click_or_signup(sig):
    return sig.where("event_type in ('click', 'signup')").select("match_id", "period", F.concat_ws(":", "match_id", "frame_id").alias("anchor_id"), F.col("frame_id").alias("anchor_frame_id"))


_EVAL = """x_e AS (SELECT match_id, frame_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS c, sum(CASE WHEN NOT alive THEN 1 ELSE 0 END) OVER w AS bad FROM sig WINDOW w AS (PARTITION BY match_id ORDER BY frame_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
x_s AS (SELECT match_id, frame_id, event_type, coalesce(c, 0) AS c, CASE WHEN event_type = 'signup' OR bad > 0 THEN 'UNKNOWN' WHEN c > 0 THEN 'PASS' ELSE 'FAIL' END AS s FROM x_e WHERE event_type IN ('click', 'signup'))
"""


@query("exists_tristate", "sig", _EVAL + "SELECT match_id, frame_id AS anchor_frame_id, s AS predicate_status FROM x_s")
def exists_tristate(spark, sf_dir):
    _, sig = signal_scope(spark, sf_dir)
    return predicates.exists(_click_or_signup(sig), _evaluations(sig)).select("match_id", "anchor_frame_id", "predicate_status")


@query("count_at_least", "sig", _EVAL + "SELECT match_id, frame_id AS anchor_frame_id, CASE WHEN s = 'UNKNOWN' THEN s WHEN c >= 2 THEN 'PASS' ELSE 'FAIL' END AS predicate_status FROM x_s")
def count_at_least(spark, sf_dir):
    _, sig = signal_scope(spark, sf_dir)
    return predicates.count_at_least(_click_or_signup(sig), _evaluations(sig), 2).select("match_id", "anchor_frame_id", "predicate_status")


_RULES = [("SOME", ["any"]), ("MANY", ["any", "two"]), ("NONE", ["none"])]


def _rule_traces(sig):
    a, ev = _click_or_signup(sig), _evaluations(sig)
    any_ = predicates.exists(a, ev)
    none = any_.withColumn("predicate_status", F.when(F.col("predicate_status") == "PASS", "FAIL").when(F.col("predicate_status") == "FAIL", "PASS").otherwise(F.col("predicate_status")))
    return emission.trace(a, "any", any_).unionByName(emission.trace(a, "two", predicates.count_at_least(a, ev, 2))).unionByName(emission.trace(a, "none", none))


def _classified(policy):
    def run(spark, sf_dir):
        _, sig = signal_scope(spark, sf_dir)
        return emission.classify(_click_or_signup(sig), _rule_traces(sig), _RULES, policy).select("match_id", "anchor_frame_id", "classification", "has_unknown_evidence")

    return run


_LABEL = "CASE WHEN s <> 'UNKNOWN' AND c >= 2 THEN 'MANY' WHEN s = 'PASS' THEN 'SOME' WHEN s = 'FAIL' THEN 'NONE'"
query("unknown_policy_exclude", "sig", _EVAL + f"SELECT match_id, frame_id AS anchor_frame_id, {_LABEL} END AS classification, FALSE AS has_unknown_evidence FROM x_s WHERE s <> 'UNKNOWN'")(_classified("exclude_candidate"))
query("unknown_policy_warn", "sig", _EVAL + f"SELECT match_id, frame_id AS anchor_frame_id, {_LABEL} ELSE 'MANY' END AS classification, s = 'UNKNOWN' AS has_unknown_evidence FROM x_s")(_classified("include_with_warning"))


@query(
    "rule_emission", "sig",
    _EVAL + f""", x_l AS (SELECT match_id, frame_id, {_LABEL} END AS classification FROM x_s WHERE s <> 'UNKNOWN')
SELECT match_id, frame_id AS anchor_frame_id, classification FROM x_l ORDER BY match_id, frame_id, classification LIMIT 200""",
)
def rule_emission(spark, sf_dir):
    r = _classified("exclude_candidate")(spark, sf_dir)
    r = r.withColumns({"period": F.lit("firstHalf"), "anchor_id": F.concat_ws(":", "match_id", "anchor_frame_id")})
    return emission.ordered(r, None, "plan", 200).select("match_id", "anchor_frame_id", "classification")


@query("proof_selection", "sig", _EVAL + f""", x_l AS (SELECT match_id, frame_id, CASE WHEN s = 'PASS' THEN 'SWITCHED' WHEN frame_id % 3 = 0 THEN 'STOPPAGE' WHEN frame_id % 3 = 1 THEN 'RETAINED_NO_SWITCH' ELSE 'LOST_BEFORE_SWITCH' END AS classification FROM x_s WHERE s <> 'UNKNOWN'),
x_p AS (SELECT match_id, frame_id, 0 AS p FROM (SELECT * FROM x_l WHERE classification = 'SWITCHED' ORDER BY match_id, frame_id LIMIT 2) UNION ALL
SELECT match_id, frame_id, 1 FROM (SELECT * FROM x_l WHERE classification IN ('RETAINED_NO_SWITCH', 'LOST_BEFORE_SWITCH') ORDER BY match_id, frame_id LIMIT 2)),
x_n AS (SELECT l.*, coalesce(p, 2) AS p FROM x_l l LEFT JOIN x_p USING (match_id, frame_id)),
x_k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p, frame_id) AS k FROM x_n)
SELECT match_id, frame_id AS anchor_frame_id, classification FROM x_k WHERE k <= 5 ORDER BY p, match_id, frame_id LIMIT 16""")  # fmt: skip
def proof_selection(spark, sf_dir):
    r = _classified("exclude_candidate")(spark, sf_dir)
    other = F.element_at(F.array(*map(F.lit, ("STOPPAGE", "RETAINED_NO_SWITCH", "LOST_BEFORE_SWITCH"))), (F.col("anchor_frame_id") % 3 + 1).cast("int"))
    r = r.withColumns({"period": F.lit("firstHalf"), "anchor_id": F.concat_ws(":", "match_id", "anchor_frame_id"), "classification": F.when(F.col("classification") == "NONE", other).otherwise("SWITCHED")})
    return emission.proof_selection(r).select("match_id", "anchor_frame_id", "classification")


# Geometry at a frame



@query(
    "pairwise_distance", "trk ball anc",
    """x_d AS (SELECT a.*, sqrt((t.x_m - b.ball_x) * (t.x_m - b.ball_x) + (t.y_m - b.ball_y) * (t.y_m - b.ball_y)) AS d FROM anc a LEFT JOIN trk t ON t.match_id = a.match_id AND t.frame_id = a.anchor_frame_id AND t.player_id = a.receiver_id LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id)
SELECT anchor_frame_id, round(d, 6) AS distance_m, CASE WHEN d IS NULL THEN 'UNKNOWN' WHEN d <= 30 THEN 'PASS' ELSE 'FAIL' END AS pairwise_distance_status FROM x_d""",
)
def pairwise_distance(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return geometry.pairwise_distance(scope, a, maximum_distance_m=30.0).select("anchor_frame_id", _r("distance_m"), "pairwise_distance_status")


@query(
    "tracking_quality", "trk ball anc",
    """x_m AS (SELECT a.anchor_frame_id, a.match_id, (SELECT count(DISTINCT t.player_id) FROM trk t WHERE t.match_id = a.match_id AND t.frame_id = a.anchor_frame_id AND t.player_id IN (a.passer_id, a.receiver_id)) AS have, b.ball_x IS NOT NULL AS ball FROM anc a LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id)
SELECT anchor_frame_id, CASE WHEN ball AND have = 2 THEN 'PASS' ELSE 'UNKNOWN' END AS tracking_quality_status FROM x_m""",
)
def tracking_quality(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return geometry.tracking_quality(scope, a).select("anchor_frame_id", "tracking_quality_status")


@query(
    "marking", "trk outfield anc",
    """x_t AS (SELECT a.match_id, a.anchor_frame_id, a.receiver_id, t.x_m, t.y_m, t.team_role FROM anc a LEFT JOIN trk t ON t.match_id = a.match_id AND t.frame_id = a.anchor_frame_id AND t.player_id = a.receiver_id),
x_c AS (SELECT t.match_id, t.anchor_frame_id, o.player_id, sqrt((o.x_m - t.x_m) * (o.x_m - t.x_m) + (o.y_m - t.y_m) * (o.y_m - t.y_m)) AS d FROM x_t t JOIN outfield o ON o.match_id = t.match_id AND o.frame_id = t.anchor_frame_id AND o.team_role <> t.team_role AND o.player_id <> t.receiver_id),
x_b AS (SELECT match_id, anchor_frame_id, count(*) AS n, min(d) AS d FROM x_c GROUP BY match_id, anchor_frame_id),
x_i AS (SELECT c.match_id, c.anchor_frame_id, min(c.player_id) AS pid FROM x_c c JOIN x_b b USING (match_id, anchor_frame_id) WHERE c.d = b.d GROUP BY c.match_id, c.anchor_frame_id),
x_s AS (SELECT t.anchor_frame_id, coalesce(n, 0) AS n, b.d, i.pid, CASE WHEN t.x_m IS NULL OR coalesce(n, 0) < 2 THEN 'UNKNOWN' WHEN b.d <= 25 THEN 'PASS' ELSE 'FAIL' END AS s FROM x_t t LEFT JOIN x_b b USING (match_id, anchor_frame_id) LEFT JOIN x_i i USING (match_id, anchor_frame_id))
SELECT anchor_frame_id, pid AS nearest_marker_id, round(d, 6) AS nearest_marker_distance_m, s AS marking_status, CASE s WHEN 'PASS' THEN 'FAIL' WHEN 'FAIL' THEN 'PASS' ELSE s END AS unmarked_status FROM x_s""",
)
def marking(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return geometry.marking(scope, a, maximum_marking_distance_m=25.0, minimum_observed_marker_candidates=2).select("anchor_frame_id", "nearest_marker_id", _r("nearest_marker_distance_m"), "marking_status", "unmarked_status")


@query(
    "cover_shadow", "trk outfield ball anc",
    """x_t AS (SELECT a.match_id, a.anchor_frame_id, t.x_m, t.y_m, t.team_role, b.ball_x AS bx, b.ball_y AS bz FROM anc a LEFT JOIN trk t ON t.match_id = a.match_id AND t.frame_id = a.anchor_frame_id AND t.player_id = a.receiver_id LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id),
x_p AS (SELECT t.*, o.player_id, o.x_m AS ox, o.y_m AS oy, ((o.x_m - bx) * (t.x_m - bx) + (o.y_m - bz) * (t.y_m - bz)) / nullif((t.x_m - bx) * (t.x_m - bx) + (t.y_m - bz) * (t.y_m - bz), 0) AS f FROM x_t t JOIN outfield o ON o.match_id = t.match_id AND o.frame_id = t.anchor_frame_id AND o.team_role <> t.team_role),
x_q AS (SELECT *, sqrt((ox - (bx + f * (x_m - bx))) * (ox - (bx + f * (x_m - bx))) + (oy - (bz + f * (y_m - bz))) * (oy - (bz + f * (y_m - bz)))) AS d FROM x_p),
x_g AS (SELECT match_id, anchor_frame_id, count(*) AS n, max(CASE WHEN f >= 0.05 AND f <= 0.95 AND d <= 10 THEN 1 ELSE 0 END) AS hit FROM x_q GROUP BY match_id, anchor_frame_id)
SELECT t.anchor_frame_id, CASE WHEN bx IS NULL OR x_m IS NULL THEN 'UNKNOWN' WHEN sqrt((x_m - bx) * (x_m - bx) + (y_m - bz) * (y_m - bz)) < 5 THEN 'UNKNOWN' WHEN coalesce(n, 0) < 2 THEN 'UNKNOWN' WHEN hit = 1 THEN 'PASS' ELSE 'FAIL' END AS cover_shadow_status, coalesce(n, 0) AS observed_defender_count FROM x_t t LEFT JOIN x_g g USING (match_id, anchor_frame_id)""",
)
def cover_shadow(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return geometry.cover_shadow(scope, a, maximum_lane_distance_m=10.0, minimum_observed_defenders=2).select("anchor_frame_id", "cover_shadow_status", "observed_defender_count")


@query(
    "structured_zone", "ball anc sgn",
    """x_n AS (SELECT a.anchor_frame_id, b.ball_x * s.sign AS nx FROM anc a JOIN sgn s USING (team_role) LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id)
SELECT anchor_frame_id, CASE WHEN nx IS NULL THEN 'UNKNOWN' WHEN abs(nx - 17.5) <= 0.5 OR abs(nx + 17.5) <= 0.5 THEN 'UNKNOWN' WHEN nx > -17.5 AND nx < 17.5 THEN 'PASS' ELSE 'FAIL' END AS zone_status FROM x_n""",
)
def structured_zone(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return possession.structured_zone(scope, a, zone_name="middle_third").select("anchor_frame_id", "zone_status")


@query(
    "team_compactness", "trk outfield anc",
    """x_g AS (SELECT match_id, frame_id, count(*) AS n, max(y_m) - min(y_m) AS w, max(x_m) - min(x_m) AS d FROM outfield WHERE team_role = 'away' GROUP BY match_id, frame_id)
SELECT a.anchor_frame_id, CAST(coalesce(n, 0) AS INTEGER) AS observed_player_count, round(w, 6) AS team_width_m, round(d, 6) AS team_depth_m, CASE WHEN coalesce(n, 0) < 2 THEN 'UNKNOWN' WHEN w > 30 THEN 'FAIL' WHEN d > 40 THEN 'FAIL' ELSE 'PASS' END AS team_compactness_status FROM anc a LEFT JOIN x_g g ON g.match_id = a.match_id AND g.frame_id = a.anchor_frame_id""",
)
def team_compactness(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return geometry.team_compactness(scope, a, maximum_team_width_m=30.0, maximum_team_depth_m=40.0, minimum_observed_players=2).select("anchor_frame_id", "observed_player_count", _r("team_width_m"), _r("team_depth_m"), "team_compactness_status")


_LANE = "CASE WHEN y_m < -34 OR y_m > 34 THEN NULL ELSE least(CAST(floor((y_m + 34) / 13.6) AS INTEGER), 4) END"


def _lanes(raw):
    def run(spark, sf_dir):
        scope, a = tracking_scope(spark, sf_dir, raw=raw)
        return geometry.lane_occupancy(scope, a, required_occupied_lane_count=2).select("anchor_frame_id", F.col("occupied_lane_count").cast("long").alias("occupied_lane_count"), "lane_occupancy_status")

    return run


for _name, _src in (("lane_occupancy", "trk"), ("lane_occupancy_duplicates", "trk_raw")):
    query(
        _name, f"{_src} anc",
        f"""x_l AS (SELECT *, {_LANE} AS lane FROM {_src} WHERE player_id <> 'p7' AND team_role = 'home'),
x_g AS (SELECT match_id, frame_id, count(*) AS n, count(DISTINCT player_id) AS ids, count(DISTINCT lane) AS lanes, sum(CASE WHEN lane IS NULL THEN 1 ELSE 0 END) AS outside FROM x_l GROUP BY match_id, frame_id)
SELECT a.anchor_frame_id, coalesce(lanes, 0) AS occupied_lane_count, CASE WHEN n IS NULL OR ids < n OR outside > 0 THEN 'UNKNOWN' WHEN lanes < 2 THEN 'FAIL' ELSE 'PASS' END AS lane_occupancy_status FROM anc a LEFT JOIN x_g g ON g.match_id = a.match_id AND g.frame_id = a.anchor_frame_id""",
    )(_lanes(_src == "trk_raw"))


def _local(raw):
    def run(spark, sf_dir):
        scope, a = tracking_scope(spark, sf_dir, raw=raw)
        return geometry.local_number_relation(scope, a, "anchor_frame_id", radius_m=25.0).select("anchor_frame_id", "perspective_count", "defending_count", "local_number_status")

    return run


for _name, _src in (("local_number", "trk"), ("local_number_duplicates", "trk_raw")):
    query(
        _name, f"{_src} ball anc",
        f"""x_j AS (SELECT a.anchor_frame_id, a.match_id, b.ball_x AS bx, o.team_role AS r, o.player_id AS p, sqrt((o.x_m - b.ball_x) * (o.x_m - b.ball_x) + (o.y_m - b.ball_y) * (o.y_m - b.ball_y)) <= 25 AS near FROM anc a LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id LEFT JOIN {_src} o ON o.match_id = a.match_id AND o.frame_id = a.anchor_frame_id AND o.player_id <> 'p7'),
x_g AS (SELECT anchor_frame_id, max(bx) AS bx, count(p) AS n, count(DISTINCT p) AS ids, sum(CASE WHEN r = 'home' THEN 1 ELSE 0 END) AS own, sum(CASE WHEN r = 'away' THEN 1 ELSE 0 END) AS opp, sum(CASE WHEN r = 'home' AND near THEN 1 ELSE 0 END) AS c, sum(CASE WHEN r = 'away' AND near THEN 1 ELSE 0 END) AS d FROM x_j GROUP BY anchor_frame_id)
SELECT anchor_frame_id, CASE WHEN n > 0 THEN CAST(c AS INTEGER) END AS perspective_count, CASE WHEN n > 0 THEN CAST(d AS INTEGER) END AS defending_count, CASE WHEN bx IS NULL OR own = 0 OR opp = 0 OR ids < n THEN 'UNKNOWN' WHEN c - d >= 1 THEN 'PASS' ELSE 'FAIL' END AS local_number_status FROM x_g""",
    )(_local(_src == "trk_raw"))


@query(
    "time_to_arrival", "trk anc",
    """x_t AS (SELECT a.match_id, a.anchor_frame_id, a.receiver_id, t.x_m, t.y_m FROM anc a LEFT JOIN trk t ON t.match_id = a.match_id AND t.frame_id = a.anchor_frame_id AND t.player_id = a.receiver_id),
x_c AS (SELECT t.match_id, t.anchor_frame_id, min(sqrt((o.x_m - t.x_m) * (o.x_m - t.x_m) + (o.y_m - t.y_m) * (o.y_m - t.y_m)) / 7) AS s, count(*) AS n FROM x_t t JOIN trk o ON o.match_id = t.match_id AND o.frame_id = t.anchor_frame_id AND o.team_role = 'away' AND o.player_id <> t.receiver_id GROUP BY t.match_id, t.anchor_frame_id)
SELECT t.anchor_frame_id, round(s, 6) AS minimum_arrival_seconds, CASE WHEN x_m IS NULL OR coalesce(n, 0) < 1 THEN 'UNKNOWN' WHEN s <= 4 THEN 'PASS' ELSE 'FAIL' END AS time_to_arrival_status FROM x_t t LEFT JOIN x_c c USING (match_id, anchor_frame_id)""",
)
def time_to_arrival(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return geometry.time_to_arrival(scope, a, maximum_arrival_seconds=4.0).select("anchor_frame_id", _r("minimum_arrival_seconds"), "time_to_arrival_status")


_AT = "LEFT JOIN trk {n} ON {n}.match_id = a.match_id AND {n}.frame_id = a.anchor_frame_id - {k} AND {n}.player_id = a.receiver_id"


@query(
    "velocity", "trk anc",
    f"""x_v AS (SELECT a.anchor_frame_id, sqrt((p.x_m - q.x_m) * (p.x_m - q.x_m) + (p.y_m - q.y_m) * (p.y_m - q.y_m)) / 0.4 AS v FROM anc a {_AT.format(n="p", k=0)} {_AT.format(n="q", k=10)})
SELECT anchor_frame_id, round(v, 6) AS speed_mps, CASE WHEN v IS NULL THEN 'UNKNOWN' ELSE 'PASS' END AS velocity_status FROM x_v""",
)
def velocity(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return geometry.velocity(scope, a).select("anchor_frame_id", _r("speed_mps"), "velocity_status")


@query(
    "acceleration", "trk anc",
    f"""x_v AS (SELECT a.anchor_frame_id, round(sqrt((p.x_m - q.x_m) * (p.x_m - q.x_m) + (p.y_m - q.y_m) * (p.y_m - q.y_m)) / 0.04, 3) AS c, round(sqrt((q.x_m - r.x_m) * (q.x_m - r.x_m) + (q.y_m - r.y_m) * (q.y_m - r.y_m)) / 0.04, 3) AS b FROM anc a {_AT.format(n="p", k=0)} {_AT.format(n="q", k=1)} {_AT.format(n="r", k=2)}),
x_s AS (SELECT anchor_frame_id, c - b AS d, CASE WHEN c - b IS NULL OR greatest(c, b) > 2000 OR abs((c - b) / 0.04) > 40000 THEN 'UNKNOWN' WHEN abs(c - b) < 100 THEN 'FAIL' WHEN c > b THEN 'PASS' ELSE 'DOWN' END AS s FROM x_v)
SELECT anchor_frame_id, round(d, 3) AS delta_speed_mps, CASE s WHEN 'DOWN' THEN 'FAIL' ELSE s END AS acceleration_status, CASE s WHEN 'DOWN' THEN 'PASS' WHEN 'PASS' THEN 'FAIL' ELSE s END AS deceleration_status FROM x_s""",
)
def acceleration(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    out = geometry.acceleration(scope, a, lookback_seconds=0.04, minimum_abs_delta_speed_mps=100.0, maximum_player_speed_mps=2000.0, maximum_abs_acceleration_mps2=40000.0)
    return out.select("anchor_frame_id", _r("delta_speed_mps", 3), "acceleration_status", "deceleration_status")


_RUN = """x_b AS (SELECT a.match_id, a.anchor_frame_id AS f, a.anchor_frame_id + 5 AS g, a.team_role, a.passer_id, s.sign, b0.ball_x AS bx0, b0.ball_y AS by0, b1.ball_x AS bx1, b1.ball_y AS by1, l.last_frame_id FROM anc a JOIN sgn s USING (team_role) JOIN lastf l USING (match_id) LEFT JOIN ball b0 ON b0.match_id = a.match_id AND b0.frame_id = a.anchor_frame_id LEFT JOIN ball b1 ON b1.match_id = a.match_id AND b1.frame_id = a.anchor_frame_id + 5),
x_e AS (SELECT b.match_id, b.f, o.player_id, o.x_m AS x0, o.y_m AS y0, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1 FROM x_b b JOIN outfield o ON o.match_id = b.match_id AND o.frame_id = b.f AND o.team_role = b.team_role AND o.player_id <> b.passer_id
  UNION ALL SELECT b.match_id, b.f, o.player_id, NULL, NULL, o.x_m, o.y_m FROM x_b b JOIN outfield o ON o.match_id = b.match_id AND o.frame_id = b.g AND o.team_role = b.team_role AND o.player_id <> b.passer_id),
x_p AS (SELECT match_id, f, player_id, max(x0) AS x0, max(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM x_e GROUP BY match_id, f, player_id),
x_c AS (SELECT p.*, b.sign, sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) AS disp, sqrt((x0 - bx0) * (x0 - bx0) + (y0 - by0) * (y0 - by0)) AS d0, sqrt((x1 - bx1) * (x1 - bx1) + (y1 - by1) * (y1 - by1)) AS d1 FROM x_p p JOIN x_b b USING (match_id, f)),
x_k AS (SELECT *, CASE WHEN least(d0, d1) < 5 THEN 'FAIL' WHEN disp < 20 THEN 'FAIL' WHEN disp / 0.2 < 3 THEN 'FAIL' ELSE 'PASS' END AS s FROM x_c),
x_r AS (SELECT *, row_number() OVER (PARTITION BY match_id, f ORDER BY CASE s WHEN 'PASS' THEN 0 ELSE 1 END, disp DESC, player_id) AS k FROM x_k WHERE disp IS NOT NULL),
x_n AS (SELECT match_id, f, count(*) AS e, sum(CASE WHEN disp IS NOT NULL THEN 1 ELSE 0 END) AS o FROM x_c GROUP BY match_id, f),
x_s AS (SELECT b.*, r.player_id, r.disp, r.x0, r.y0, r.x1, r.y1, coalesce(e, 0) AS e, coalesce(o, 0) AS o, CASE WHEN g > last_frame_id OR bx0 IS NULL OR bx1 IS NULL OR coalesce(e, 0) = 0 OR coalesce(o, 0) < 1 OR 1 - CAST(o AS DOUBLE) / e > 0.7 THEN 'UNKNOWN' WHEN r.s = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS st FROM x_b b LEFT JOIN x_n n USING (match_id, f) LEFT JOIN (SELECT * FROM x_r WHERE k = 1) r USING (match_id, f))
"""


def _runs(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    a = a.drop("entity_refs")
    return scope, geometry.off_ball_run(scope, a, lookahead_seconds=0.2, minimum_run_displacement_m=20.0, minimum_observed_candidates=1, maximum_missing_candidate_ratio=0.7)


@query("off_ball_run", "trk outfield ball anc sgn frames lastf", _RUN + "SELECT f AS anchor_frame_id, st AS off_ball_run_status, player_id AS run_player_id, round(disp, 6) AS run_displacement_m, CAST(e AS INTEGER) AS expected_candidate_count, CAST(o AS INTEGER) AS observed_candidate_count FROM x_s")
def off_ball_run(spark, sf_dir):
    return _runs(spark, sf_dir)[1].select("anchor_frame_id", "off_ball_run_status", "run_player_id", _r("run_displacement_m"), "expected_candidate_count", "observed_candidate_count")


@query("off_ball_run_type", "trk outfield ball anc sgn frames lastf", _RUN + """, x_l AS (SELECT s.match_id, s.f, max(CASE WHEN o.frame_id = s.f THEN o.x_m * s.sign END) AS l0, max(CASE WHEN o.frame_id = s.g THEN o.x_m * s.sign END) AS l1, sum(CASE WHEN o.frame_id = s.f THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN o.frame_id = s.g THEN 1 ELSE 0 END) AS n1 FROM x_s s LEFT JOIN outfield o ON o.match_id = s.match_id AND o.frame_id IN (s.f, s.g) AND o.team_role <> s.team_role GROUP BY s.match_id, s.f),
x_y AS (SELECT s.*, l0, l1, n0, n1, (x1 - x0) * sign AS fwd, abs(y1 - y0) AS lat FROM x_s s JOIN x_l l USING (match_id, f)),
x_z AS (SELECT *, CASE WHEN st <> 'PASS' THEN st WHEN fwd >= 4 AND lat >= 2 THEN 'PASS' ELSE 'FAIL' END AS dg, CASE WHEN st <> 'PASS' THEN st WHEN least(n0, n1) < 1 THEN 'UNKNOWN' WHEN NOT x0 * sign > l0 AND x1 * sign > l1 AND fwd >= 4 THEN 'PASS' ELSE 'FAIL' END AS bh FROM x_y)
SELECT f AS anchor_frame_id, dg AS diagonal_run_status, bh AS run_in_behind_status, CASE WHEN st <> 'PASS' THEN st WHEN dg = 'PASS' OR bh = 'PASS' THEN 'PASS' WHEN bh = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'FAIL' END AS off_ball_run_type_status FROM x_z""")  # fmt: skip
def off_ball_run_type(spark, sf_dir):
    scope, runs = _runs(spark, sf_dir)
    return geometry.off_ball_run_type(scope, runs, minimum_observed_defenders=1).select("anchor_frame_id", "diagonal_run_status", "run_in_behind_status", "off_ball_run_type_status")


@query(
    "space_region_grid", "trk outfield anc",
    """x_x AS (SELECT CASE WHEN i = 6 THEN 52.5 ELSE -52.5 + i * 20.0 END AS x FROM range(7) t(i)), x_yy AS (SELECT CASE WHEN i = 4 THEN 34.0 ELSE -34.0 + i * 20.0 END AS y FROM range(5) t(i)),
x_p AS (SELECT a.match_id, a.anchor_frame_id, x, y, min(CASE WHEN o.team_role <> a.team_role THEN sqrt((o.x_m - x) * (o.x_m - x) + (o.y_m - y) * (o.y_m - y)) END) AS od, min(CASE WHEN o.team_role = a.team_role THEN sqrt((o.x_m - x) * (o.x_m - x) + (o.y_m - y) * (o.y_m - y)) END) AS td FROM anc a JOIN outfield o ON o.match_id = a.match_id AND o.frame_id = a.anchor_frame_id CROSS JOIN x_x CROSS JOIN x_yy GROUP BY a.match_id, a.anchor_frame_id, x, y),
x_k AS (SELECT match_id, anchor_frame_id, least(count(*), 5) AS k FROM x_p WHERE od >= 20 AND td >= 10 GROUP BY match_id, anchor_frame_id),
x_n AS (SELECT a.match_id, a.anchor_frame_id, sum(CASE WHEN o.team_role = a.team_role THEN 1 ELSE 0 END) AS t, sum(CASE WHEN o.team_role <> a.team_role THEN 1 ELSE 0 END) AS o FROM anc a LEFT JOIN outfield o ON o.match_id = a.match_id AND o.frame_id = a.anchor_frame_id GROUP BY a.match_id, a.anchor_frame_id)
SELECT n.anchor_frame_id, CAST(coalesce(k, 0) AS INTEGER) AS open_space_region_count, CASE WHEN least(coalesce(t, 0), coalesce(o, 0)) < 1 THEN 'UNKNOWN' WHEN coalesce(k, 0) >= 1 THEN 'PASS' ELSE 'FAIL' END AS open_space_status FROM x_n n LEFT JOIN x_k USING (match_id, anchor_frame_id)""",
)
def space_region_grid(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    out = geometry.space_region_generation(scope, a, grid_step_m=20.0, minimum_opponent_distance_m=20.0, minimum_teammate_distance_m=10.0, minimum_observed_players_per_team=1)
    return out.select("anchor_frame_id", "open_space_region_count", "open_space_status")


# Lines

_LINE = """x_d AS (SELECT a.match_id, a.anchor_frame_id, b.ball_x AS bx, o.player_id, o.x_m AS nx FROM anc a LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id LEFT JOIN outfield o ON o.match_id = a.match_id AND o.frame_id = a.anchor_frame_id AND o.team_role = 'away'),
x_o AS (SELECT *, row_number() OVER (PARTITION BY match_id, anchor_frame_id ORDER BY nx, player_id) AS i FROM x_d WHERE nx > bx + 1),
x_w AS (SELECT p.match_id, p.anchor_frame_id, p.i, q.i - p.i + 1 AS c, q.nx - p.nx AS span FROM x_o p JOIN x_o q ON q.match_id = p.match_id AND q.anchor_frame_id = p.anchor_frame_id AND q.i >= p.i + 1 WHERE q.nx - p.nx <= 30 + 1e-9),
x_t AS (SELECT w.*, max(c) OVER (PARTITION BY match_id, anchor_frame_id) AS mc FROM x_w w),
x_u AS (SELECT *, min(span) OVER (PARTITION BY match_id, anchor_frame_id) AS ms FROM x_t WHERE c = mc),
x_win AS (SELECT match_id, anchor_frame_id, count(*) AS wins, min(i) AS i, min(c) AS c, min(span) AS span FROM x_u WHERE span <= ms + 1e-9 GROUP BY match_id, anchor_frame_id),
x_n AS (SELECT match_id, anchor_frame_id, max(bx) AS bx, count(player_id) AS n FROM x_d GROUP BY match_id, anchor_frame_id),
x_m AS (SELECT w.match_id, w.anchor_frame_id, avg(o.nx) AS line FROM x_win w JOIN x_o o ON o.match_id = w.match_id AND o.anchor_frame_id = w.anchor_frame_id AND o.i BETWEEN w.i AND w.i + w.c - 1 WHERE w.wins = 1 GROUP BY w.match_id, w.anchor_frame_id),
x_ls AS (SELECT n.match_id, n.anchor_frame_id, m.line, CASE WHEN bx IS NULL OR n.n < 2 THEN 'UNKNOWN' WHEN wins > 1 THEN 'UNKNOWN' WHEN wins = 1 THEN 'PASS' ELSE 'FAIL' END AS s, w.span FROM x_n n LEFT JOIN x_win w USING (match_id, anchor_frame_id) LEFT JOIN x_m m USING (match_id, anchor_frame_id))
"""


def _line(scope, a):
    return lines.defensive_line_model(scope, a, line_band_width_m=30.0, minimum_line_defenders=2)


@query("defensive_line", "trk outfield ball anc", _LINE + "SELECT anchor_frame_id, s AS line_status, CASE WHEN s = 'PASS' THEN round(line, 6) END AS normalized_line_x_m, CASE WHEN s = 'PASS' THEN round(span, 6) END AS line_compactness_m FROM x_ls")
def defensive_line(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return _line(scope, a).select("anchor_frame_id", "line_status", _r("normalized_line_x_m"), _r("line_compactness_m"))


_POSN = """, x_e AS (SELECT l.*, t.x_m - line AS d, t.x_m IS NULL AS gone FROM x_ls l JOIN anc a USING (match_id, anchor_frame_id) LEFT JOIN trk t ON t.match_id = l.match_id AND t.frame_id = l.anchor_frame_id AND t.player_id = a.receiver_id),
x_rp AS (SELECT *, CASE WHEN s <> 'PASS' OR gone THEN 'UNKNOWN' WHEN d > 0.5 THEN 'AHEAD' WHEN d < -0.5 THEN 'BEHIND' ELSE 'LEVEL' END AS p FROM x_e)
"""


@query("relative_position", "trk outfield ball anc", _LINE + _POSN + "SELECT anchor_frame_id, p AS relative_position_status FROM x_rp")
def relative_position(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return lines.relative_position_to_line(scope, _line(scope, a), a, entity_frame_field="anchor_frame_id").select("anchor_frame_id", "relative_position_status")


@query("line_break", "trk outfield ball anc", _LINE + """, x_q AS (SELECT l.match_id, l.anchor_frame_id, l.s, t.x_m - line AS d0, u.x_m - line AS d1 FROM x_ls l JOIN anc a USING (match_id, anchor_frame_id) LEFT JOIN trk t ON t.match_id = l.match_id AND t.frame_id = l.anchor_frame_id AND t.player_id = a.passer_id LEFT JOIN trk u ON u.match_id = l.match_id AND u.frame_id = l.anchor_frame_id + 5 AND u.player_id = a.receiver_id)
SELECT anchor_frame_id, CASE WHEN s <> 'PASS' THEN s WHEN d0 IS NULL OR d1 IS NULL THEN 'UNKNOWN' WHEN d0 > 0.5 THEN 'FAIL' WHEN d1 > 0.5 THEN 'PASS' ELSE 'FAIL' END AS line_break_status FROM x_q""")  # fmt: skip
def line_break(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    a = a.withColumns({"physical_release_frame_id": F.col("anchor_frame_id"), "controlled_reception_frame_id": F.col("end_frame_id"), "controlled_pass_status": F.lit("PASS")})
    line = _line(scope, a)
    rel = lines.relative_position_to_line(scope, line, a, "passer_id", "physical_release_frame_id")
    rec = lines.relative_position_to_line(scope, line, a, "receiver_id", "controlled_reception_frame_id")
    return lines.controlled_line_break_episode(a, line, rel, rec).select("anchor_frame_id", "line_break_status")


@query("multi_line", "trk outfield ball anc", """x_d AS (SELECT a.match_id, a.anchor_frame_id, b.ball_x AS bx, list(o.x_m ORDER BY o.x_m, o.player_id) FILTER (o.x_m > b.ball_x + 1) AS ds FROM anc a LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id LEFT JOIN outfield o ON o.match_id = a.match_id AND o.frame_id = a.anchor_frame_id AND o.team_role = 'away' GROUP BY a.match_id, a.anchor_frame_id, b.ball_x)
SELECT anchor_frame_id, CASE WHEN bx IS NULL THEN 'UNKNOWN' WHEN len(coalesce(ds, [])) >= 1 THEN 'PASS' ELSE 'FAIL' END AS multi_line_status FROM x_d""")  # fmt: skip
def multi_line(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return lines.multi_line_model(scope, a, line_band_width_m=20.0, minimum_line_defenders=1, target_line_rank=1, anchor_frame_field="anchor_frame_id").select("anchor_frame_id", "multi_line_status")


# Relations

_PRESS = """x_c AS (SELECT a.match_id, a.anchor_frame_id AS f, t.x_m AS cx, t.y_m AS cy, u.x_m AS cx0, u.y_m AS cy0 FROM anc a LEFT JOIN trk t ON t.match_id = a.match_id AND t.frame_id = a.anchor_frame_id AND t.player_id = a.receiver_id LEFT JOIN trk u ON u.match_id = a.match_id AND u.frame_id = a.anchor_frame_id - 1 AND u.player_id = a.receiver_id),
x_j AS (SELECT c.*, o.player_id, o.x_m AS x, o.y_m AS y, q.x_m AS x0, q.y_m AS y0 FROM x_c c JOIN outfield o ON o.match_id = c.match_id AND o.frame_id = c.f AND o.team_role = 'away' LEFT JOIN outfield q ON q.match_id = c.match_id AND q.frame_id = c.f - 1 AND q.player_id = o.player_id AND q.team_role = 'away' WHERE cx IS NOT NULL),
x_k AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d, (sqrt((x0 - cx0) * (x0 - cx0) + (y0 - cy0) * (y0 - cy0)) - sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) / 0.04 AS v,
  CASE WHEN sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) * sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0)) > 0 THEN degrees(acos(greatest(-1.0, least(1.0, ((x - x0) * (cx - x0) + (y - y0) * (cy - y0)) / (sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) * sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0))))))) END AS ang,
  (degrees(atan2(y - cy, x - cx)) + 360.0) % 360.0 AS b FROM x_j)
"""


@query("pressure", "trk outfield anc", _PRESS + """, x_r AS (SELECT *, row_number() OVER (PARTITION BY match_id, f ORDER BY d, player_id) AS k FROM x_k)
SELECT c.f AS anchor_frame_id, r.player_id AS nearest_defender_id, round(r.d, 6) AS nearest_defender_distance_m, CASE WHEN c.cx IS NULL OR r.player_id IS NULL OR r.v IS NULL THEN 'UNKNOWN' WHEN r.d > 40 THEN 'FAIL' WHEN r.v < 0.2 THEN 'FAIL' WHEN r.ang > 100 THEN 'FAIL' WHEN r.ang IS NULL THEN 'UNKNOWN' ELSE 'PASS' END AS pressure_status FROM x_c c LEFT JOIN x_r r ON r.match_id = c.match_id AND r.f = c.f AND r.k = 1""")  # fmt: skip
def pressure(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    out = relations.pressure_on_carrier(scope, a, "anchor_frame_id", maximum_pressure_distance_m=40.0, lookback_seconds=0.04)
    return out.select("anchor_frame_id", "nearest_defender_id", _r("nearest_defender_distance_m"), "pressure_status")


@query("team_press_spread", "trk outfield anc", _PRESS + """, x_q AS (SELECT match_id, f, player_id, b FROM x_k WHERE d <= 80 AND v >= -500 AND ang <= 170),
x_sp AS (SELECT p.match_id, p.f, max(least(abs(p.b - q.b), 360.0 - abs(p.b - q.b))) AS spread FROM x_q p JOIN x_q q ON p.match_id = q.match_id AND p.f = q.f GROUP BY p.match_id, p.f),
x_g AS (SELECT match_id, f, count(*) AS n, sum(CASE WHEN d <= 80 THEN 1 ELSE 0 END) AS near, sum(CASE WHEN d <= 80 AND v IS NOT NULL THEN 1 ELSE 0 END) AS kin, sum(CASE WHEN d <= 80 AND v >= -500 AND ang <= 170 THEN 1 ELSE 0 END) AS act FROM x_k GROUP BY match_id, f)
SELECT c.f AS anchor_frame_id, CAST(coalesce(act, 0) AS INTEGER) AS pressure_actor_count, round(spread, 4) AS pressure_angle_spread_degrees, CASE WHEN cx IS NULL OR coalesce(n, 0) < 1 THEN 'UNKNOWN' WHEN near < 2 THEN 'FAIL' WHEN kin < 2 THEN 'UNKNOWN' WHEN act < 2 THEN 'FAIL' WHEN spread < 30 THEN 'FAIL' ELSE 'PASS' END AS team_press_status FROM x_c c LEFT JOIN x_g g USING (match_id, f) LEFT JOIN x_sp s USING (match_id, f)""")  # fmt: skip
def team_press_spread(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    out = relations.team_press(scope, a, maximum_press_distance_m=80.0, minimum_closing_speed_mps=-500.0, maximum_approach_angle_degrees=170.0, minimum_observed_defenders=1, lookback_seconds=0.04)
    return out.select("anchor_frame_id", "pressure_actor_count", _r("pressure_angle_spread_degrees", 4), "team_press_status")


@query("change_across_anchor", "trk outfield anc", """x_w AS (SELECT match_id, frame_id, count(*) AS n, max(y_m) - min(y_m) AS w FROM outfield WHERE team_role = 'away' GROUP BY match_id, frame_id),
x_b AS (SELECT a.match_id, a.anchor_frame_id, p.w AS b, q.w AS c, CASE WHEN coalesce(p.n, 0) < 2 THEN 'UNKNOWN' WHEN p.w > 60 THEN 'FAIL' ELSE 'PASS' END AS s, CASE WHEN coalesce(q.n, 0) < 2 THEN 'UNKNOWN' WHEN q.w > 60 THEN 'FAIL' ELSE 'PASS' END AS t FROM anc a LEFT JOIN x_w p ON p.match_id = a.match_id AND p.frame_id = a.start_frame_id LEFT JOIN x_w q ON q.match_id = a.match_id AND q.frame_id = a.end_frame_id)
SELECT anchor_frame_id, round(c - b, 6) AS delta_value, CASE WHEN s = 'UNKNOWN' THEN s WHEN s = 'FAIL' THEN s WHEN t = 'UNKNOWN' THEN t WHEN t = 'FAIL' THEN t WHEN b > 30 THEN 'FAIL' WHEN c - b >= 4 THEN 'PASS' ELSE 'FAIL' END AS change_status FROM x_b""")  # fmt: skip
def change_across_anchor(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    w = {"maximum_team_width_m": 60.0, "maximum_team_depth_m": 200.0, "minimum_observed_players": 2}
    before, after = geometry.team_compactness(scope, a, "start_frame_id", **w), geometry.team_compactness(scope, a, "end_frame_id", **w)
    out = compose.change_across_anchor(a, before, after, "team_width_m", "team_width_m", "team_compactness_status", "team_compactness_status", minimum_change_m=4.0, maximum_before_value_m=30.0)
    return out.select("anchor_frame_id", _r("delta_value"), "change_status")


@query("join_episode_sets", "anc", """x_r AS (SELECT receiver_id AS k, match_id, count(*) AS n, min(anchor_frame_id) AS f FROM (SELECT match_id, receiver_id, max(anchor_frame_id) AS anchor_frame_id FROM anc GROUP BY match_id, receiver_id UNION ALL SELECT match_id, min(receiver_id), min(anchor_frame_id) FROM anc GROUP BY match_id) t GROUP BY receiver_id, match_id)
SELECT a.anchor_frame_id, coalesce(n, 0) AS right_match_count, CASE WHEN coalesce(n, 0) = 0 THEN 'FAIL' WHEN n > 1 THEN 'UNKNOWN' WHEN (f - a.anchor_frame_id) / 25.0 < 0 OR (f - a.anchor_frame_id) / 25.0 > 20 THEN 'FAIL' ELSE 'PASS' END AS join_status FROM anc a LEFT JOIN x_r r ON r.match_id = a.match_id AND r.k = a.passer_id""")  # fmt: skip
def join_episode_sets(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    right = _last_of_receivers(a)
    out = compose.join_episode_sets(scope, a, right, "passer_id", "receiver_id", temporal_relation="left_ends_before_right", maximum_gap_seconds=20.0)
    return out.select("anchor_frame_id", "right_match_count", "join_status")


def _last_of_receivers(a):
    """The last anchor of each receiver, and once more the first anchor of a match as one of its first receiver's, so that some have several."""
    last = a.groupBy("match_id", "period", "receiver_id").agg(F.max("anchor_frame_id").alias("anchor_frame_id"))
    first = a.groupBy("match_id", "period").agg(F.min("receiver_id").alias("receiver_id"), F.min("anchor_frame_id").alias("anchor_frame_id"))
    both = last.unionByName(first)
    return both.withColumns({"anchor_id": F.concat_ws(":", "receiver_id", "anchor_frame_id"), "start_frame_id": F.col("anchor_frame_id"), "end_frame_id": F.col("anchor_frame_id") + 5})


def _as_passes(a):
    """Each order as a controlled pass from its frame to five frames later."""
    return a.withColumns({"physical_release_frame_id": F.col("anchor_frame_id"), "controlled_reception_frame_id": F.col("end_frame_id"), "controlled_pass_status": F.lit("PASS")})


@query("switch_of_play", "ball anc", """x_y AS (SELECT a.anchor_frame_id, p.ball_y AS y0, q.ball_y AS y1 FROM anc a LEFT JOIN ball p ON p.match_id = a.match_id AND p.frame_id = a.anchor_frame_id LEFT JOIN ball q ON q.match_id = a.match_id AND q.frame_id = a.end_frame_id)
SELECT anchor_frame_id, round(abs(y1 - y0), 6) AS lateral_displacement_m, CASE WHEN y0 IS NULL OR y1 IS NULL THEN 'UNKNOWN' WHEN abs(y0) <= 1 OR abs(y1) <= 1 THEN 'FAIL' WHEN y0 * y1 > 0 THEN 'FAIL' WHEN abs(y1 - y0) < 25 THEN 'FAIL' WHEN abs(y0) < 12 OR abs(y1) < 12 THEN 'FAIL' ELSE 'PASS' END AS switch_status FROM x_y""")  # fmt: skip
def switch_of_play(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    a = _as_passes(a)
    for frame, name in (("anchor_frame_id", "release"), ("end_frame_id", "reception")):
        b = scope.ball().select("match_id", "period", F.col("frame_id").alias(frame), F.struct(F.col("ball_x").alias("x_m"), F.col("ball_y").alias("y_m")).alias(f"{name}_ball_point"))
        a = a.join(b, ["match_id", "period", frame], "left")
    return geometry.switch_of_play(scope, a).select("anchor_frame_id", _r("lateral_displacement_m"), "switch_status")


@query("support_arrival", "trk outfield ball anc frames lastf", """x_w AS (SELECT a.match_id, a.anchor_frame_id AS f, b.ball_x AS bx, b.ball_y AS bz, l.last_frame_id FROM anc a JOIN lastf l USING (match_id) LEFT JOIN ball b ON b.match_id = a.match_id AND b.frame_id = a.anchor_frame_id),
x_j AS (SELECT w.match_id, w.f, o.frame_id - w.f AS pos, o.player_id AS p, sqrt((o.x_m - bx) * (o.x_m - bx) + (o.y_m - bz) * (o.y_m - bz)) <= 40 AS near FROM x_w w JOIN anc a ON a.match_id = w.match_id AND a.anchor_frame_id = w.f JOIN outfield o ON o.match_id = w.match_id AND o.frame_id BETWEEN w.f AND w.f + 5 AND o.team_role = 'home' AND o.player_id NOT IN (a.passer_id, a.receiver_id) WHERE bx IS NOT NULL),
x_g AS (SELECT *, pos - row_number() OVER (PARTITION BY match_id, f, p ORDER BY pos) AS g FROM x_j WHERE near),
x_r AS (SELECT match_id, f, p, min(pos) AS s, count(*) AS n FROM x_g GROUP BY match_id, f, p, g HAVING count(*) >= 2 AND min(pos) <= 3),
x_s AS (SELECT match_id, f, count(DISTINCT p) AS c FROM x_r GROUP BY match_id, f),
x_c AS (SELECT match_id, f, count(*) AS cand, sum(CASE WHEN n < 6 THEN 1 ELSE 0 END) AS gaps FROM (SELECT match_id, f, p, count(*) AS n FROM x_j GROUP BY match_id, f, p) t GROUP BY match_id, f)
SELECT w.f AS anchor_frame_id, CASE WHEN bx IS NULL THEN 'UNKNOWN' WHEN coalesce(c, 0) >= 1 THEN 'PASS' WHEN coalesce(cand, 0) = 0 THEN 'UNKNOWN' WHEN w.f + 5 > last_frame_id THEN 'UNKNOWN' WHEN gaps > 0 THEN 'UNKNOWN' ELSE 'FAIL' END AS support_arrival_status FROM x_w w LEFT JOIN x_s s USING (match_id, f) LEFT JOIN x_c k USING (match_id, f)""")  # fmt: skip
def support_arrival(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    out = relations.support_arrival_relation(scope, a, "anchor_frame_id", maximum_arrival_seconds=0.12, minimum_duration_seconds=0.08, maximum_support_distance_m=40.0)
    return out.select("anchor_frame_id", "support_arrival_status")


_CORRIDOR = {"max_window_seconds": 0.4, "minimum_progression_m": 5.0, "minimum_segment_length_m": 5.0, "maximum_segment_length_m": 80.0, "minimum_clearance_m": 2.0}


@query("corridor_states", "trk outfield ball anc", """x_w AS (SELECT a.match_id, a.anchor_frame_id AS f, a.anchor_frame_id + k AS g FROM anc a, (SELECT 0 AS k UNION ALL SELECT 5 UNION ALL SELECT 10) t),
x_t AS (SELECT w.*, t.player_id, t.x_m AS tx, t.y_m AS ty, b.ball_x AS bx, b.ball_y AS bz FROM x_w w JOIN outfield t ON t.match_id = w.match_id AND t.frame_id = w.g AND t.team_role = 'home' LEFT JOIN ball b ON b.match_id = w.match_id AND b.frame_id = w.g),
x_o AS (SELECT t.*, o.x_m AS ox, o.y_m AS oy, greatest(0.0, least(1.0, coalesce(((o.x_m - bx) * (tx - bx) + (o.y_m - bz) * (ty - bz)) / nullif((tx - bx) * (tx - bx) + (ty - bz) * (ty - bz), 0), 0))) AS u FROM x_t t LEFT JOIN outfield o ON o.match_id = t.match_id AND o.frame_id = t.g AND o.team_role = 'away'),
x_c AS (SELECT match_id, f, g, player_id, tx, ty, bx, bz, min(sqrt((ox - (bx + u * (tx - bx))) * (ox - (bx + u * (tx - bx))) + (oy - (bz + u * (ty - bz))) * (oy - (bz + u * (ty - bz))))) AS c, max(CASE WHEN ox IS NOT NULL THEN 1 ELSE 0 END) AS any_o FROM x_o GROUP BY match_id, f, g, player_id, tx, ty, bx, bz)
SELECT f AS anchor_frame_id, g AS frame_id, player_id AS target_player_id, CASE WHEN bx IS NULL OR any_o = 0 THEN 'UNKNOWN' WHEN sqrt((tx - bx) * (tx - bx) + (ty - bz) * (ty - bz)) <= 0.001 THEN 'INVALID' WHEN tx - bx < 5 THEN 'FAIL' WHEN sqrt((tx - bx) * (tx - bx) + (ty - bz) * (ty - bz)) < 5 OR sqrt((tx - bx) * (tx - bx) + (ty - bz) * (ty - bz)) > 80 THEN 'FAIL' WHEN c < 2 THEN 'FAIL' ELSE 'PASS' END AS state FROM x_c""")  # fmt: skip
def corridor_states(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return relations.corridor_states(scope, a, **_CORRIDOR).select(F.split("anchor_id", "a")[1].cast("long").alias("anchor_frame_id"), "frame_id", "target_player_id", "state")


def _corridor(spark, sf_dir):
    scope, a = tracking_scope(spark, sf_dir)
    return scope, relations.geometric_progressive_corridor(scope, a, **_CORRIDOR, open_after_frames=2, close_after_frames=2)


_EPISODES = """x_w AS (SELECT a.match_id, a.anchor_frame_id AS f, a.anchor_frame_id + k AS g FROM anc a, (SELECT 0 AS k UNION ALL SELECT 5 UNION ALL SELECT 10) t),
x_t AS (SELECT w.*, t.player_id, t.x_m AS tx, t.y_m AS ty, b.ball_x AS bx, b.ball_y AS bz FROM x_w w JOIN outfield t ON t.match_id = w.match_id AND t.frame_id = w.g AND t.team_role = 'home' LEFT JOIN ball b ON b.match_id = w.match_id AND b.frame_id = w.g),
x_o AS (SELECT t.*, o.x_m AS ox, o.y_m AS oy, greatest(0.0, least(1.0, coalesce(((o.x_m - bx) * (tx - bx) + (o.y_m - bz) * (ty - bz)) / nullif((tx - bx) * (tx - bx) + (ty - bz) * (ty - bz), 0), 0))) AS u FROM x_t t LEFT JOIN outfield o ON o.match_id = t.match_id AND o.frame_id = t.g AND o.team_role = 'away'),
x_c AS (SELECT match_id, f, g, player_id, tx, ty, bx, bz, sqrt((tx - bx) * (tx - bx) + (ty - bz) * (ty - bz)) AS l, min(sqrt((ox - (bx + u * (tx - bx))) * (ox - (bx + u * (tx - bx))) + (oy - (bz + u * (ty - bz))) * (oy - (bz + u * (ty - bz))))) AS c, max(CASE WHEN ox IS NOT NULL THEN 1 ELSE 0 END) AS any_o FROM x_o GROUP BY match_id, f, g, player_id, tx, ty, bx, bz),
x_s AS (SELECT *, CASE WHEN bx IS NULL OR any_o = 0 THEN 'UNKNOWN' WHEN l <= 0.001 THEN 'INVALID' WHEN tx - bx < 5 OR l < 5 OR l > 80 OR c < 2 THEN 'FAIL' ELSE 'PASS' END AS s, row_number() OVER (PARTITION BY match_id, f, player_id ORDER BY g) AS idx FROM x_c),
x_h AS (SELECT *, lag(idx) OVER (PARTITION BY match_id, f, player_id ORDER BY idx) AS pr FROM x_s WHERE s = 'PASS'),
x_g AS (SELECT *, sum(CASE WHEN pr IS NULL OR idx - pr - 1 >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, f, player_id ORDER BY idx) AS gr FROM x_h),
x_r AS (SELECT *, idx - row_number() OVER (PARTITION BY match_id, f, player_id, gr ORDER BY idx) AS r FROM x_g),
x_p AS (SELECT *, row_number() OVER (PARTITION BY match_id, f, player_id, gr, r ORDER BY idx) AS k FROM x_r),
x_q AS (SELECT *, min(CASE WHEN k = 2 THEN idx END) OVER (PARTITION BY match_id, f, player_id, gr) AS op FROM x_p),
x_e AS (SELECT match_id, f, player_id, gr, min(g) AS og, max(g) AS cg, count(*) AS n, min(c) AS mc, arg_min(ty, g) AS oy FROM x_q WHERE op IS NOT NULL AND idx > op - 2 GROUP BY match_id, f, player_id, gr HAVING count(*) >= 2)
"""


@query("corridor_episodes", "trk outfield ball anc", _EPISODES + """SELECT match_id, CONCAT('a', CAST(f AS STRING)) AS anchor_id, player_id AS target_player_id, og AS open_frame_id, cg AS close_frame_id, CAST(n AS DOUBLE) / 5 AS duration_seconds, round(mc, 6) AS minimum_clearance_m,
CONCAT(CASE WHEN oy > 0 THEN 'right' WHEN oy < 0 THEN 'left' ELSE 'central' END, '_', CASE WHEN abs(oy) < 34 * 0.33 THEN 'central' WHEN abs(oy) < 34 * 0.66 THEN 'half_space' ELSE 'wide' END) AS destination_region FROM x_e""")  # fmt: skip
def corridor_episodes(spark, sf_dir):
    return _corridor(spark, sf_dir)[1][0].select("match_id", "anchor_id", "target_player_id", "open_frame_id", "close_frame_id", "duration_seconds", "destination_region", _r("minimum_clearance_m"))


@query("corridor_exists", "trk outfield ball anc", _EPISODES + """, x_n AS (SELECT match_id, f, count(*) AS n FROM x_e GROUP BY match_id, f), x_k AS (SELECT match_id, f, max(CASE WHEN s IN ('UNKNOWN', 'INVALID') THEN 1 ELSE 0 END) AS u FROM x_s GROUP BY match_id, f)
SELECT a.match_id, a.anchor_frame_id, CAST(coalesce(n, 0) AS INTEGER) AS relation_count, CASE WHEN n > 0 THEN 'PASS' WHEN u IS NULL OR u = 1 THEN 'UNKNOWN' ELSE 'FAIL' END AS evaluation_status FROM anc a LEFT JOIN x_n x ON x.match_id = a.match_id AND x.f = a.anchor_frame_id LEFT JOIN x_k k ON k.match_id = a.match_id AND k.f = a.anchor_frame_id""")  # fmt: skip
def corridor_exists(spark, sf_dir):
    return _corridor(spark, sf_dir)[1][1].select("match_id", "anchor_frame_id", "evaluation_status", "relation_count")


@query("relation_destination_entry", "trk outfield ball anc frames lastf", _EPISODES + """, x_band AS (SELECT *, CASE WHEN abs(oy) >= 34 * 0.66 THEN 22.44 WHEN abs(oy) >= 34 * 0.33 THEN 11.22 ELSE 0 END AS near, CASE WHEN abs(oy) >= 34 * 0.66 THEN 34 WHEN abs(oy) >= 34 * 0.33 THEN 22.44 ELSE 11.22 END AS far FROM x_e), x_b AS (SELECT *, CASE WHEN oy > 0 THEN near ELSE -far END AS lo, CASE WHEN oy < 0 THEN -near ELSE far END AS hi FROM x_band),
x_x AS (SELECT e.match_id, e.f, e.player_id, e.og, min(CASE WHEN b.ball_y BETWEEN e.lo AND e.hi THEN r.frame_id END) AS ent, sum(CASE WHEN b.ball_y IS NULL THEN 1 ELSE 0 END) AS miss, count(r.frame_id) AS n FROM x_b e LEFT JOIN frames r ON r.match_id = e.match_id AND r.frame_id BETWEEN e.og AND e.og + 10 LEFT JOIN ball b ON b.match_id = r.match_id AND b.frame_id = r.frame_id GROUP BY e.match_id, e.f, e.player_id, e.og),
x_y AS (SELECT x.*, CASE WHEN ent IS NOT NULL THEN 'PASS' WHEN n = 0 OR og + 10 > last_frame_id OR miss > 0 THEN 'UNKNOWN' ELSE 'FAIL' END AS s FROM x_x x JOIN lastf USING (match_id))
SELECT match_id, CONCAT('a', CAST(f AS STRING)) AS anchor_id, player_id AS target_player_id, og AS open_frame_id, s AS entry_status, ent AS destination_entry_frame_id, CASE s WHEN 'PASS' THEN 'ENTERED' WHEN 'FAIL' THEN 'NOT_ENTERED' ELSE 'UNKNOWN' END AS classification FROM x_y""")  # fmt: skip
def relation_destination_entry(spark, sf_dir):
    scope, (ep, _) = _corridor(spark, sf_dir)
    return relations.relation_destination_entry(scope, ep, 0.4, "seed").select("match_id", "anchor_id", "target_player_id", "open_frame_id", "entry_status", "destination_entry_frame_id", "classification")




# Actions: events fused with tracking


def _passes_with(views: str, sql: str) -> str:
    return "WITH " + ",\n".join(f"{v} AS ({pass_sql(v)})" for v in views.split()) + ("," if sql.lstrip().startswith("x_") else "") + "\n" + sql


_ALIGN = """x_n AS (SELECT *, CAST(floor(event_ms / 40) AS BIGINT) AS f0 FROM passes),
x_c AS (SELECT x.*, x.f0 + k AS f, abs((x.f0 + k) * 40 - event_ms) AS d FROM x_n x CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t),
x_a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, n ORDER BY d, f) AS k2 FROM x_c) t WHERE k2 = 1)
"""


@query("nearest_frame_alignment", None, _passes_with("passes", _ALIGN + "SELECT match_id, CAST(n AS INTEGER) AS event_row_index, f AS event_anchor_frame_id, round(CAST(f * 40 - event_ms AS DOUBLE), 3) AS event_frame_offset_ms, CONCAT('h', CAST(p AS STRING)) AS passer_id, CONCAT('h', CAST(r AS STRING)) AS receiver_id FROM x_a WHERE event_type <> 'error'"))
def nearest_frame_alignment(spark, sf_dir):
    return actions.action_event_anchor(pass_scope(spark, sf_dir, tracked=False)).select("match_id", "event_row_index", "event_anchor_frame_id", _r("event_frame_offset_ms", 3), "passer_id", "receiver_id")


@query("set_piece_structure", None, _passes_with("passes pass_players", _ALIGN + """, x_s AS (SELECT a.match_id, a.n, a.event_type, a.f, max(CASE WHEN q.team_role = a.team_role THEN q.y_m END) - min(CASE WHEN q.team_role = a.team_role THEN q.y_m END) AS w, avg(CASE WHEN q.team_role <> a.team_role THEN q.x_m END) AS cx, sum(CASE WHEN q.team_role = a.team_role THEN 1 ELSE 0 END) AS m, sum(CASE WHEN q.team_role <> a.team_role THEN 1 ELSE 0 END) AS o FROM x_a a LEFT JOIN pass_players q ON q.match_id = a.match_id AND q.frame_id = a.f AND q.player_id <> 'a0' AND a.event_type IN ('purchase', 'error') GROUP BY a.match_id, a.n, a.event_type, a.f)
SELECT match_id, CAST(n AS INTEGER) AS event_row_index, CASE event_type WHEN 'purchase' THEN 'throw_in' WHEN 'error' THEN 'corner_kick' END AS set_piece_restart_type, round(w, 6) AS attacking_shape_width_m, round(cx, 6) AS defending_shape_centroid_x_m, CASE WHEN event_type NOT IN ('purchase', 'error') THEN 'FAIL' WHEN least(m, o) < 3 THEN 'UNKNOWN' ELSE 'PASS' END AS set_piece_structure_status FROM x_s"""))  # fmt: skip
def set_piece_structure(spark, sf_dir):
    out = actions.set_piece_structure(pass_scope(spark, sf_dir, framed=True), 3)
    return out.select("match_id", "event_row_index", "set_piece_restart_type", _r("attacking_shape_width_m"), _r("defending_shape_centroid_x_m"), "set_piece_structure_status")


_CONTROL = _ALIGN + """, x_p AS (SELECT match_id, n, f AS ev, p, r, team_role FROM x_a WHERE event_type <> 'error'),
x_last AS (SELECT match_id, max(base) + 39 AS last FROM passes GROUP BY match_id),
x_d AS (SELECT q.match_id, q.frame_id, q.player_id, q.team_role, sqrt((q.x_m - b.ball_x) * (q.x_m - b.ball_x) + (q.y_m - b.ball_y) * (q.y_m - b.ball_y)) AS d FROM pass_players q JOIN pass_ball b USING (match_id, frame_id)),
x_rel AS (SELECT x.match_id, x.n, x.ev, x.ev - 25 + k AS fr, CONCAT('h', CAST(x.p AS STRING)) AS who, x.team_role FROM x_p x, range(0, 101) t(k)),
x_rc AS (SELECT w.match_id, w.n, w.ev, w.fr, min(CASE WHEN d.player_id = w.who THEN d.d END) AS d, min(CASE WHEN d.player_id <> w.who THEN d.d END) AS m FROM x_rel w LEFT JOIN x_d d ON d.match_id = w.match_id AND d.frame_id = w.fr AND d.team_role = w.team_role GROUP BY w.match_id, w.n, w.ev, w.fr),
x_rf AS (SELECT *, d IS NOT NULL AS seen, coalesce(d <= 2.5 AND (m IS NULL OR d <= m + 1), FALSE) AS c FROM x_rc),
x_rl AS (SELECT *, lead(seen AND NOT c, 1) OVER w AND lead(seen AND NOT c, 2) OVER w AND lead(seen AND NOT c, 3) OVER w AND lead(d, 3) OVER w >= d + 0.5 AS free FROM x_rf WINDOW w AS (PARTITION BY match_id, n ORDER BY fr)),
x_rr AS (SELECT match_id, n, min(CASE WHEN c AND free THEN abs(fr - ev) * 1000000 + fr END) AS best, sum(CASE WHEN c THEN 1 ELSE 0 END) AS nc, sum(CASE WHEN seen THEN 1 ELSE 0 END) AS ns, count(*) AS nn, max(ev) AS ev FROM x_rl GROUP BY match_id, n),
x_q AS (SELECT p.*, CASE WHEN best IS NOT NULL THEN best % 1000000 END AS rel, CASE WHEN best IS NOT NULL THEN 'PASS' WHEN ns = 0 OR nc > 0 OR 1 - CAST(ns AS DOUBLE) / nn > 0.02 THEN 'UNKNOWN' ELSE 'FAIL' END AS rs FROM x_p p JOIN x_rr USING (match_id, n)),
x_w AS (SELECT q.match_id, q.n, q.rel, q.rel + k AS fr, CONCAT('h', CAST(q.r AS STRING)) AS who, q.team_role FROM x_q q JOIN x_last l USING (match_id), range(1, 151) t(k) WHERE rel IS NOT NULL AND q.rel + k <= l.last),
x_wc AS (SELECT w.match_id, w.n, w.rel, w.fr, min(CASE WHEN d.player_id = w.who THEN d.d END) AS d, min(CASE WHEN d.player_id <> w.who THEN d.d END) AS m FROM x_w w LEFT JOIN x_d d ON d.match_id = w.match_id AND d.frame_id = w.fr AND d.team_role = w.team_role GROUP BY w.match_id, w.n, w.rel, w.fr),
x_ws AS (SELECT *, CASE WHEN d IS NULL THEN 'missing' WHEN d <= 2.5 AND (m IS NULL OR d <= m + 1) THEN 'receiver' WHEN m <= 2.5 AND m < d THEN 'other' ELSE 'nobody' END AS s FROM x_wc),
x_wg AS (SELECT *, row_number() OVER (PARTITION BY match_id, n ORDER BY fr) - row_number() OVER (PARTITION BY match_id, n, s ORDER BY fr) AS g FROM x_ws),
x_wk AS (SELECT *, row_number() OVER (PARTITION BY match_id, n, s, g ORDER BY fr) AS k FROM x_wg),
x_e AS (SELECT match_id, n, min(CASE WHEN s = 'receiver' AND k = 6 THEN fr END) AS recv, min(CASE WHEN s = 'other' AND k = 6 THEN fr END) AS oth, sum(CASE WHEN s = 'missing' THEN 1 ELSE 0 END) AS miss, count(*) AS nn, max(fr) AS fin FROM x_wk GROUP BY match_id, n),
x_cp AS (SELECT q.match_id, q.n, q.p, q.r, q.team_role, q.rel, q.rs, CASE WHEN rs <> 'PASS' THEN 'UNKNOWN' WHEN coalesce(recv, 1152921504606846976) < coalesce(oth, 1152921504606846976) THEN 'PASS' WHEN oth IS NOT NULL THEN 'FAIL' WHEN CAST(miss AS DOUBLE) / nn > 0.02 THEN 'UNKNOWN' WHEN nn IS NULL OR fin < rel + 150 THEN 'UNKNOWN' ELSE 'FAIL' END AS cs, recv - 5 AS rec FROM x_q q LEFT JOIN x_e USING (match_id, n)),
x_st AS (SELECT c.*, CASE WHEN rs = 'FAIL' THEN 'FAIL' WHEN rs = 'UNKNOWN' THEN 'UNKNOWN' WHEN cs = 'FAIL' THEN 'FAIL' WHEN cs = 'UNKNOWN' THEN 'UNKNOWN' WHEN b0.ball_x IS NULL OR b1.ball_x IS NULL THEN 'UNKNOWN' ELSE 'PASS' END AS st, b0.ball_x AS bx0, b1.ball_x AS bx1 FROM x_cp c LEFT JOIN pass_ball b0 ON b0.match_id = c.match_id AND b0.frame_id = c.rel LEFT JOIN pass_ball b1 ON b1.match_id = c.match_id AND b1.frame_id = c.rec AND c.cs = 'PASS')
"""


@query("controlled_pass", None, _passes_with("passes pass_frames pass_ball pass_players", _CONTROL + "SELECT match_id, CAST(n AS INTEGER) AS event_row_index, rel AS physical_release_frame_id, CASE WHEN cs = 'PASS' THEN rec END AS controlled_reception_frame_id, rs AS release_control_status, cs AS controlled_reception_status, st AS controlled_pass_status FROM x_st"))
def controlled_pass(spark, sf_dir):
    return actions.controlled_pass_episode(pass_scope(spark, sf_dir, framed=True)).select("match_id", "event_row_index", "physical_release_frame_id", "controlled_reception_frame_id", "release_control_status", "controlled_reception_status", "controlled_pass_status")


@query("bypassed_count", None, _passes_with("passes pass_frames pass_ball pass_players", _CONTROL + """, x_o AS (SELECT s.match_id, s.n, s.st, s.rel, s.rec, s.team_role, sum(CASE WHEN q0.x_m * g.sg > bx0 * g.sg + 1 AND q1.x_m * g.sg < bx1 * g.sg - 1 THEN 1 ELSE 0 END) AS c, count(q0.player_id) AS n0, count(q1.player_id) AS n1, max(g.sg * (bx1 - bx0)) AS fwd FROM x_st s JOIN (SELECT 'home' AS team_role, 1 AS sg UNION ALL SELECT 'away', -1) g USING (team_role) LEFT JOIN pass_players q0 ON s.st = 'PASS' AND q0.match_id = s.match_id AND q0.frame_id = s.rel AND q0.team_role <> s.team_role AND q0.player_id <> 'a0' LEFT JOIN pass_players q1 ON q1.match_id = s.match_id AND q1.frame_id = s.rec AND q1.player_id = q0.player_id AND q1.team_role = q0.team_role GROUP BY s.match_id, s.n, s.st, s.rel, s.rec, s.team_role),
x_sw AS (SELECT o.*, (SELECT count(DISTINCT team_role) FROM pass_players q WHERE q.match_id = o.match_id AND q.player_id = 'h0' AND q.frame_id BETWEEN o.rel AND o.rec) AS sides FROM x_o o)
SELECT match_id, CAST(n AS INTEGER) AS event_row_index, CASE WHEN st <> 'PASS' THEN st WHEN sides > 1 OR n1 < n0 THEN 'UNKNOWN' ELSE 'PASS' END AS evaluation_status, CASE WHEN st = 'PASS' AND sides = 1 AND n1 = n0 THEN CAST(c AS INTEGER) END AS opponents_bypassed_count, CASE WHEN st <> 'PASS' THEN st WHEN fwd < 8 THEN 'FAIL' WHEN sides > 1 OR n1 < n0 THEN 'UNKNOWN' WHEN c < 1 THEN 'FAIL' ELSE 'PASS' END AS high_bypass_status FROM x_sw"""))  # fmt: skip
def bypassed_count(spark, sf_dir):
    out = recipes.high_bypass_completed_pass(pass_scope(spark, sf_dir, framed=True), minimum_bypassed=1)
    return out.select("match_id", "event_row_index", "evaluation_status", "opponents_bypassed_count", "high_bypass_status")


_RELAY = _CONTROL + """, x_rq AS (SELECT a.match_id, a.n AS n1, b.n AS n2, a.rel AS r1, b.rel AS r2, b.ev, b.p AS who FROM x_q a JOIN x_q b ON b.match_id = a.match_id AND b.n = a.n + 1 AND a.r = b.p AND a.team_role = b.team_role),
x_tw AS (SELECT q.*, greatest(ev - 20, r1 + 1) + k AS fr FROM x_rq q, range(0, 31) t(k) WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND greatest(ev - 20, r1 + 1) + k <= least(ev + 10, r2)),
x_td AS (SELECT w.match_id, w.n2, w.fr, w.ev, d.d FROM x_tw w LEFT JOIN x_d d ON d.match_id = w.match_id AND d.frame_id = w.fr AND d.player_id = CONCAT('h', CAST(w.who AS STRING))),
x_tt AS (SELECT match_id, n2, fr AS touch FROM (SELECT *, row_number() OVER (PARTITION BY match_id, n2 ORDER BY abs(fr - ev), d, fr) AS k FROM x_td WHERE d <= 2.75) t WHERE k = 1),
x_tm AS (SELECT match_id, n2, sum(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS miss, count(*) AS nn FROM x_td GROUP BY match_id, n2),
x_rs AS (SELECT q.*, touch, CASE WHEN r1 IS NULL OR r2 IS NULL THEN 'UNKNOWN' WHEN touch IS NULL AND coalesce(CAST(miss AS DOUBLE) / nn, 1.0) > 0.02 THEN 'UNKNOWN' WHEN touch IS NULL THEN 'FAIL' WHEN (r2 - touch) / 25.0 > 0.56 + 1e-9 THEN 'FAIL' ELSE 'PASS' END AS s FROM x_rq q LEFT JOIN x_tt USING (match_id, n2) LEFT JOIN x_tm USING (match_id, n2))
"""


@query("one_touch_relay", None, _passes_with("passes pass_frames pass_ball pass_players", _RELAY + "SELECT match_id, CONCAT(match_id, ':firstHalf:', CAST(n2 AS STRING)) AS relay_pass_episode_id, CONCAT('h', CAST(who AS STRING)) AS relay_player_id, touch AS relay_touch_frame_id, s AS one_touch_relay_status FROM x_rs"))
def one_touch_relay(spark, sf_dir):
    scope = pass_scope(spark, sf_dir, framed=True)
    return actions.one_touch_relay_episode(scope, actions.controlled_pass_episode(scope)).select("match_id", "relay_pass_episode_id", "relay_player_id", "relay_touch_frame_id", "one_touch_relay_status")


@query("pass_chain", None, _passes_with("passes pass_frames pass_ball pass_players", _RELAY + "SELECT r.match_id, CONCAT(r.match_id, ':firstHalf:', CAST(n2 AS STRING)) AS relay_pass_episode_id, CASE WHEN s <> 'PASS' THEN s ELSE t.st END AS pass_chain_status FROM x_rs r JOIN x_st t ON t.match_id = r.match_id AND t.n = r.n2"))
def pass_chain(spark, sf_dir):
    scope = pass_scope(spark, sf_dir, framed=True)
    passes = actions.controlled_pass_episode(scope)
    return actions.pass_chain_episode(actions.one_touch_relay_episode(scope, passes), passes).select("match_id", "relay_pass_episode_id", "pass_chain_status")


_CARRY = _CONTROL + """, x_nx AS (SELECT * FROM (SELECT b.match_id, b.n, q.rel AS xr, q.p AS xp, row_number() OVER (PARTITION BY b.match_id, b.n ORDER BY q.rel, CAST(q.n AS STRING)) AS k FROM x_st b JOIN x_q q ON q.match_id = b.match_id AND q.rel > b.rec AND q.rel <= b.rec + 250 WHERE b.st = 'PASS') t WHERE k = 1),
x_ct AS (SELECT b.match_id, b.n, b.team_role, b.r, b.rec, xr, xp, CASE WHEN xp = b.r THEN xr END AS fin FROM x_st b LEFT JOIN x_nx x ON x.match_id = b.match_id AND x.n = b.n WHERE b.st = 'PASS'),
x_cf AS (SELECT t.match_id, t.n, t.team_role, CONCAT('h', CAST(t.r AS STRING)) AS who, rec + k AS fr FROM x_ct t, range(0, 251) g(k) WHERE fin IS NOT NULL AND rec + k <= fin),
x_cc AS (SELECT f.match_id, f.n, f.fr, f.who, f.team_role, min(CASE WHEN d.player_id = f.who THEN d.d END) AS d, min(CASE WHEN d.player_id <> f.who THEN d.d END) AS m FROM x_cf f LEFT JOIN x_d d ON d.match_id = f.match_id AND d.frame_id = f.fr AND d.team_role = f.team_role GROUP BY f.match_id, f.n, f.fr, f.who, f.team_role),
x_cv AS (SELECT c.*, b.ball_x AS bx, b.ball_y AS bz, q.x_m AS px, q.y_m AS py FROM x_cc c LEFT JOIN pass_ball b ON b.match_id = c.match_id AND b.frame_id = c.fr LEFT JOIN pass_players q ON q.match_id = c.match_id AND q.frame_id = c.fr AND q.player_id = c.who),
x_cl AS (SELECT *, abs(sqrt((bx - lag(bx) OVER w) * (bx - lag(bx) OVER w) + (bz - lag(bz) OVER w) * (bz - lag(bz) OVER w)) * 25 - sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w) + (py - lag(py) OVER w) * (py - lag(py) OVER w)) * 25) AS dv FROM x_cv WINDOW w AS (PARTITION BY match_id, n ORDER BY fr)),
x_cg AS (SELECT match_id, n, count(*) AS nn, count(d) AS ns, sum(CASE WHEN d <= 2.5 AND (m IS NULL OR d <= m + 1) THEN 1 ELSE 0 END) AS nc, count(dv) AS nv, sum(CASE WHEN dv <= 10 THEN 1 ELSE 0 END) AS nm FROM x_cl GROUP BY match_id, n),
x_po AS (SELECT f.match_id, f.n, count(*) AS pn, sum(CASE WHEN s.team_role = f.team_role THEN 1 ELSE 0 END) AS pk FROM x_cf f JOIN (SELECT match_id, base + t AS fr, team_role FROM pass_frames) s ON s.match_id = f.match_id AND s.fr = f.fr AND s.fr % 5 = 0 GROUP BY f.match_id, f.n),
x_cr AS (SELECT t.*, CASE WHEN xr IS NULL OR fin IS NULL THEN 'FAIL' ELSE 'PASS' END AS ts, CASE WHEN coalesce(pn, 0) = 0 THEN 'UNKNOWN' WHEN pk = pn THEN 'PASS' ELSE 'FAIL' END AS ps,
  CASE WHEN nn IS NULL OR round(CAST(nn - ns AS DOUBLE) / nn, 3) > 0.02 THEN 'UNKNOWN' WHEN round(CAST(nc AS DOUBLE) / nullif(ns, 0), 3) < 0.5 THEN 'FAIL' WHEN nv = 0 THEN 'UNKNOWN' WHEN round(CAST(nm AS DOUBLE) / nv, 3) < 0.75 THEN 'FAIL' ELSE 'PASS' END AS cs FROM x_ct t LEFT JOIN x_cg g ON g.match_id = t.match_id AND g.n = t.n LEFT JOIN x_po p ON p.match_id = t.match_id AND p.n = t.n)
SELECT match_id, CONCAT(match_id, ':firstHalf:', CAST(n AS STRING)) AS source_reception_pass_id, CONCAT('h', CAST(r AS STRING)) AS carrier_id, rec AS carry_start_frame_id, fin AS carry_end_frame_id,
  CASE WHEN ts = 'FAIL' OR ps = 'FAIL' OR cs = 'FAIL' THEN 'FAIL' WHEN ps = 'UNKNOWN' OR cs = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PASS' END AS carry_status,
  CASE WHEN ts = 'FAIL' THEN 'no_own_release' WHEN ps = 'FAIL' THEN 'possession_interrupted' WHEN cs = 'FAIL' THEN 'control_not_continuous' WHEN ps = 'UNKNOWN' THEN 'possession_unknown' WHEN cs = 'UNKNOWN' THEN 'control_unknown' ELSE 'carried' END AS carry_reason FROM x_cr"""


@query("carry_episode", None, _passes_with("passes pass_frames pass_ball pass_players", _CARRY))
def carry_episode(spark, sf_dir):
    scope = pass_scope(spark, sf_dir, framed=True)
    return actions.carry_episode(scope, actions.controlled_pass_episode(scope), minimum_displacement_m=0.0, minimum_controlled_frame_ratio=0.5).select("match_id", "source_reception_pass_id", "carrier_id", "carry_start_frame_id", "carry_end_frame_id", "carry_status", "carry_reason")


def _line_at_releases():
    """The SQL of a line, at the first pass's release of each relay."""
    sql = _LINE
    for a, b in (("FROM anc a", "FROM z_an a"), ("JOIN ball b", "JOIN pass_ball b"), ("JOIN outfield o", "JOIN (SELECT * FROM pass_players WHERE player_id <> 'a0') o"), ("<= 30 +", "<= 20 +"), ("x_", "z_")):
        sql = sql.replace(a, b)
    return sql.replace("nz_", "nx_").replace("o.z_m", "o.x_m")


_CROSSING = _RELAY + ", z_an AS (SELECT match_id, r1 AS anchor_frame_id FROM x_rs WHERE s = 'PASS'),\n" + _line_at_releases() + """, x_x AS (SELECT r.match_id, r.n2, r.s, l.s AS ls, a.x_m - l.line AS d0, b.x_m - l.line AS d1 FROM x_rs r LEFT JOIN z_ls l ON l.match_id = r.match_id AND l.anchor_frame_id = r.r1 AND r.s = 'PASS' LEFT JOIN pass_players a ON a.match_id = r.match_id AND a.frame_id = r.r1 AND a.player_id = CONCAT('h', CAST(r.who AS STRING)) LEFT JOIN pass_players b ON b.match_id = r.match_id AND b.frame_id = r.touch AND b.player_id = CONCAT('h', CAST(r.who AS STRING))),
x_y AS (SELECT *, CASE WHEN s = 'FAIL' THEN 'no_relay' WHEN s <> 'PASS' THEN 'relay_unknown' WHEN ls = 'FAIL' THEN 'no_line' WHEN coalesce(ls, 'UNKNOWN') <> 'PASS' THEN 'line_unknown' WHEN d0 IS NULL OR d1 IS NULL THEN 'position_unknown' WHEN d0 > 0.5 THEN 'ahead_at_release' WHEN d1 > 0.5 THEN 'crossed_line' ELSE 'not_ahead_at_touch' END AS why FROM x_x)
SELECT match_id, CONCAT(match_id, ':firstHalf:', CAST(n2 AS STRING)) AS relay_pass_episode_id, CASE why WHEN 'crossed_line' THEN 'PASS' WHEN 'relay_unknown' THEN 'UNKNOWN' WHEN 'line_unknown' THEN 'UNKNOWN' WHEN 'position_unknown' THEN 'UNKNOWN' ELSE 'FAIL' END AS receiver_line_transition_status, why AS receiver_line_transition_reason FROM x_y"""


@query("receiver_line_transition", None, _passes_with("passes pass_frames pass_ball pass_players", _CROSSING))
def receiver_line_transition(spark, sf_dir):
    scope = pass_scope(spark, sf_dir, framed=True)
    relay = actions.one_touch_relay_episode(scope, actions.controlled_pass_episode(scope))
    scope = scope.at(relay, "input_physical_release_frame_id", "relay_touch_frame_id")
    line = lines.defensive_line_model(scope, relay, line_band_width_m=20.0, minimum_line_defenders=2, anchor_frame_field="input_physical_release_frame_id")
    at = [lines.relative_position_to_line(scope, line, relay, "relay_player_id", f) for f in ("input_physical_release_frame_id", "relay_touch_frame_id")]
    return lines.receiver_line_transition_during_pass_leg(relay, line, *at).select("match_id", "relay_pass_episode_id", "receiver_line_transition_status", "receiver_line_transition_reason")


@query(
    "block_shift_recipe", "sig st",
    """x_f AS (SELECT *, CAST(event_id % 41 - 20 AS DOUBLE) AS c, coalesce(abs(ball_y) / 34.0 >= 0.6, FALSE) AS wide FROM st),
x_g AS (SELECT match_id, idx, idx - row_number() OVER (PARTITION BY match_id ORDER BY idx) AS g FROM st WHERE has),
x_p AS (SELECT match_id, min(idx) AS i0, max(idx) AS i1 FROM x_g GROUP BY match_id, g HAVING count(*) >= 2),
x_s AS (SELECT f.*, p.i0, p.i1 FROM x_f f JOIN x_p p ON p.match_id = f.match_id AND f.idx BETWEEN p.i0 AND p.i1),
x_e AS (SELECT *, lag(wide) OVER w AS was, count(*) FILTER (abs(ball_y) < 0.45 * 34) OVER (PARTITION BY match_id, i0 ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS central, avg(c) OVER (PARTITION BY match_id, i0 ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS base FROM x_s WINDOW w AS (PARTITION BY match_id, i0 ORDER BY idx)),
x_n AS (SELECT match_id, i0, i1, idx, frame_id AS entry, CASE WHEN ball_y >= 0 THEN 1 ELSE -1 END AS side, base FROM x_e WHERE wide AND NOT was AND central > 0 AND idx - i0 >= 2 AND idx < i1),
x_m AS (SELECT n.*, f.idx AS spot, f.frame_id AS frame, n.side * (f.c - n.base) AS shift FROM x_n n JOIN x_f f ON f.match_id = n.match_id AND f.idx BETWEEN n.idx AND least(n.i1, n.idx + 2)),
x_l AS (SELECT match_id, idx, spot - row_number() OVER (PARTITION BY match_id, idx ORDER BY spot) AS g FROM x_m WHERE shift >= 3),
x_k AS (SELECT DISTINCT match_id, idx FROM x_l GROUP BY match_id, idx, g HAVING count(*) >= 2),
x_b AS (SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY match_id, idx ORDER BY shift DESC, frame) AS k FROM x_m) m JOIN x_k USING (match_id, idx) WHERE k = 1 AND round(shift, 3) >= 3),
x_w AS (SELECT b.match_id, b.idx, f.idx - b.spot AS pos, f.frame_id, f.alive, f.role, f.has, b.side * f.ball_y <= -0.35 * 34 AS sw FROM x_b b JOIN x_f f ON f.match_id = b.match_id AND f.idx BETWEEN b.spot AND b.spot + 5),
x_o AS (SELECT match_id, idx, min(pos) FILTER (NOT alive) AS d, min(pos) FILTER (alive AND role <> 'home') AS l, min(pos) FILTER (sw) AS s, arg_min(has, pos) FILTER (sw) AS kept, max(pos) AS last, map(list(pos), list(frame_id)) AS fr FROM x_w GROUP BY match_id, idx),
x_c AS (SELECT b.*, o.*, CASE WHEN d IS NOT NULL AND (s IS NULL OR d < s) AND (l IS NULL OR d < l) THEN 'STOPPAGE' WHEN s IS NOT NULL AND kept THEN 'SWITCHED' WHEN l IS NOT NULL THEN 'LOST_BEFORE_SWITCH' ELSE 'RETAINED_NO_SWITCH' END AS label FROM x_b b JOIN x_o o ON o.match_id = b.match_id AND o.idx = b.idx),
x_a AS (SELECT match_id, i0, entry, frame AS anchor, side, shift, label, fr[CASE label WHEN 'SWITCHED' THEN s WHEN 'LOST_BEFORE_SWITCH' THEN l ELSE last END] AS outcome FROM x_c WHERE label <> 'STOPPAGE')
SELECT a.match_id, a.entry AS wide_entry_frame_id, a.anchor AS anchor_frame_id, round(a.shift, 3) AS signed_shift_metres, CASE WHEN side > 0 THEN 'right' ELSE 'left' END AS ball_side, outcome AS outcome_frame_id, a.label AS classification FROM x_a a JOIN (
WITH RECURSIVE r AS (SELECT match_id, i0, min(entry) AS entry FROM x_a GROUP BY match_id, i0 UNION ALL
SELECT n.match_id, n.i0, n.f FROM (SELECT r.match_id, r.i0, (SELECT min(s.entry) FROM x_a s WHERE s.match_id = r.match_id AND s.i0 = r.i0 AND s.entry - r.entry >= 5) AS f FROM r) n WHERE n.f IS NOT NULL) SELECT * FROM r) k ON k.match_id = a.match_id AND k.i0 = a.i0 AND k.entry = a.entry""",
)
def block_shift_recipe(spark, sf_dir):
    scope = _shift_scope(spark, sf_dir)
    out = recipes.ball_side_block_shift(scope, outcome_horizon_seconds=1.2, retained_after_switch_seconds=0.2, dedupe_window_seconds=1.0, minimum_wide_dwell_seconds=0.2, baseline_window_seconds=0.4, shift_search_window_seconds=0.6, minimum_shift_metres=3.0, minimum_shift_persistence_seconds=0.4)
    return out.select("match_id", "wide_entry_frame_id", "anchor_frame_id", "signed_shift_metres", "ball_side", "outcome_frame_id", "classification")


def _shift_scope(spark, sf_dir, **kw):
    """The users' signals, with one defender a frame whose place follows from the event."""
    scope, sig = signal_scope(spark, sf_dir, **({"minimum_possession_seconds": 0.4, "minimum_outfield_players_per_team": 1} | kw))
    centroid = sig.select("match_id", "period", "frame_id", F.lit("away").alias("team_role"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("entity_id"), F.lit("player").alias("entity_type"), F.lit(0.0).alias("x_m"), (F.col("event_id") % 41 - 20).cast("double").alias("y_m"))
    players = centroid.select("match_id", F.col("entity_id").alias("player_id"), F.lit(False).alias("is_goalkeeper"))
    return dataclasses.replace(scope, tables=dataclasses.replace(scope.tables, positions=scope.tables.positions.unionByName(centroid), players=players))


@query("target_inspection", "sig", _EVAL + """, x_0 AS (SELECT match_id, min(frame_id) AS f0 FROM sig GROUP BY match_id),
x_n AS (SELECT match_id, frame_id AS anchor_frame_id, CAST(abs((frame_id - f0) * 40 - 600) AS DOUBLE) AS distance_ms, CASE WHEN s = 'PASS' THEN 'SOME' END AS classification FROM x_s JOIN x_0 USING (match_id) WHERE match_id = 'u1' AND abs((frame_id - f0) * 40 - 600) <= 400 ORDER BY distance_ms, anchor_frame_id LIMIT 1)
SELECT n.match_id, n.anchor_frame_id, n.distance_ms, n.classification, CASE WHEN n.match_id IS NULL THEN 'NO_COMPATIBLE_ANCHOR' WHEN n.classification IS NULL THEN 'NON_MATCH' ELSE 'MATCH' END AS target_status FROM (SELECT 1 AS one) o LEFT JOIN (SELECT 1 AS one, * FROM x_n) n USING (one)""")  # fmt: skip
def target_inspection(spark, sf_dir):
    _, sig = signal_scope(spark, sf_dir)
    a, ev = _click_or_signup(sig), _evaluations(sig)
    traces = emission.trace(a, "any", predicates.exists(a, ev))
    results = emission.classify(a, traces, [("SOME", ["any"])])
    return emission.inspect_target(a, traces, results, "u1", "firstHalf", 600, 400, sig).select("match_id", "anchor_frame_id", "distance_ms", "classification", "target_status")


@query(
    "evidence_projection", "sig",
    _EVAL + f"""SELECT match_id, frame_id AS anchor_frame_id, {_LABEL} ELSE 'MANY' END AS classification, CASE WHEN event_type = 'click' THEN CAST(c AS BIGINT) END AS view_count, CASE WHEN event_type = 'click' THEN s END AS seen, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS evidence_missing FROM x_s""",
)
def evidence_projection(spark, sf_dir):
    """Results with a required and an optional field of the evaluations; sign-ups have none."""
    _, sig = signal_scope(spark, sf_dir)
    r = _classified("include_with_warning")(spark, sf_dir).withColumns({"period": F.lit("firstHalf"), "anchor_id": F.concat_ws(":", "match_id", "anchor_frame_id")})
    ev = _evaluations(sig)
    return emission.project(r, [(ev, "relation_count", "view_count", True), (ev, "evaluation_status", "seen", False)]).select("match_id", "anchor_frame_id", "classification", "view_count", "seen", "evidence_missing")


@query(
    "witness_evidence", "sig",
    """x_r AS (SELECT a.match_id, a.frame_id AS f, CAST(b.event_id AS VARCHAR) AS rid, b.measure AS m FROM sig a JOIN sig b ON b.match_id = a.match_id AND b.frame_id BETWEEN a.frame_id + 1 AND a.frame_id + 3 WHERE a.event_type = 'click'),
x_w AS (SELECT match_id, f, rid FROM (SELECT *, row_number() OVER (PARTITION BY match_id, f ORDER BY m DESC, rid) AS k FROM x_r WHERE m IS NOT NULL) t WHERE k = 1),
x_e AS (SELECT r.*, row_number() OVER (PARTITION BY r.match_id, r.f ORDER BY r.rid) AS k FROM x_r r LEFT JOIN x_w w ON w.match_id = r.match_id AND w.f = r.f WHERE w.rid IS NULL OR w.rid = r.rid)
SELECT a.match_id, a.frame_id AS anchor_frame_id, e.rid AS related_event, round(e.m, 6) AS related_measure, round(a.ball_x, 6) AS ball_x, CASE WHEN e.rid IS NULL THEN 1 ELSE 0 END + CASE WHEN e.m IS NULL THEN 1 ELSE 0 END AS evidence_missing
FROM sig a LEFT JOIN x_e e ON e.match_id = a.match_id AND e.f = a.frame_id AND e.k = 1 WHERE a.event_type = 'click'""",
)
def witness_evidence(spark, sf_dir):
    """Clicks with evidence of the related event that has the greatest measure, of up to three, and of a frame signal."""
    _, sig = signal_scope(spark, sf_dir)
    a = sig.where("event_type = 'click'").select("match_id", "period", F.concat_ws(":", "match_id", "frame_id").alias("anchor_id"), F.col("frame_id").alias("anchor_frame_id"))
    near = a.withColumn("frame_id", F.explode(F.sequence(F.col("anchor_frame_id") + 1, F.col("anchor_frame_id") + 3))).join(sig.select("match_id", "period", "frame_id", F.col("event_id").cast("string").alias("relation_id"), "measure"), ["match_id", "period", "frame_id"])
    best = F.min(F.when(F.col("measure").isNotNull(), F.struct((-F.col("measure")).alias("m"), "relation_id")))
    ev = near.groupBy("match_id", "period", "anchor_id", "anchor_frame_id").agg(best["relation_id"].alias("witness_relation_id"))
    w = emission.witnesses(a, [], ev)
    out = emission.project(a, [(near, "relation_id", "related_event", True, w), (near, "measure", "related_measure", True, w), (sig, "ball_x", "ball_x", False)])
    return out.select("match_id", "anchor_frame_id", "related_event", _r("related_measure"), _r("ball_x"), "evidence_missing")


@query(
    "percentile_summary", "sig",
    """x_n AS (SELECT match_id, role, event_type, measure, row_number() OVER (PARTITION BY match_id, role ORDER BY measure) - 1 AS k, count(*) OVER (PARTITION BY match_id, role) AS n FROM sig WHERE measure IS NOT NULL),
x_a AS (SELECT match_id, role, max(n) AS n, min(measure) AS lo, max(measure) AS hi, max(measure) FILTER (k = CAST(round_even((n - 1) * CAST(0.5 AS DOUBLE), 0) AS BIGINT)) AS p50,
max(measure) FILTER (k = CAST(round_even((n - 1) * CAST(0.9 AS DOUBLE), 0) AS BIGINT)) AS p90, max(measure) FILTER (k = CAST(round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) AS BIGINT)) AS p95 FROM x_n GROUP BY match_id, role)
SELECT g.match_id, g.role, coalesce(n, 0) AS count, lo AS min, p50, p90, p95, hi AS max FROM (SELECT DISTINCT match_id, role FROM sig) g LEFT JOIN x_a USING (match_id, role)""",
)
def percentile_summary(spark, sf_dir):
    """Measures of each match and side: count, extremes and percentiles, by exact ranks."""
    _, sig = signal_scope(spark, sf_dir)
    return ranks.summary(sig, ["match_id", "role"], "measure")


@query("unknown_policy_invalidate", "sig", _EVAL + f"SELECT match_id, frame_id AS anchor_frame_id, CASE WHEN s <> 'UNKNOWN' THEN {_LABEL} END END AS classification, s = 'UNKNOWN' AS unknown_candidate FROM x_s")
def unknown_policy_invalidate(spark, sf_dir):
    _, sig = signal_scope(spark, sf_dir)
    return emission.classify(_click_or_signup(sig), _rule_traces(sig), _RULES, "invalidate_execution").select("match_id", "anchor_frame_id", "classification", "unknown_candidate")


@query("evidence_bundle", "trk anc", "SELECT CONCAT('r', CAST(a.anchor_frame_id AS STRING)) AS result_id, t.frame_id, count(*) AS n_entities FROM anc a JOIN trk t ON t.match_id = a.match_id AND t.frame_id BETWEEN a.anchor_frame_id - 2 AND a.anchor_frame_id + 2 GROUP BY a.anchor_frame_id, t.frame_id")
def evidence_bundle(spark, sf_dir):
    """The replay frames around every anchor, as the bundle's files give them."""
    scope, a = tracking_scope(spark, sf_dir)
    path = scratch(spark, "bundle")
    build.evidence_bundle(a.select("match_id", "period", "anchor_frame_id", F.concat(F.lit("r"), F.col("anchor_frame_id").cast("string")).alias("result_id")), scope.tables.positions.where("entity_type = 'player'"), path, 2, 2)
    rows = spark.read.schema("result_id string, frame_id long, entities array<struct<entity_id: string>>").json(f"{path}/replay")
    return rows.select("result_id", "frame_id", F.size("entities").cast("long").alias("n_entities"))


@query("replay_window", "trk", "SELECT frame_id, count(*) AS n_entities, round(sum(x_m), 3) AS sum_x FROM (SELECT frame_id, round(x_m, 3) AS x_m FROM trk WHERE match_id = 'm0' AND frame_id BETWEEN 100 AND 200) t GROUP BY frame_id")
def replay(spark, sf_dir):
    scope, _ = tracking_scope(spark, sf_dir)
    w = build.replay_window(scope.tables.positions.where("entity_type = 'player'").withColumn("timestamp_utc", F.lit("")), "m0", "firstHalf", 100, 200)
    return w.select("frame_id", F.size("entities").cast("long").alias("n_entities"), F.round(F.aggregate("entities", F.lit(0.0), lambda t, e: t + e["x_m"]), 3).alias("sum_x"))


@query("quality_report", "trk frames", """x_p AS (SELECT match_id, count(*) AS rows, sum(CASE WHEN abs(x_m) > 52.5 OR abs(y_m) > 34 THEN 1 ELSE 0 END) AS outside_rows, round(min(x_m), 6) AS x_min, round(max(y_m), 6) AS y_max FROM trk GROUP BY match_id),
x_f AS (SELECT match_id, count(*) AS frames FROM frames GROUP BY match_id)
SELECT match_id, rows, outside_rows, x_min, y_max, frames FROM x_p JOIN x_f USING (match_id)""")  # fmt: skip
def quality_report(spark, sf_dir):
    scope, _ = tracking_scope(spark, sf_dir)
    out = build.quality_report(scope.tables.positions.where("entity_type = 'player'"), scope.tables.frames)
    return out.select("match_id", "rows", "outside_rows", _r("x_min"), _r("y_max"), "frames")
