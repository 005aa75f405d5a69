"""From a bound plan to lazy frames: all matches and periods in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import actions, compose, emission, geometry, lines, possession, predicates, relations
from ..sources.tables import ANCHOR, KEYS, Scope, Tables
from .bind import BoundNode, BoundPlan
from .types import CatalogNode, EvidenceRequest, PredicateNode, SignalRef

#: Nodes that choose one relation of an anchor.
ENTRIES = ("relation_destination_entry", "relation_destination_entry_classification")

Frames = dict[str, DataFrame]
Run = Callable[[Scope, Frames, dict], Frames]


def _at(f) -> Run:
    """An operator over one anchor set: (scope, anchors, **parameters)."""

    def run(scope: Scope, inputs: Frames, p: dict) -> Frames:
        (a,) = inputs.values()
        return {"anchor_evaluations": f(scope, a, **p)}

    return run


def _free(f, *names: str) -> Run:
    """An operator over the tables alone; names: outputs that are the same frame."""
    return lambda scope, inputs, p: dict.fromkeys(names, f(scope, **p))


def _pressure(f) -> Run:
    return lambda scope, inputs, p: {"anchor_evaluations": f(scope, inputs["anchors"], **{k: v for k, v in p.items() if k != "candidate_scope"})}


def _corridor(scope: Scope, inputs: Frames, p: dict) -> Frames:
    p = p | {k: int(p[k]) for k in ("open_after_frames", "close_after_frames")}
    ep, ev = relations.geometric_progressive_corridor(scope, inputs["anchors"], **p)
    return {"episodes": ep, "anchor_evaluations": ev}


def _passes(scope: Scope, inputs: Frames, p: dict) -> Frames:
    out = actions.controlled_pass_episode(scope, **p)
    return {"episodes": out, "anchors": out, "anchor_evaluations": out}


def _relays(scope: Scope, inputs: Frames, p: dict) -> Frames:
    out = actions.one_touch_relay_episode(scope, actions.controlled_pass_episode(scope), **p)
    return {"anchor_evaluations": out, "episodes": out}


def _named(scope: Scope, *names: str) -> dict[str, float]:
    """The recipe's parameters of these names, where it has them."""
    return {k: float(scope.recipe[k]) for k in names if k in scope.recipe}


def _shift(scope: Scope, inputs: Frames, p: dict) -> Frames:
    given = _named(scope, "prior_central_fraction", "minimum_wide_dwell_seconds", "baseline_window_seconds", "shift_search_window_seconds")
    out, series = possession.signed_lateral_shift(scope, inputs["possession_episodes"], inputs["entry_episodes"], inputs["defensive_centroid"], **given)
    return {"signed_shift": out, "anchors": out, "anchor_evaluations": out, "signed_shift_series": series}


def _outcome(scope: Scope, inputs: Frames, p: dict) -> Frames:
    """Where the defenders were too few the classification is unknown."""
    given = _named(scope, "opposite_side_fraction", "retained_after_switch_seconds", "dedupe_window_seconds")
    out = possession.outcome_classification(scope, inputs["accepted_shift_episodes"], p["horizon"], **given)
    return {"classification": out.withColumn("classification", F.when(F.col("quality_status") == "pass", F.col("classification")))}


OPERATORS: dict[str, Run] = {
    "possession_segment": _free(possession.possession_segment, "episodes", "anchors"),
    "transition_anchor": _free(possession.transition_anchor, "anchor_evaluations"),
    "structured_zone": _at(possession.structured_zone),
    "space_region_generation": _at(geometry.space_region_generation),
    "outcome_window": _at(possession.outcome_window),
    "action_event_anchor": _free(actions.action_event_anchor, "anchor_evaluations"),
    "set_piece_structure": _free(actions.set_piece_structure, "anchor_evaluations"),
    "action_chain": _at(actions.action_chain),
    "tracking_quality": _at(geometry.tracking_quality),
    "pairwise_distance": _at(geometry.pairwise_distance),
    "marking": _at(geometry.marking),
    "cover_shadow": _at(geometry.cover_shadow),
    "velocity": _at(geometry.velocity),
    "acceleration": _at(geometry.acceleration),
    "off_ball_run": _at(geometry.off_ball_run),
    "off_ball_run_type": _at(geometry.off_ball_run_type),
    "time_to_arrival": _at(geometry.time_to_arrival),
    "carry_episode": lambda s, i, p: dict.fromkeys(("episodes", "anchor_evaluations"), actions.carry_episode(s, i["controlled_pass_anchors"], **p)),
    "join_episode_sets": lambda s, i, p: {"anchor_evaluations": compose.join_episode_sets(s, i["left_episodes"], i["right_episodes"], **p)},
    "team_compactness": _at(geometry.team_compactness),
    "switch_of_play": _at(geometry.switch_of_play),
    "change_across_anchor": lambda s, i, p: {"anchor_evaluations": compose.change_across_anchor(i["anchors"], i["before_evaluations"], i["after_evaluations"], **p)},
    "controlled_pass_episode": _passes,
    "one_touch_relay_episode": _relays,
    "defensive_line_model": _at(lines.defensive_line_model),
    "multi_line_model": _at(lines.multi_line_model),
    "relative_position_to_line": lambda s, i, p: {"anchor_evaluations": lines.relative_position_to_line(s, i["line_evaluations"], i["entity_anchors"], **p)},
    "receiver_line_transition_during_pass_leg": lambda s, i, p: {"anchor_evaluations": lines.receiver_line_transition_during_pass_leg(i["relay_anchors"], i["line_evaluations"], i["release_relative_positions"], i["relay_relative_positions"])},
    "pass_chain_episode": lambda s, i, p: {"anchor_evaluations": actions.pass_chain_episode(i["relay_anchors"], i["terminal_controlled_pass_anchors"])},
    "controlled_line_break_episode": lambda s, i, p: {"anchor_evaluations": lines.controlled_line_break_episode(i["controlled_pass_anchors"], i["line_evaluations"], i["release_relative_positions"], i["reception_relative_positions"], **p)},
    "lane_occupancy": _at(geometry.lane_occupancy),
    "ball_lateral_fraction": _free(possession.ball_lateral_fraction, "fraction"),
    "defensive_outfield_centroid": _free(possession.defensive_outfield_centroid, "centroid_y"),
    "signed_lateral_shift": _shift,
    "outcome_classification": _outcome,
    "relation_destination_entry": lambda s, i, p: {"entry_status": relations.relation_destination_entry(s, i["relation_episodes"], **p, select_one=True)},
    "relation_destination_entry_classification": lambda s, i, p: {"classification": relations.relation_destination_entry(s, i["relation_episodes"], **p, select_one=True)},
    "geometric_progressive_corridor": _corridor,
    "geometric_progressive_corridor_from_anchor_set": _corridor,
    "opponents_bypassed_by_action": lambda s, i, p: {"anchor_evaluations": relations.opponents_bypassed_by_action(s, i["controlled_pass_anchors"], **p)},
    "support_arrival_relation": _at(relations.support_arrival_relation),
    "pressure_on_carrier": _pressure(relations.pressure_on_carrier),
    "team_press": _pressure(relations.team_press),
    "local_number_relation": _at(geometry.local_number_relation),
}


def _whole(v):
    """Numbers that stand for counts, as whole ones."""
    return int(v) if isinstance(v, float) and v.is_integer() else v


@dataclass
class Execution:
    """The lazy frames of a plan. Nothing has run until one of them is acted on."""

    plan: BoundPlan
    anchors: DataFrame
    traces: DataFrame
    results: DataFrame
    nodes: dict[str, Frames] = field(default_factory=dict)

    def status(self) -> str:
        """pass, or incomplete where required evidence is missing or an unknown candidate invalidates the run; one small aggregate."""
        bad = F.count_if(F.col("evidence_missing") > 0)
        if self.plan.draft.unknown_evidence_policy == "invalidate_execution":
            bad = bad + F.count_if("unknown_candidate")
        return "incomplete" if self.results.agg(bad).first()[0] else "pass"


def compile_plan(plan: BoundPlan, tables: Tables) -> Execution:
    """Nodes that compute the same are compiled once; frames with several readers are shared by the plan's exchanges."""
    inv, values = plan.invocation, plan.parameters
    scope = Scope(
        tables.only(inv.match_ids, inv.periods), inv.perspective_team_role, int(values["analysis_rate_hz"].value), 25, float(values["minimum_possession_seconds"].value), float(values["maximum_analysis_gap_ms"].value), int(values["minimum_outfield_players_per_team"].value), {k: v.value for k, v in values.items()},
    )
    if any(isinstance(b.node, CatalogNode) and b.node.catalog_ref == "signed_lateral_shift" for b in plan.nodes):
        scope = scope.sampled()
    done: dict[str, Frames] = {}
    by_key: dict[str, Frames] = {}
    keys: dict[str, str] = {}
    signals: dict[tuple[str, str], str] = {}
    traces: list[tuple[str, DataFrame, str]] = []
    for bound in plan.nodes:
        n = bound.node
        key = keys[n.node_id] = bound.key(keys)
        if key not in by_key:
            if isinstance(n, CatalogNode):
                inputs = {name: _output(done, r.source_node_id, r.output_name) for name, r in n.inputs.items()}
                made = OPERATORS[n.catalog_ref](scope, inputs, {k: _whole(v) for k, v in bound.parameters.items()})
                if n.kind == "relation" and "episodes" in made:
                    most = plan.draft.complexity_limits.max_relations_per_anchor
                    made = made | {"episodes": emission.limited_relations(made["episodes"], most, n.node_id), "anchor_evaluations": emission.limited_counts(made["anchor_evaluations"], most, n.node_id)}
                by_key[key] = made
            else:
                by_key[key] = _predicate(scope, bound, done, signals)
        done[n.node_id] = by_key[key]
        if isinstance(n, PredicateNode):
            df = done[n.node_id]["predicate"]
            traces.append((n.node_id, df, "interval" if n.operator.name == "persists_for" and "anchor_id" not in df.columns else "anchor"))
            signals[(n.node_id, "predicate")] = "predicate_status"
    src = plan.draft.anchor_source
    anchors = emission.extracted(_output(done, src.source_node_id, src.output_name))
    long = None
    for node_id, df, kind in traces:
        if kind == "interval":
            t = emission.interval_trace(anchors, node_id, df)
        elif set(ANCHOR) <= set(df.columns):
            t = emission.trace(anchors, node_id, df)
        else:
            t = emission.interval_trace(anchors, node_id, df.withColumns({"start_frame_id": F.col("frame_id"), "end_frame_id": F.col("frame_id")}))
        long = t if long is None else long.unionByName(t)
    results = emission.classify(anchors, long, [(r.label, r.predicate_ids) for r in plan.draft.classification_rules], plan.draft.unknown_evidence_policy)
    wanted = [(*_source(done, e), e.alias or e.field, e.required, _witness(plan, done, anchors, e.source)) for e in plan.draft.requested_evidence]
    results = emission.project(results, wanted)
    results = emission.ordered(results, inv.match_ids, plan.bound_plan_hash, inv.max_results)
    return Execution(plan, anchors, long, results, done)


def _source(done: dict[str, Frames], e: EvidenceRequest) -> tuple[DataFrame, str]:
    """The frame and column of requested evidence; of a frame signal its own column, also under the name of its value."""
    df, field = _output(done, e.source.source_node_id, e.source.output_name), e.field
    if field not in df.columns and field in ("value", "classification") and e.source.output_name in df.columns:
        field = e.source.output_name
    return df, field


def _witness(plan: BoundPlan, done: dict[str, Frames], anchors: DataFrame, source: SignalRef) -> DataFrame | None:
    """The relation of each anchor that evidence of a source is taken from; none where the source has no relations.

    For a relation's episodes: the one that a destination entry over them chose; else the witness of predicates over the source (its
    episodes and its evaluations of anchors are one source), that of the evaluations, the relation of other outputs of the node.
    """
    frames = done[source.source_node_id]
    if "relation_id" not in _output(done, source.source_node_id, source.output_name).columns:
        return None
    names = {source.output_name} | ({"anchor_evaluations"} if source.output_name == "episodes" else set())
    entries, traces = [], []
    for bound in plan.nodes:
        n = bound.node
        if isinstance(n, CatalogNode) and n.catalog_ref in ENTRIES and source.output_name == "episodes" and n.inputs.get("relation_episodes") == source:
            entries.append(next(iter(done[n.node_id].values())).withColumnRenamed("relation_id", "witness_relation_id"))
        if isinstance(n, PredicateNode) and n.input.source_node_id == source.source_node_id and n.input.output_name in names:
            t = done[n.node_id]["predicate"]
            traces.append(t if "witness_relation_id" in t.columns or "relation_id" not in t.columns else t.withColumnRenamed("relation_id", "witness_relation_id"))
    chosen = [frames[x] for x in dict.fromkeys((source.output_name, "classification", "entry_status")) if x in frames]
    return emission.witnesses(anchors, [*entries, *traces], frames.get("anchor_evaluations"), chosen)


def _output(done: dict[str, Frames], node: str, name: str) -> DataFrame:
    """An output's frame; signals that an operator gives beside its evaluations are columns of these."""
    frames = done[node]
    if name in frames:
        return frames[name]
    return frames.get("anchor_evaluations", next(iter(frames.values())))


def _predicate(scope: Scope, bound: BoundNode, done: dict[str, Frames], signals) -> Frames:
    """The predicate's rows, and where it has them its episodes, or the truth on each frame of each record (series).

    A signal has a row for each frame of a half, or for each frame of each anchor; persists_for folds either.
    """
    n = bound.node
    df, name, op = _output(done, n.input.source_node_id, n.input.output_name), n.input.output_name, n.operator.name
    if op in ("exists", "count_at_least"):
        a = df.select(*ANCHOR, "anchor_frame_id").dropDuplicates(list(ANCHOR))
        return {"predicate": predicates.exists(a, df) if op == "exists" else predicates.count_at_least(a, df, int(bound.compare.value))}
    if op == "persists_for":
        d = bound.duration
        if (series := done[n.input.source_node_id].get("series")) is not None:
            out = predicates.record_persists(df, series, d.value, d.unit, scope.analysis_rate_hz)
            return {"predicate": out, "episodes": out.where("gate_passed")}
        truth = F.when(F.col("predicate_status") == "PASS", True).when(F.col("predicate_status") == "FAIL", False)
        order = "idx" if "idx" in df.columns else ("frame_id" if "frame_id" in df.columns else "anchor_frame_id")
        df = df if "frame_id" in df.columns else df.withColumn("frame_id", F.col("anchor_frame_id"))
        out = predicates.persists_for(df, truth, d.value, d.unit, scope.analysis_rate_hz, KEYS, order)
        return {"predicate": out, "episodes": out.where(F.col("predicate_status") == "PASS")}
    column = next((c for c in (name, {"signed_shift": "signed_shift_metres"}.get(name, name), signals.get((n.input.source_node_id, name), name)) if c in df.columns), None)
    if column is None:
        raise ValueError(f"{n.input.source_node_id}.{name} has no column")
    out = {"predicate": predicates.threshold(df, op, column, bound.compare.value, bound.compare.unit)}
    series = done[n.input.source_node_id].get(f"{name}_series")
    return out if series is None else out | {"series": predicates.threshold(series, op, name, bound.compare.value, bound.compare.unit)}
