"""The catalog: what operators there are, what they take and what they give.

Fixed values: names, types, defaults, ranges and domains of all entries, in a
short notation. An input or output is name:container/payload/cardinality/unit/scope;
`anchors` stands for episode_set/anchor_ref/collection/none/anchor and `status`
for frame_signal/enum/single/none/anchor. A parameter is name=default, unit,
[least,most] or {allowed values}; REQ has no default.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

from .types import ParameterDefinition, TypedValue

_SHORT = {"anchors": "episode_set/anchor_ref/collection/none/anchor", "status": "frame_signal/enum/single/none/anchor"}
_N = "frame_signal/number/single/{}/anchor"
_POSSESSION, _REL = "episode_set/boolean/collection/none/possession", "relation_episode_set/relation_ref/collection/none/relation"

_F = "anchor_frame_id physical_release_frame_id controlled_reception_frame_id"
_CARRY = "carry_start_frame_id carry_end_frame_id"
_PLAYERS = "receiver_id passer_id relay_player_id terminal_receiver_id"
_TRI = "PASS FAIL UNKNOWN"
_OPP = "opposition_outfield_to_anchor_team defending_outfield perspective_outfield"
_CORRIDOR = "max_window_seconds=REQ second[0.2,15]; minimum_progression_m=REQ metre[0,80]; minimum_segment_length_m=REQ metre[0,80]; maximum_segment_length_m=REQ metre[0,100]; minimum_clearance_m=REQ metre[0,40]; open_after_frames=REQ count[1,100]; close_after_frames=REQ count[1,100]; minimum_duration_seconds=REQ second[0,15]; side_filter=REQ{any same_ball_side opposite_ball_side}"
_CORRIDOR_OUT = f"episodes:{_REL} anchor_evaluations:episode_set/boolean/collection/none/anchor"
_E = "anchor_evaluations:anchors"

PRIMITIVES = {
    "possession_segment": ("", f"episodes:{_POSSESSION} anchors:anchors", ""),
    "transition_anchor": ("", f"{_E} transition_status:status", "transition_type=regain{regain loss}; minimum_prior_possession_seconds=0.4 second[0,10]; zone_filter=any{any own_half attacking_half defensive_third middle_third final_third}; zone_boundary_buffer_m=0.5 metre[0,5]"),
    "structured_zone": ("anchors:anchors", f"{_E} zone_status:status", "frame_field=anchor_frame_id{anchor_frame_id transition_frame_id physical_release_frame_id controlled_reception_frame_id}; zone_name=own_half{own_half attacking_half defensive_third middle_third final_third}; zone_boundary_buffer_m=0.5 metre[0,5]"),
    "space_region_generation": ("anchors:anchors", f"{_E} open_space_status:status open_space_region_count:{_N.format('count')} representative_open_space_point:frame_signal/point/single/none/anchor", "frame_field=anchor_frame_id{anchor_frame_id transition_frame_id carry_end_frame_id controlled_reception_frame_id}; zone_scope=any{any attacking_half defensive_half middle_third final_third}; grid_step_m=8.0 metre[2,20]; minimum_opponent_distance_m=8.0 metre[1,30]; minimum_teammate_distance_m=4.0 metre[0,20]; minimum_open_points=1.0 count[1,20]; maximum_candidate_points=5.0 count[1,50]; minimum_observed_players_per_team=6.0 count[1,10]"),
    "outcome_window": ("anchors:anchors", f"{_E} outcome_window_status:status possession_phase_status:status", f"maximum_window_seconds=8.0 second[0.1,30]; minimum_settled_possession_seconds=4.0 second[0.1,20]; required_anchor_status_field=transition_status{{none transition_status zone_status}}; required_anchor_status_value=PASS{{{_TRI}}}"),
    "action_event_anchor": ("", f"{_E} action_event_status:status", "action_type=successful_pass{successful_pass throw_in_successful_pass}"),
    "set_piece_structure": ("", f"{_E} set_piece_structure_status:status", "minimum_observed_outfield_players=6.0 count[1,10]"),
    "action_chain": ("actions:anchors", f"{_E} action_chain_status:status", "maximum_action_gap_seconds=5.0 second[0,20]; chain_length=2 count[2,2]"),
    "tracking_quality": ("anchors:anchors", f"{_E} tracking_quality_status:status", f"frame_field=anchor_frame_id{{{_F}}}"),
    "pairwise_distance": ("anchors:anchors", f"{_E} distance_m:{_N.format('metre')} pairwise_distance_status:status", f"frame_field=anchor_frame_id{{{_F} {_CARRY} terminal_release_frame_id}}; entity_a_field=receiver_id{{{_PLAYERS} carrier_id}}; entity_b_field=ball{{ball {_PLAYERS}}}; maximum_distance_m=10.0 metre[0,80]"),
    "marking": ("anchors:anchors", f"{_E} marking_status:status unmarked_status:status nearest_marker_distance_m:{_N.format('metre')}", f"frame_field=anchor_frame_id{{{_F} event_anchor_frame_id {_CARRY} terminal_release_frame_id}}; target_player_id_field=receiver_id{{{_PLAYERS} carrier_id run_player_id}}; candidate_scope=opposition_outfield_to_anchor_team{{{_OPP}}}; maximum_marking_distance_m=3.0 metre[0.5,15]; minimum_observed_marker_candidates=6.0 count[1,10]"),
    "cover_shadow": ("anchors:anchors", f"{_E} cover_shadow_status:status passing_lane_denial_status:status screening_defender_distance_to_lane_m:{_N.format('metre')}", f"frame_field=anchor_frame_id{{{_F} event_anchor_frame_id {_CARRY}}}; target_entity_field=receiver_id{{{_PLAYERS} carrier_id run_player_id}}; candidate_scope=opposition_outfield_to_anchor_team{{{_OPP}}}; maximum_lane_distance_m=2.0 metre[0.1,10]; minimum_projection_fraction=0.05 fraction[0,0.49]; minimum_lane_length_m=5.0 metre[0.1,80]; minimum_observed_defenders=6.0 count[1,10]"),
    "velocity": ("anchors:anchors", f"{_E} speed_mps:{_N.format('none')} velocity_status:status", f"frame_field=anchor_frame_id{{{_F}}}; entity_id_field=receiver_id{{{_PLAYERS}}}; lookback_seconds=0.4 second[0.04,3]"),
    "acceleration": ("anchors:anchors", f"{_E} acceleration_mps2:{_N.format('none')} acceleration_status:status deceleration_status:status", f"frame_field=anchor_frame_id{{{_F} transition_frame_id {_CARRY}}}; entity_id_field=receiver_id{{{_PLAYERS} carrier_id}}; lookback_seconds=0.4 second[0.04,3]; minimum_abs_delta_speed_mps=0.4[0,8]; minimum_abs_acceleration_mps2=0.75[0,20]; maximum_player_speed_mps=10.0[0.1,15]; maximum_abs_acceleration_mps2=12.0[0.1,30]"),
    "off_ball_run": ("anchors:anchors", f"{_E} off_ball_run_status:status run_speed_mps:{_N.format('none')}", "frame_field=anchor_frame_id{anchor_frame_id event_anchor_frame_id transition_frame_id controlled_reception_frame_id}; candidate_scope=same_team_outfield_as_anchor{same_team_outfield_as_anchor perspective_outfield defending_outfield}; lookahead_seconds=1.2 second[0.2,5]; minimum_run_displacement_m=4.0 metre[0,30]; minimum_run_speed_mps=3.0[0,12]; minimum_ball_distance_m=5.0 metre[0,40]; minimum_observed_candidates=6.0 count[1,10]; maximum_missing_candidate_ratio=0.35[0,1]"),
    "off_ball_run_type": ("runs:anchors", f"{_E} run_in_behind_status:status diagonal_run_status:status off_ball_run_type_status:status", "minimum_forward_progression_m=4.0 metre[0,40]; minimum_lateral_displacement_m=2.0 metre[0,40]; minimum_observed_defenders=6.0 count[1,10]"),
    "time_to_arrival": ("anchors:anchors", f"{_E} minimum_arrival_seconds:{_N.format('second')} time_to_arrival_status:status", f"frame_field=anchor_frame_id{{anchor_frame_id transition_frame_id physical_release_frame_id controlled_reception_frame_id}}; target_mode=entity{{entity ball fields}}; target_entity_field=receiver_id{{{_PLAYERS}}}; target_x_field=reception_ball_x_m{{release_ball_x_m reception_ball_x_m zone_ball_x_m}}; target_y_field=reception_ball_y_m{{release_ball_y_m reception_ball_y_m zone_ball_y_m}}; candidate_scope=defending_outfield{{defending_outfield perspective_outfield all_outfield opposition_outfield_to_anchor_team same_team_outfield_as_anchor}}; maximum_arrival_seconds=2.0 second[0,15]; maximum_player_speed_mps=7.0[0.1,12]; minimum_observed_candidates=1 count[1,22]"),
    "carry_episode": ("controlled_pass_anchors:anchors", f"episodes:anchors {_E} carry_status:status displacement_m:{_N.format('metre')} forward_progression_m:{_N.format('metre')}", "maximum_carry_seconds=10.0 second[0.4,20]; minimum_displacement_m=3.0 metre[0,40]; control_distance_m=2.5 metre[0.1,5]; nearest_teammate_margin_m=1.0 metre[0,5]; maximum_ball_player_speed_delta_mps=10.0[0,10]; minimum_controlled_frame_ratio=1.0[0.5,1]; minimum_comoving_frame_ratio=0.75[0,1]; maximum_missing_frame_ratio=0.02[0,0.5]"),
    "join_episode_sets": ("left_episodes:anchors right_episodes:anchors", f"{_E} join_status:status", "left_key_field=anchor_id{anchor_id terminal_pass_id input_pass_episode_id relay_pass_episode_id right_anchor_id}; right_key_field=anchor_id{anchor_id pass_episode_id input_pass_episode_id relay_pass_episode_id right_anchor_id}; left_status_field=none{none carry_status change_status one_touch_relay_status pass_chain_status join_status}; right_status_field=none{none carry_status change_status one_touch_relay_status pass_chain_status join_status}; required_status_value=PASS{PASS FAIL UNKNOWN}; temporal_relation=none{none left_ends_before_right left_starts_before_right overlaps}; left_time_field=anchor_frame_id{anchor_frame_id start_frame_id end_frame_id carry_start_frame_id carry_end_frame_id relay_touch_frame_id terminal_controlled_reception_frame_id}; right_time_field=anchor_frame_id{anchor_frame_id start_frame_id end_frame_id carry_start_frame_id carry_end_frame_id relay_touch_frame_id terminal_controlled_reception_frame_id}; maximum_gap_seconds=999.0 second[0,999]; distinct_entity_fields=none{none input_passer_id,relay_player_id carrier_id,relay_player_id,terminal_receiver_id passer_id,receiver_id,terminal_receiver_id}; same_entity_fields=none{none input_passer_id=terminal_receiver_id}"),
    "team_compactness": ("anchors:anchors", f"{_E} team_compactness_status:status", f"frame_field=anchor_frame_id{{{_F}}}; player_scope=defending_outfield{{defending_outfield perspective_outfield}}; maximum_team_width_m=45.0 metre[1,80]; maximum_team_depth_m=35.0 metre[1,120]; minimum_observed_players=8 count[1,10]"),
    "switch_of_play": ("anchors:anchors", f"{_E} switch_status:status", "minimum_lateral_displacement_m=25.0 metre[0,80]; minimum_start_lateral_m=12.0 metre[0,40]; minimum_end_lateral_m=12.0 metre[0,40]; maximum_duration_seconds=8.0 second[0.1,20]"),
    "change_across_anchor": ("anchors:anchors before_evaluations:anchors after_evaluations:anchors", f"{_E} change_status:status", "before_value_field=line_compactness_m{line_compactness_m team_width_m team_depth_m team_area_m2 nearest_defender_distance_m closing_speed_mps}; after_value_field=line_compactness_m{line_compactness_m team_width_m team_depth_m team_area_m2 nearest_defender_distance_m closing_speed_mps}; before_status_field=line_status{line_status multi_line_status team_compactness_status pressure_status}; after_status_field=line_status{line_status multi_line_status team_compactness_status pressure_status none}; required_status_value=PASS{PASS}; change_mode=increase_at_least{increase_at_least decrease_at_least absolute_delta_at_least}; minimum_change_m=4.0 metre[0,80]; maximum_before_value_m=12.0 metre[0,80]"),
    "controlled_pass_episode": ("", f"episodes:{_POSSESSION} anchors:anchors controlled_pass_status:frame_signal/enum/single/none/possession forward_progression_m:frame_signal/number/single/metre/possession", "release_search_before_seconds=1.0 second[0,5]; release_search_after_seconds=3.0 second[0,8]; reception_search_seconds=6.0 second[0.2,15]; control_distance_m=2.5 metre[0.1,8]; nearest_teammate_margin_m=1.0 metre[0,5]; minimum_receiver_dwell_seconds=0.24 second[0.04,2]; event_type_filter=any{any Play_Pass ThrowIn_Play_Pass GoalKick_Play_Pass}"),
    "one_touch_relay_episode": ("", f"{_E} episodes:{_POSSESSION} one_touch_relay_status:status", "relay_max_event_gap_seconds=3.0 second[0.1,10]; relay_touch_distance_m=2.75 metre[0.1,8]; maximum_relay_dwell_seconds=0.56 second[0.04,2]"),
    "defensive_line_model": ("anchors:anchors", f"{_E} line_status:status", f"goal_side_buffer_m=1.0 metre[0,10]; line_band_width_m=2.0 metre[0.1,15]; minimum_line_defenders=4 count[2,10]; anchor_frame_field=anchor_frame_id{{{_F} input_physical_release_frame_id relay_touch_frame_id relay_physical_release_frame_id}}"),
    "multi_line_model": ("anchors:anchors", f"{_E} multi_line_status:status", f"goal_side_buffer_m=1.0 metre[0,10]; line_band_width_m=2.0 metre[0.1,15]; minimum_line_defenders=3 count[2,10]; target_line_rank=2 count[1,4]; anchor_frame_field=physical_release_frame_id{{{_F} event_anchor_frame_id}}"),
    "relative_position_to_line": ("line_evaluations:anchors entity_anchors:anchors", f"{_E} relative_position_status:status", f"entity_id_field=receiver_id{{{_PLAYERS}}}; entity_frame_field=controlled_reception_frame_id{{{_F} input_physical_release_frame_id relay_touch_frame_id relay_physical_release_frame_id terminal_controlled_reception_frame_id}}; line_buffer_m=0.5 metre[0,10]"),
    "receiver_line_transition_during_pass_leg": ("relay_anchors:anchors line_evaluations:anchors release_relative_positions:anchors relay_relative_positions:anchors", f"{_E} receiver_line_transition_status:status", ""),
    "pass_chain_episode": ("relay_anchors:anchors terminal_controlled_pass_anchors:anchors", f"{_E} pass_chain_status:status", ""),
    "controlled_line_break_episode": ("controlled_pass_anchors:anchors line_evaluations:anchors release_relative_positions:anchors reception_relative_positions:anchors", f"{_E} line_break_status:status", "line_buffer_m=0.5 metre[0,10]"),
    "lane_occupancy": ("anchors:anchors", f"{_E} lane_occupancy_status:status", f"frame_field=anchor_frame_id{{{_F}}}; player_scope=perspective_outfield{{perspective_outfield defending_outfield}}; required_occupied_lane_count=0 count[0,5]"),
    "ball_lateral_fraction": ("", "fraction:frame_signal/number/single/fraction/ball", ""),
    "defensive_outfield_centroid": ("", "centroid_y:frame_signal/number/per_team/metre/team", ""),
    "signed_lateral_shift": (f"possession_episodes:{_POSSESSION} entry_episodes:episode_set/boolean/collection/none/ball defensive_centroid:frame_signal/number/per_team/metre/team", "signed_shift:frame_signal/number/single/metre/team anchors:anchors", ""),
    "outcome_classification": ("accepted_shift_episodes:episode_set/boolean/collection/none/team", "classification:frame_signal/enum/single/none/possession", "horizon=REQ second[0.2,30]"),
    "relation_destination_entry": (f"relation_episodes:{_REL}", "entry_status:frame_signal/enum/single/none/relation", "destination_entry_horizon_seconds=REQ second[0.2,30]; result_id_seed=REQ; episode_selection=REQ{entry_first_then_progression first_by_duration_clearance}"),
    "relation_destination_entry_classification": (f"relation_episodes:{_REL}", "classification:frame_signal/enum/single/none/relation", "destination_entry_horizon_seconds=REQ second[0.2,30]; result_id_seed=REQ; episode_selection=REQ{first_by_duration_clearance}"),
}

RELATIONS = {
    "geometric_progressive_corridor": ("anchors:frame_signal/enum/single/none/possession", _CORRIDOR_OUT, _CORRIDOR),
    "geometric_progressive_corridor_from_anchor_set": ("anchors:anchors", _CORRIDOR_OUT, _CORRIDOR),
    "opponents_bypassed_by_action": (f"controlled_pass_episodes:{_POSSESSION} controlled_pass_anchors:anchors", f"{_E} opponents_bypassed_count:{_N.format('count')} forward_progression_m:{_N.format('metre')} evaluation_status:status", "goal_side_buffer_m=1.0 metre[0,5]; bypassed_buffer_m=1.0 metre[0,5]"),
    "support_arrival_relation": ("anchors:anchors", f"{_E} support_arrival_status:status", "anchor_frame_field=controlled_reception_frame_id{controlled_reception_frame_id anchor_frame_id}; candidate_scope=perspective_outfield{perspective_outfield defending_outfield}; support_region_mode=WITHIN_DISTANCE_OF_REFERENCE_POINT{WITHIN_DISTANCE_OF_REFERENCE_POINT BEHIND_BALL_OUTLET AHEAD_OF_BALL_OPTION}; maximum_arrival_seconds=2.0 second[0,10]; minimum_duration_seconds=0.4 second[0,5]; maximum_support_distance_m=8.0 metre[0.5,30]; minimum_supporting_players=1 count[1,10]; required_anchor_status_field=none{none line_break_status receiver_line_transition_status}; required_anchor_status_value=PASS{PASS FAIL UNKNOWN}"),
    "pressure_on_carrier": ("anchors:anchors", f"{_E} pressure_status:status", f"frame_field=controlled_reception_frame_id{{{_F} {_CARRY} terminal_release_frame_id}}; carrier_id_field=receiver_id{{{_PLAYERS} carrier_id}}; maximum_pressure_distance_m=4.0 metre[0.5,15]; minimum_closing_speed_mps=0.2[-5,10]; maximum_approach_angle_degrees=100.0[0,180]; minimum_pressure_duration_seconds=0.0 second[0,5]; lookback_seconds=0.4 second[0.04,3]; candidate_scope=defending_outfield{{defending_outfield}}"),
    "team_press": ("anchors:anchors", f"{_E} team_press_status:status pressure_actor_count:{_N.format('count')} pressure_angle_spread_degrees:{_N.format('none')}", f"frame_field=anchor_frame_id{{{_F} {_CARRY} terminal_release_frame_id}}; carrier_id_field=receiver_id{{{_PLAYERS} carrier_id}}; maximum_press_distance_m=7.0 metre[1,20]; minimum_closing_speed_mps=0.0[-5,10]; maximum_approach_angle_degrees=135.0[0,180]; minimum_pressing_defenders=2.0 count[2,10]; minimum_angle_spread_degrees=30.0[0,180]; minimum_observed_defenders=6.0 count[1,10]; lookback_seconds=0.4 second[0.04,3]; candidate_scope=defending_outfield{{defending_outfield}}"),
    "local_number_relation": ("anchors:anchors", f"{_E} local_number_status:status", f"frame_field=controlled_reception_frame_id{{{_F}}}; radius_m=10.0 metre[0.5,40]; minimum_difference=1 count[-10,10]; minimum_perspective_players=0 count[0,11]; maximum_defending_players=99 count[0,99]"),
}

#: Domains of enum outputs other than PASS, FAIL and UNKNOWN.
DOMAINS = {
    "relative_position_status": ("AHEAD", "BEHIND", "LEVEL", "UNKNOWN"),
    "possession_phase_status": ("SETTLED", "NOT_SETTLED", "UNKNOWN"),
    "classification": ("STOPPAGE", "SWITCHED", "LOST_BEFORE_SWITCH", "RETAINED_NO_SWITCH", "ENTERED", "NOT_ENTERED", "UNKNOWN"),
}


@dataclass(frozen=True)
class Port:
    name: str
    container: str
    payload: str
    cardinality: str
    unit: str
    scope: str
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Entry:
    kind: str
    name: str
    inputs: tuple[Port, ...]
    outputs: tuple[Port, ...]
    parameters: tuple[ParameterDefinition, ...]
    version: str = "0.1.0"
    executable: bool = True


@dataclass(frozen=True)
class Operator:
    name: str
    containers: tuple[str, ...]
    payloads: tuple[str, ...]
    compare: bool
    duration: bool
    unit_must_match: bool = True
    version: str = "1.0.0"
    cardinalities: tuple[str, ...] = ("single", "per_team", "per_player", "collection")


_SCALAR = ("boolean", "number", "enum", "entity_ref", "team_ref", "region_ref")

OPERATORS = {
    o.name: o
    for o in (
        Operator("gt", ("scalar", "frame_signal"), ("number",), True, False),
        Operator("gte", ("scalar", "frame_signal"), ("number",), True, False),
        Operator("lte", ("scalar", "frame_signal"), ("number",), True, False),
        Operator("eq", ("scalar", "frame_signal"), _SCALAR, True, False),
        Operator("neq", ("scalar", "frame_signal"), _SCALAR, True, False),
        Operator("persists_for", ("frame_signal",), ("boolean",), False, True),
        Operator("exists", ("episode_set", "relation_episode_set"), ("boolean", "anchor_ref", "relation_ref"), False, False),
        Operator("count_at_least", ("episode_set", "relation_episode_set"), ("boolean", "anchor_ref", "relation_ref"), True, False, unit_must_match=False),
    )
}


def _ports(text: str) -> tuple[Port, ...]:
    out = []
    for part in text.split():
        name, kind = part.split(":")
        container, payload, cardinality, unit, scope = _SHORT.get(kind, kind).split("/")
        out.append(Port(name, container, payload, cardinality, unit, scope, DOMAINS.get(name, ("PASS", "FAIL", "UNKNOWN")) if payload == "enum" else None))
    return tuple(out)


_PARAM = re.compile(r"(?P<name>\w+)=(?P<default>[^ \[{]+) ?(?P<unit>[a-z]*)(?:\[(?P<lo>[^,]+),(?P<hi>[^\]]+)\])?(?:\{(?P<allowed>[^}]*)\})?")


def _parameters(text: str) -> tuple[ParameterDefinition, ...]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = _PARAM.fullmatch(part)
        if not m:
            raise ValueError(part)
        kind = "enum" if m["allowed"] is not None or (m["lo"] is None and not m["unit"]) else "number"
        unit = m["unit"] or "none"
        raw = m["default"]
        default = None if raw == "REQ" else TypedValue(kind, raw if kind == "enum" else (float(raw) if "." in raw else int(raw)), unit)
        out.append(
            ParameterDefinition(
                m["name"], kind, unit=unit, required=default is None, default=default, minimum=None if m["lo"] is None else float(m["lo"]), maximum=None if m["hi"] is None else float(m["hi"]),
                allowed_values=m["allowed"].split() if m["allowed"] is not None else None,
            )
        )
    return tuple(out)


@cache
def catalog() -> dict[tuple[str, str], Entry]:
    """All entries by kind and name: 37 primitives and 7 relations."""
    return {(kind, name): Entry(kind, name, _ports(i), _ports(o), _parameters(p)) for kind, table in (("primitive", PRIMITIVES), ("relation", RELATIONS)) for name, (i, o, p) in table.items()}
