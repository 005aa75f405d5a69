"""Documents, binding, planning and the host's tools."""

import dataclasses
import json

import pytest

from kinograph.plans import recipes, search
from kinograph.plans.api import Host
from kinograph.plans.bind import BindError, bind, bind_document, check_model_authored
from kinograph.plans.catalog import OPERATORS, PRIMITIVES, RELATIONS, catalog
from kinograph.plans.compile import OPERATORS as COMPILED
from kinograph.plans.compile import compile_plan
from kinograph.plans.types import ClassificationRule, ComplexityLimits, Document, DocumentError, EvidenceRequest, OperatorRef, ParameterDefinition, ParameterRef, PredicateNode, SignalRef, TypedValue
from kinograph.sources.tables import Tables

DOCS = {d.recipe.recipe_id: d for d in (recipes.regain_document(["m"]), recipes.corridor_document(["m"]), recipes.line_break_support_document(["m"]), recipes.relay_document(["m"]), recipes.high_bypass_document(["m"]))}


def test_catalog_is_whole_and_compiled():
    assert (len(PRIMITIVES), len(RELATIONS), len(OPERATORS)) == (37, 7, 8)
    assert {n for _, n in catalog()} == set(COMPILED)


@pytest.mark.parametrize("name", DOCS)
def test_documents_bind_and_survive_json(name):
    d = DOCS[name]
    assert bind_document(Document.from_json(d.to_json())).bound_plan_hash == bind_document(d).bound_plan_hash


@pytest.mark.parametrize(
    ("path", "value"),
    [(("extra",), 1), (("draft_plan", "nodes", 0, "kind"), "thing"), (("default_invocation", "match_ids"), ["a", "a"]), (("default_invocation", "max_results"), 0), (("default_invocation", "periods"), ["extraTime"]), (("recipe", "output_classifications"), [])],
)
def test_malformed_documents_are_refused(path, value):
    raw = json.loads(DOCS["settled_regain"].to_json())
    at = raw
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    with pytest.raises(DocumentError):
        Document.from_json(json.dumps(raw))


def _n(v, u="none"):
    return TypedValue("number", v, u)


D = DOCS["settled_regain"]
REGAIN, OUTCOME, SETTLED, LOST = D.draft_plan.nodes


def _with(nodes=None, **kw):
    return dataclasses.replace(D.draft_plan, **({"nodes": nodes} if nodes else {}), **kw)


def _p(**kw):
    return dataclasses.replace(SETTLED, **kw)


BAD = {
    "recipe_id_mismatch": _with(recipe_id="other"),
    "recipe_version_mismatch": _with(recipe_version="9"),
    "missing_unknown_evidence_policy": _with(unknown_evidence_policy=None),
    "complexity_max_plan_nodes_ceiling_exceeded": _with(complexity_limits=ComplexityLimits(max_plan_nodes=41)),
    "complexity_nodes_exceeded": _with(complexity_limits=ComplexityLimits(max_plan_nodes=1)),
    "complexity_nesting_depth_exceeded": _with(complexity_limits=ComplexityLimits(max_nesting_depth=1)),
    "complexity_execution_cost_exceeded": _with(complexity_limits=ComplexityLimits(max_execution_cost=1)),
    "complexity_results_exceeded": _with(complexity_limits=ComplexityLimits(max_returned_moments=1)),
    "unknown_catalog_ref": _with([dataclasses.replace(REGAIN, catalog_ref="nothing"), OUTCOME, SETTLED, LOST]),
    "duplicate_node_id": _with([REGAIN, OUTCOME, SETTLED, LOST, LOST]),
    "unknown_node_input": _with([dataclasses.replace(REGAIN, inputs={"x": SignalRef("a", "b")}), OUTCOME, SETTLED, LOST]),
    "missing_node_input": _with([REGAIN, dataclasses.replace(OUTCOME, inputs={}), SETTLED, LOST]),
    "unresolved_temporal_reference": _with([OUTCOME, REGAIN, SETTLED, LOST]),
    "input_temporal_mismatch": _with([REGAIN, dataclasses.replace(OUTCOME, inputs={"anchors": SignalRef("regain", "transition_status")}), SETTLED, LOST]),
    "unknown_node_parameter": _with([dataclasses.replace(REGAIN, parameters={"x": _n(1)}), OUTCOME, SETTLED, LOST]),
    "parameter_above_maximum": _with([dataclasses.replace(REGAIN, parameters={"minimum_prior_possession_seconds": _n(99, "second")}), OUTCOME, SETTLED, LOST]),
    "parameter_unit_mismatch": _with([dataclasses.replace(REGAIN, parameters={"minimum_prior_possession_seconds": _n(1, "metre")}), OUTCOME, SETTLED, LOST]),
    "parameter_value_not_allowed": _with([dataclasses.replace(REGAIN, parameters={"transition_type": TypedValue("enum", "x")}), OUTCOME, SETTLED, LOST]),
    "unresolved_parameter_reference": _with([dataclasses.replace(REGAIN, parameters={"transition_type": ParameterRef("x")}), OUTCOME, SETTLED, LOST]),
    "unknown_operator": _with([REGAIN, OUTCOME, _p(operator=OperatorRef("lt")), LOST]),
    "missing_compare_value": _with([REGAIN, OUTCOME, _p(compare=None), LOST]),
    "compare_payload_mismatch": _with([REGAIN, OUTCOME, _p(compare=_n(1)), LOST]),
    "compare_value_not_allowed": _with([REGAIN, OUTCOME, _p(compare=TypedValue("enum", "X")), LOST]),
    "unexpected_duration": _with([REGAIN, OUTCOME, _p(duration=_n(1, "second")), LOST]),
    "operator_payload_mismatch": _with([REGAIN, OUTCOME, _p(operator=OperatorRef("gt")), LOST]),
    "required_cardinality_mismatch": _with([REGAIN, OUTCOME, _p(required_cardinality="collection"), LOST]),
    "coverage_not_available": _with([REGAIN, OUTCOME, PredicateNode("settled", SignalRef("outcome", "outcome_window_status"), OperatorRef("exists")), LOST]),
    "classification_label_mismatch": _with(classification_rules=D.draft_plan.classification_rules[:1]),
    "duplicate_classification_label": _with(classification_rules=[D.draft_plan.classification_rules[0]] * 2),
    "unknown_classification_predicate": _with(classification_rules=[ClassificationRule("SETTLED", ["x"]), ClassificationRule("NOT_SETTLED", ["lost"])]),
    "classification_mode_unsupported": _with(classification_mode="x"),
    "missing_anchor_source": _with(anchor_source=None),
    "invalid_anchor_source": _with(anchor_source=SignalRef("regain", "transition_status")),
    "unsupported_evidence_field": _with(requested_evidence=[EvidenceRequest(SignalRef("settled", "predicate"), "x")]),
}


@pytest.mark.parametrize("code", BAD)
def test_faults_are_told(code):
    with pytest.raises(BindError) as e:
        bind(D.recipe, D.default_invocation, BAD[code])
    assert code in {i.code for i in e.value.issues}


def test_duration_of_a_parameter_cant_pass_the_horizon():
    recipe = dataclasses.replace(D.recipe, parameters=[ParameterDefinition("hold", "number", unit="second", default=_n(20.0, "second"))])
    node = PredicateNode("held", SignalRef("settled", "predicate"), OperatorRef("persists_for"), duration=ParameterRef("hold"))
    with pytest.raises(BindError) as e:
        bind(recipe, D.default_invocation, _with([REGAIN, OUTCOME, SETTLED, LOST, node]))
    assert "complexity_temporal_horizon_exceeded" in {i.code for i in e.value.issues}


def test_model_authored_plans_are_held_back():
    assert {i.code for i in check_model_authored(D.draft_plan)} == {"model_plan_must_be_experimental"}
    assert not check_model_authored(dataclasses.replace(D.draft_plan, status="experimental"))


def test_same_nodes_have_the_same_key():
    twin = dataclasses.replace(OUTCOME, node_id="twin")
    plan = bind(D.recipe, D.default_invocation, _with([REGAIN, OUTCOME, twin, SETTLED, LOST]))
    keys: dict[str, str] = {}
    for n in plan.nodes:
        keys[n.node.node_id] = n.key(keys)
    assert keys["outcome"] == keys["twin"] != keys["regain"]


def test_contracts_and_lowering():
    found = search.plan_contract(search.Contract("t", {"line_break_status": "PASS"}), ["m"])
    assert found.status == "reachable" and [n.catalog_ref for n in found.nodes][-1] == "controlled_line_break_episode"
    assert search.plan_contract(search.Contract("t", {"x": "PASS"}), ["m"]).reason == "unknown_field"
    assert search.plan_contract(search.Contract("t", {"line_status": "PASS"}, modality="video"), ["m"]).reason == "unsupported_modality"
    change = search.Expression("settled_regain", {"outcome": {"maximum_window_seconds": _n(3.0, "second")}})
    assert search.lower(change, DOCS).plan_hash != bind_document(D).plan_hash
    assert search.lower(search.Expression("x"), DOCS).code == "unknown_recipe"
    assert search.lower(search.Expression("settled_regain", {"nope": {}}), DOCS).code == "unknown_node"


@pytest.fixture(scope="module")
def tables(spark):
    """One half of a minute: away, home for six samples, dead, away, home for two."""
    roles = ["away"] * 5 + ["home"] * 6 + ["home"] + ["away"] * 4 + ["home"] * 2 + ["away"] * 6
    alive = [True] * 11 + [False] + [True] * 12
    rows = [("m", "firstHalf", 10_000 + i * 5 + k, r, a) for i, (r, a) in enumerate(zip(roles, alive, strict=True)) for k in range(5)]
    state = spark.createDataFrame(rows, "match_id string, period string, frame_id long, possession_team_role string, ball_alive boolean")
    ball = state.selectExpr("match_id", "period", "frame_id", "'ball' as team_role", "'b' as entity_id", "'ball' as entity_type", "0.0D as x_m", "0.0D as y_m", "'t' as timestamp_utc")
    sides = spark.createDataFrame([("m", "firstHalf", "home", 1), ("m", "firstHalf", "away", -1)], "match_id string, period string, team_role string, attack_x_sign int")
    return Tables(positions=ball, ball_state=state, frames=state.select("match_id", "period", "frame_id"), orientation=sides)


def test_a_plan_runs(spark, tables):
    run = compile_plan(bind_document(D), tables)
    got = {r.anchor_frame_id: (r.classification, r.possession_phase_status) for r in run.results.collect()}
    assert got == {10_025: ("SETTLED", "SETTLED"), 10_080: ("NOT_SETTLED", "NOT_SETTLED")}
    assert run.status() == "pass"


def test_the_host(spark, tables, tmp_path):
    h = Host(spark, tables, f"{tmp_path}/host", f"file://{tmp_path}/results")
    assert len(h.list_capabilities()) == 52 and h.describe_capability("marking")["kind"] == "primitive"
    h.save_recipe(D)
    assert h.search_recipes("regains settles")[0]["recipe_id"] == "settled_regain"
    assert h.submit("{")["status"] == "rejected"
    draft = h.submit(D.to_json())["draft_id"]
    assert h.validate(draft, model_authored=True)["status"] == "invalid"
    auth = h.confirm(h.validate(draft)["bound_id"], "someone")["authorization_id"]
    ran = h.execute(auth)
    assert (ran["status"], ran["rows"], ran["cached"]) == ("pass", 2, False)
    assert h.execute(auth)["cached"]
    r = h.result(ran["execution_id"]).orderBy("anchor_frame_id").first()
    assert {t["predicate_id"] for t in h.inspect_result(ran["execution_id"], r.result_id)["traces"]} == {"settled", "lost"}
    assert h.explain_non_match(ran["execution_id"], "m", "firstHalf", 1_000, 500)["target_status"] == "MATCH"
    assert h.explain_non_match(ran["execution_id"], "m", "firstHalf", 1, 5)["target_status"] == "NO_COMPATIBLE_ANCHOR"
    assert h.replay("m", "firstHalf", 10_000, 10_003).count() == 4
    assert h.compare_versions(ran["execution_id"], ran["execution_id"]).where("change <> 'same'").count() == 0
    assert h.feedback(ran["execution_id"], r.result_id, "agree")


