"""Plan documents: typed values, recipes, invocations and plans, as strict dataclasses.

Documents come as JSON; unknown keys and malformed values are refused when they
are read. Canonical JSON (sorted keys, compact, ASCII) gives their identity.
"""

from __future__ import annotations

import dataclasses
import json
import re
import types
import typing
from dataclasses import dataclass, field
from typing import Any

from ..functions.identity import stable_hash

#: The axes of the type system.
CONTAINERS = ("scalar", "frame_signal", "episode_set", "relation_episode_set")
PAYLOADS = ("boolean", "number", "enum", "anchor_ref", "entity_ref", "team_ref", "region_ref", "point", "entity_set", "relation_ref")
CARDINALITIES = ("single", "per_player", "per_team", "collection")
UNITS = ("none", "metre", "second", "millisecond", "frame", "hertz", "count", "fraction")
SCOPES = ("none", "anchor", "ball", "player", "team", "match", "possession", "frame", "relation")
MISSING = ("unknown", "quality_fail", "not_applicable")
POLICIES = ("exclude_candidate", "include_with_warning", "invalidate_execution")
PERIODS = ("firstHalf", "secondHalf")
MODES = ("bind_only", "dry_run", "execute")

_NAME = re.compile(r"[a-z][a-z0-9_]*")
_LABEL = re.compile(r"[A-Z][A-Z0-9_]*")


class DocumentError(ValueError):
    """A document that can't be read."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise DocumentError(message)


def _name(value: Any, what: str) -> None:
    _need(isinstance(value, str) and bool(_NAME.fullmatch(value)), f"{what}: {value!r} is no name")


@dataclass(frozen=True)
class TypedValue:
    payload_type: str
    value: Any
    unit: str = "none"

    def __post_init__(self):
        _need(self.payload_type in PAYLOADS and self.unit in UNITS, f"unknown type {self.payload_type}/{self.unit}")
        v, kind = self.value, self.payload_type
        number = isinstance(v, int | float) and not isinstance(v, bool)
        if kind == "boolean":
            ok = isinstance(v, bool)
        elif kind == "number":
            ok = number
        elif kind == "point":
            ok = isinstance(v, dict) and set(v) == {"x_m", "y_m"} and all(isinstance(x, int | float) for x in v.values())
        elif kind == "entity_set":
            ok = isinstance(v, list) and all(isinstance(x, str) for x in v)
        else:
            ok = isinstance(v, str)
        _need(ok, f"{v!r} is no {kind}")
        _need(kind == "number" or self.unit in ("none", "count"), "only numbers carry a physical unit")


@dataclass(frozen=True)
class ParameterRef:
    name: str
    kind: str = "parameter"

    def __post_init__(self):
        _name(self.name, "parameter")
        _need(self.kind == "parameter", "kind must be parameter")


@dataclass(frozen=True)
class ParameterDefinition:
    name: str
    payload_type: str
    description: str = ""
    unit: str = "none"
    required: bool = False
    default: TypedValue | None = None
    minimum: float | None = None
    maximum: float | None = None
    allowed_values: list[str] | None = None

    def __post_init__(self):
        _name(self.name, "parameter")
        _need(self.minimum is None or self.maximum is None or self.minimum <= self.maximum, "minimum exceeds maximum")
        _need(self.allowed_values is None or self.payload_type == "enum", "allowed_values are for enums")
        if self.default is None:
            _need(self.required, "a parameter that isn't required needs a default")
            return
        d = self.default
        _need(d.payload_type == self.payload_type and d.unit == self.unit, "the default's type differs")
        if d.payload_type == "number":
            _need((self.minimum is None or d.value >= self.minimum) and (self.maximum is None or d.value <= self.maximum), "the default is out of range")
        _need(self.allowed_values is None or d.value in self.allowed_values, "the default is not allowed")


@dataclass(frozen=True)
class SignalRef:
    source_node_id: str
    output_name: str

    def __post_init__(self):
        _name(self.source_node_id, "node")
        _name(self.output_name, "output")


@dataclass(frozen=True)
class OperatorRef:
    name: str
    version: str = "1.0.0"


@dataclass(frozen=True)
class EvidenceRequest:
    source: SignalRef
    field: str
    alias: str | None = None
    required: bool = True


@dataclass(frozen=True)
class CatalogNode:
    kind: str
    node_id: str
    catalog_ref: str
    version: str = "0.1.0"
    inputs: dict[str, SignalRef] = field(default_factory=dict)
    parameters: dict[str, TypedValue | ParameterRef] = field(default_factory=dict)

    def __post_init__(self):
        _need(self.kind in ("primitive", "relation"), f"unknown kind {self.kind}")
        _name(self.node_id, "node")


@dataclass(frozen=True)
class PredicateNode:
    node_id: str
    input: SignalRef
    operator: OperatorRef
    kind: str = "predicate"
    compare: TypedValue | ParameterRef | None = None
    duration: TypedValue | ParameterRef | None = None
    required_cardinality: str | None = None
    required_entity_scope: str | None = None

    def __post_init__(self):
        _need(self.kind == "predicate", f"unknown kind {self.kind}")
        _name(self.node_id, "node")


@dataclass(frozen=True)
class ClassificationRule:
    label: str
    predicate_ids: list[str]
    description: str = ""

    def __post_init__(self):
        _need(bool(_LABEL.fullmatch(self.label)), f"{self.label!r} is no label")
        _need(bool(self.predicate_ids), "a rule needs a predicate")


@dataclass(frozen=True)
class ComplexityLimits:
    max_plan_nodes: int = 40
    max_nesting_depth: int = 8
    max_temporal_horizon_seconds: float = 15.0
    max_returned_moments: int = 100
    max_relations_per_anchor: int = 1000
    max_execution_cost: int = 100_000


#: What a host allows at most.
CEILINGS = ComplexityLimits(40, 12, 15.0, 500, 1000, 100_000)


@dataclass(frozen=True)
class DraftPlan:
    plan_id: str
    plan_version: str
    recipe_id: str
    recipe_version: str
    nodes: list[CatalogNode | PredicateNode]
    classification_rules: list[ClassificationRule]
    status: str = "experimental"
    unknown_evidence_policy: str | None = "exclude_candidate"
    classification_mode: str = "exhaustive"
    anchor_source: SignalRef | None = None
    requested_evidence: list[EvidenceRequest] = field(default_factory=list)
    complexity_limits: ComplexityLimits = ComplexityLimits()
    schema_version: str = "1.0"

    def __post_init__(self):
        _name(self.plan_id, "plan")
        _need(bool(self.nodes) and bool(self.classification_rules), "a plan needs nodes and rules")
        _need(self.status in ("approved", "experimental"), f"unknown status {self.status}")


@dataclass(frozen=True)
class Recipe:
    recipe_id: str
    recipe_version: str
    display_name: str
    description: str
    output_classifications: list[str]
    parameters: list[ParameterDefinition] = field(default_factory=list)
    default_unknown_evidence_policy: str = "exclude_candidate"
    allowed_claims: list[str] = field(default_factory=list)
    disallowed_claims: list[str] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)
    schema_version: str = "1.0"

    def __post_init__(self):
        _name(self.recipe_id, "recipe")
        names = [p.name for p in self.parameters]
        _need(len(set(names)) == len(names), "parameter names must be unique")
        _need(bool(self.output_classifications), "a recipe needs labels")


@dataclass(frozen=True)
class Invocation:
    invocation_id: str
    match_ids: list[str]
    periods: list[str]
    perspective_team_role: str
    max_results: int
    parameters: dict[str, TypedValue] = field(default_factory=dict)
    execution_mode: str = "bind_only"
    schema_version: str = "1.0"

    def __post_init__(self):
        _name(self.invocation_id, "invocation")
        _need(bool(self.match_ids) and len(set(self.match_ids)) == len(self.match_ids), "match_ids must be unique and not empty")
        _need(bool(self.periods) and set(self.periods) <= set(PERIODS), "unknown period")
        _need(self.perspective_team_role in ("home", "away"), "unknown team role")
        _need(1 <= self.max_results <= 500, "max_results must be 1 to 500")
        _need(self.execution_mode in MODES, "unknown execution mode")


@dataclass(frozen=True)
class Target:
    target_id: str
    match_id: str
    period: str
    approximate_time_ms: int
    search_radius_ms: int


@dataclass(frozen=True)
class Document:
    recipe: Recipe
    default_invocation: Invocation
    draft_plan: DraftPlan
    schema_version: str = "1.0"

    @staticmethod
    def from_json(text: str) -> Document:
        return build(Document, json.loads(text))

    def to_json(self) -> str:
        return json.dumps(plain(self), sort_keys=True)


def plain(value: Any) -> Any:
    """Nested dicts and lists of a dataclass."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


def build(kind: Any, value: Any) -> Any:
    """A dataclass from plain data; unknown and missing keys are errors."""
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        options = typing.get_args(kind)
        if value is None and type(None) in options:
            return None
        options = [o for o in options if o is not type(None)]
        if isinstance(value, dict) and len(options) > 1:
            for o in options:  # told apart by their keys
                names = {f.name for f in dataclasses.fields(o)} if dataclasses.is_dataclass(o) else set()
                need = {f.name for f in dataclasses.fields(o) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING} if names else set()
                if need <= set(value) <= names:
                    return build(o, value)
            raise DocumentError(f"{value!r} fits none of {[o.__name__ for o in options]}")
        return build(options[0], value)
    if origin is list:
        _need(isinstance(value, list), f"{value!r} is no list")
        return [build(typing.get_args(kind)[0], v) for v in value]
    if origin is dict:
        _need(isinstance(value, dict), f"{value!r} is no mapping")
        return {k: build(typing.get_args(kind)[1], v) for k, v in value.items()}
    if dataclasses.is_dataclass(kind):
        _need(isinstance(value, dict), f"{value!r} is no {kind.__name__}")
        hints = typing.get_type_hints(kind)
        extra = set(value) - set(hints)
        _need(not extra, f"{kind.__name__} has no {sorted(extra)}")
        try:
            return kind(**{k: build(hints[k], v) for k, v in value.items()})
        except TypeError as e:
            raise DocumentError(str(e)) from e
    return value


def identity(value: Any) -> str:
    return stable_hash(plain(value))
