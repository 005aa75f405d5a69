"""The host's tools: capabilities, recipes, and plans from submission to inspection.

Handles are JSON files in a folder, named by hashes of what they hold. A plan is
submitted, validated, confirmed by a human, executed and inspected; results are
Parquet tables keyed by the bound plan, so the same query isn't run again.
"""

from __future__ import annotations

import json
import os
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import stable_hash
from ..operators import emission
from ..sources.build import replay_window
from ..sources.tables import Tables
from .bind import BindError, BoundPlan, bind, check_model_authored
from .catalog import OPERATORS, Entry, catalog
from .compile import Execution, compile_plan
from .types import Document, DocumentError, plain

VERSION = "1"


class Host:
    """Tools over one set of tables. root: a folder of the host for handles; results: a folder that Spark can write."""

    def __init__(self, spark: SparkSession, tables: Tables, root: str, results: str, data_hash: str = ""):
        self.spark, self.tables, self.root, self.results, self.data_hash = spark, tables, root, results.rstrip("/"), data_hash
        self._runs: dict[str, Execution] = {}

    # Handles

    def _put(self, kind: str, handle: str, value: Any) -> str:
        os.makedirs(f"{self.root}/{kind}", exist_ok=True)
        with open(f"{self.root}/{kind}/{handle}.json", "w", encoding="utf-8") as f:
            json.dump(value, f, sort_keys=True)
        return handle

    def _get(self, kind: str, handle: str) -> Any:
        try:
            with open(f"{self.root}/{kind}/{handle}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError as e:
            raise KeyError(f"no {kind} {handle}") from e

    def _all(self, kind: str) -> list[Any]:
        at = f"{self.root}/{kind}"
        return [self._get(kind, n[:-5]) for n in sorted(os.listdir(at))] if os.path.isdir(at) else []

    # Capabilities and recipes

    @staticmethod
    def list_capabilities() -> list[dict]:
        return [{"kind": e.kind, "name": e.name, "version": e.version, "executable": e.executable} for e in catalog().values()] + [{"kind": "predicate", "name": o.name, "version": o.version, "executable": True} for o in OPERATORS.values()]

    @staticmethod
    def describe_capability(name: str) -> dict:
        found: list[Entry] = [e for e in catalog().values() if e.name == name]
        if found:
            e = found[0]
            return {"kind": e.kind, "name": e.name, "version": e.version, "inputs": plain(list(e.inputs)), "outputs": plain(list(e.outputs)), "parameters": plain(list(e.parameters))}
        if name in OPERATORS:
            return {"kind": "predicate"} | plain(OPERATORS[name])
        raise KeyError(name)

    def save_recipe(self, document: Document) -> str:
        return self._put("recipes", f"{document.recipe.recipe_id}_{document.recipe.recipe_version}".replace(".", "_"), plain(document))

    def search_recipes(self, text: str) -> list[dict]:
        """Recipes by how many of the words their name and description hold."""
        words = text.lower().split()
        scored = []
        for d in self._all("recipes"):
            r = d["recipe"]
            hay = f"{r['recipe_id']} {r['display_name']} {r['description']}".lower()
            if hits := sum(w in hay for w in words):
                scored.append((-hits, r["recipe_id"], r["recipe_version"], r))
        return [{"recipe_id": i, "recipe_version": v, "display_name": r["display_name"], "score": -s} for s, i, v, r in sorted(scored, key=lambda x: x[:3])]

    # From submission to execution

    def submit(self, text: str) -> dict:
        """A draft; refused at once if it can't be read."""
        try:
            doc = Document.from_json(text)
        except (DocumentError, json.JSONDecodeError) as e:
            return {"status": "rejected", "message": str(e)}
        return {"status": "submitted", "draft_id": self._put("draft-plans", f"draft_{stable_hash(plain(doc))[:16]}", plain(doc))}

    def _document(self, draft_id: str) -> Document:
        return Document.from_json(json.dumps(self._get("draft-plans", draft_id)))

    def _bound(self, draft_id: str) -> BoundPlan:
        d = self._document(draft_id)
        return bind(d.recipe, d.default_invocation, d.draft_plan)

    def validate(self, draft_id: str, model_authored: bool = False) -> dict:
        try:
            bound = self._bound(draft_id)
        except BindError as e:
            return {"status": "invalid", "issues": plain(e.issues)}
        if model_authored and (issues := check_model_authored(bound.draft)):
            return {"status": "invalid", "issues": plain(issues)}
        handle = self._put("bound-plans", f"bound_{bound.bound_plan_hash[:16]}", {"draft_id": draft_id, "plan_hash": bound.plan_hash, "bound_plan_hash": bound.bound_plan_hash})
        return {"status": "valid", "bound_id": handle, "plan_hash": bound.plan_hash, "bound_plan_hash": bound.bound_plan_hash}

    def confirm(self, bound_id: str, confirmed_by: str) -> dict:
        bound = self._get("bound-plans", bound_id)
        handle = f"auth_{bound['bound_plan_hash'][:16]}"
        return {"authorization_id": self._put("authorizations", handle, {"bound_id": bound_id, "confirmed_by": confirmed_by, "at": time.time()})}

    def cache_key(self, bound: BoundPlan) -> str:
        inv = bound.invocation
        return stable_hash([VERSION, self.data_hash, bound.bound_plan_hash, inv.match_ids, inv.periods, plain(bound.parameters), inv.max_results])[:16]

    def cached(self, bound: BoundPlan) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.results}/{self.cache_key(bound)}/_SUCCESS")
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p))

    def execute(self, authorization_id: str) -> dict:
        """Run a confirmed plan, or take its results from before. bind_only and dry_run touch no data."""
        auth = self._get("authorizations", authorization_id)
        bound = self._bound(self._get("bound-plans", auth["bound_id"])["draft_id"])
        mode = bound.invocation.execution_mode
        if mode != "execute":
            return {"status": "not_started" if mode == "bind_only" else "pass", "rows": 0}
        key, hit = self.cache_key(bound), self.cached(bound)
        run = self._runs[key] = compile_plan(bound, self.tables)
        if not hit:
            run.results.write.mode("overwrite").parquet(f"{self.results}/{key}")
        rows = self.spark.read.parquet(f"{self.results}/{key}")
        bad = F.count_if(F.col("evidence_missing") > 0)
        if bound.draft.unknown_evidence_policy == "invalidate_execution":
            bad = bad + F.count_if("unknown_candidate")
        n, missing = rows.agg(F.count("*"), bad).first()
        self._put("executions", f"exec_{key}", {"authorization_id": authorization_id, "key": key})
        return {"status": "incomplete" if missing else "pass", "execution_id": f"exec_{key}", "rows": n, "cached": hit}

    def result(self, execution_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.results}/{self._get('executions', execution_id)['key']}")

    # Inspection

    def _run(self, execution_id: str) -> Execution:
        e = self._get("executions", execution_id)
        if e["key"] not in self._runs:
            self._runs[e["key"]] = compile_plan(self._bound(self._get("bound-plans", self._get("authorizations", e["authorization_id"])["bound_id"])["draft_id"]), self.tables)
        return self._runs[e["key"]]

    def inspect_result(self, execution_id: str, result_id: str) -> dict:
        """A result with the traces of all predicates."""
        row = self.result(execution_id).where(F.col("result_id") == result_id).limit(1).collect()
        if not row:
            raise KeyError(result_id)
        r = row[0].asDict(recursive=True)
        traces = self._run(execution_id).traces.where((F.col("match_id") == r["match_id"]) & (F.col("anchor_id") == r["anchor_id"]))
        return r | {"traces": [t.asDict() for t in traces.orderBy("predicate_id").limit(100).collect()]}

    def explain_non_match(self, execution_id: str, match_id: str, period: str, time_ms: int, radius_ms: int) -> dict:
        run = self._run(execution_id)
        return emission.inspect_target(run.anchors, run.traces, run.results, match_id, period, time_ms, radius_ms, self.tables.frames if self.tables.frames is not None else self.tables.ball_state).first().asDict(recursive=True)

    def replay(self, match_id: str, period: str, start: int, end: int) -> DataFrame:
        return replay_window(self.tables.positions, match_id, period, start, end)

    def feedback(self, execution_id: str, result_id: str, verdict: str, note: str = "") -> str:
        value = {"execution_id": execution_id, "result_id": result_id, "verdict": verdict, "note": note}
        return self._put("feedback", f"feedback_{stable_hash(value)[:16]}", value)

    def compare_versions(self, one: str, other: str) -> DataFrame:
        """Anchors whose label differs between two executions."""
        key = ["match_id", "period", "anchor_id"]
        a, b = self.result(one).select(*key, F.col("classification").alias("before")), self.result(other).select(*key, F.col("classification").alias("after"))
        return a.join(b, key, "full").withColumn("change", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "relabelled").otherwise("same"))
