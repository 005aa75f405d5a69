"""From anchors and predicate traces to results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import anchor_id, result_id
from ..functions.tri import FAIL, UNKNOWN
from ..sources.tables import ANCHOR, KEYS

#: Frames of one bucket in which intervals and anchors meet.
BUCKET = 256


def extracted(anchors: DataFrame) -> DataFrame:
    """One row for each anchor: ids derived anew, the first of equal ones kept."""
    refs = F.col("entity_refs") if "entity_refs" in anchors.columns else None
    a = anchors.withColumn("anchor_id", F.coalesce("anchor_id", anchor_id(refs=refs)))
    w = Window.partitionBy(*ANCHOR).orderBy("anchor_frame_id", "start_frame_id", "end_frame_id")
    return a.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def trace(anchors: DataFrame, predicate_id: str, evaluations: DataFrame) -> DataFrame:
    """The status of a predicate for each anchor; UNKNOWN where it has none. Matched by anchor_id alone."""
    e = evaluations.groupBy(*ANCHOR).agg(F.min_by(F.struct(F.col("predicate_status").alias("s"), F.col("predicate_value").alias("v")), F.col("anchor_frame_id") if "anchor_frame_id" in evaluations.columns else F.lit(0)).alias("_e"))
    out = anchors.select(*ANCHOR, "anchor_frame_id").join(e, list(ANCHOR), "left")
    return out.select(*ANCHOR, "anchor_frame_id", F.lit(predicate_id).alias("predicate_id"), F.coalesce(F.col("_e.s"), F.lit(UNKNOWN)).alias("predicate_status"), F.col("_e.v").alias("predicate_value"))


def interval_trace(anchors: DataFrame, predicate_id: str, intervals: DataFrame) -> DataFrame:
    """The status of the interval that covers an anchor's frame; UNKNOWN where none does.

    Both sides meet in buckets of BUCKET frames: an interval has a row for each
    bucket that it touches, an anchor one.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    spread = intervals.select(*KEYS, "predicate_status", "start_frame_id", "end_frame_id", F.explode(F.sequence(bucket("start_frame_id"), bucket("end_frame_id"))).alias("_b"))
    own = anchors.select(*ANCHOR, "anchor_frame_id")
    at = own.withColumn("_b", bucket("anchor_frame_id")).join(spread, [*KEYS, "_b"]).where(F.col("anchor_frame_id").between(F.col("start_frame_id"), F.col("end_frame_id")))
    at = at.groupBy(*ANCHOR).agg(F.min("predicate_status").alias("s"))
    out = own.join(at, list(ANCHOR), "left")
    return out.select(*ANCHOR, "anchor_frame_id", F.lit(predicate_id).alias("predicate_id"), F.coalesce("s", F.lit(UNKNOWN)).alias("predicate_status"), F.lit(None).cast("string").alias("predicate_value"))


def statuses(traces: DataFrame) -> DataFrame:
    """For each anchor a map from predicate to status."""
    return traces.groupBy(*ANCHOR).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("predicate_id", "predicate_status")))).alias("predicate_statuses"))


def classify(anchors: DataFrame, traces: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], unknown_policy: str = "exclude_candidate") -> DataFrame:
    """The label of each anchor: the rule that matches and names most predicates, the first declared of equals.

    A rule matches if none of its predicates fails, and none is UNKNOWN unless
    the policy includes with a warning. Anchors that match none are left out.
    """
    warn = unknown_policy == "include_with_warning"
    a = anchors.join(statuses(traces), list(ANCHOR), "left")
    of = lambda p: F.coalesce(F.col("predicate_statuses")[p], F.lit(UNKNOWN))

    def matches(ids: Sequence[str]) -> tuple[Column, Column]:
        fail = unknown = F.lit(False)
        for p in ids:
            fail, unknown = fail | (of(p) == FAIL), unknown | (of(p) == UNKNOWN)
        return ~fail & (F.lit(True) if warn else ~unknown), ~fail & unknown

    ordered = [r for _, r in sorted(enumerate(rules), key=lambda x: (-len(x[1][1]), x[0]))]
    found = [(label, *matches(ids)) for label, ids in ordered]
    a = a.withColumns({
        "matched_labels": F.array_compact(F.array(*[F.when(m, F.lit(label)) for label, m, _ in found])), "has_unknown_evidence": F.coalesce(*[F.when(m, u) for _, m, u in found], F.lit(False)),
        "unknown_candidate": F.greatest(*[u.cast("int") for _, _, u in found], F.lit(0)) == 1,
    })
    a = a.withColumn("classification", F.get("matched_labels", F.lit(0)))
    if unknown_policy == "invalidate_execution":
        return a
    return a.where("classification is not null")


def witnesses(anchors: DataFrame, traces: Sequence[DataFrame] = (), evaluations: DataFrame | None = None, outputs: Sequence[DataFrame] = ()) -> DataFrame:
    """match_id, period, anchor_id and relation_id: which relation of an anchor its evidence is taken from.

    The first source that has one decides: the witness_relation_id of predicates over the requested output (in the plan's order), then
    that of the node's evaluations of the anchor, then the relation_id of outputs that chose one (classification, entry status). In a source the
    earliest frame counts, then the least id. Anchors without any are left out.
    """
    found = None
    sources = [*[(t, "witness_relation_id") for t in traces], *([(evaluations, "witness_relation_id")] if evaluations is not None else []), *[(o, "relation_id") for o in outputs]]
    for k, (df, field) in enumerate(sources):
        if field not in df.columns:
            continue
        at = F.col("anchor_frame_id").cast("long") if "anchor_frame_id" in df.columns else F.lit(0).cast("long")
        rows = df.where(F.col(field).isNotNull()).select(*ANCHOR, F.struct(F.lit(k).alias("k"), at.alias("at"), F.col(field).cast("string").alias("relation_id")).alias("_w"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return anchors.select(*ANCHOR, F.lit(None).cast("string").alias("relation_id")).where("false")
    least = found.groupBy(*ANCHOR).agg(F.min("_w").alias("_w"))
    return least.join(anchors.select(*ANCHOR).distinct(), list(ANCHOR), "left_semi").select(*ANCHOR, F.col("_w.relation_id").alias("relation_id"))


def project(results: DataFrame, evidence: Sequence[tuple]) -> DataFrame:
    """results with the requested evidence: (evaluations, field, alias, required[, witness]); evidence_missing counts required fields that are null.

    Of an anchor's records the first by frame counts. witness: match_id, period, anchor_id, relation_id; records of another relation than
    the anchor's are passed over, those without a relation are not. A signal of frames (no anchor_id) gives its value at the anchor's frame.
    """
    missing = F.lit(0)
    for df, field, alias, required, *witness in evidence:
        results = results.drop(alias)
        if "anchor_id" not in df.columns:
            one = df.groupBy(*KEYS, F.col("frame_id").alias("anchor_frame_id")).agg(F.first(field).alias(alias))
            results = results.join(one, [*KEYS, "anchor_frame_id"], "left")
        else:
            order = [F.col("anchor_frame_id") if "anchor_frame_id" in df.columns else F.lit(0)]
            if "relation_id" in df.columns:
                order.append(F.col("relation_id"))
                if witness and witness[0] is not None:
                    of = witness[0].select(*ANCHOR, F.col("relation_id").alias("_chosen"))
                    df = df.join(of, list(ANCHOR), "left").where(F.col("_chosen").isNull() | F.col("relation_id").isNull() | (F.col("relation_id").cast("string") == F.col("_chosen")))
            one = df.groupBy(*ANCHOR).agg(F.min_by(F.struct(F.col(field).alias("v")), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_v"))
            results = results.join(one.select(*ANCHOR, F.col("_v.v").alias(alias)), list(ANCHOR), "left")
        if required:
            missing = missing + F.when(F.col(alias).isNull(), 1).otherwise(0)
    return results.withColumn("evidence_missing", missing)


def ordered(results: DataFrame, match_ids: Sequence[str] | None, plan_hash: str, max_results: int) -> DataFrame:
    """The first results: by the invocation's order of matches, then period, frame, label and id."""
    r = results.withColumn("result_id", result_id(plan_hash))
    if match_ids:
        places = r.sparkSession.createDataFrame([(m, i) for i, m in enumerate(dict.fromkeys(match_ids))], "match_id string, _m int")
        r = r.join(places, "match_id", "left")
    else:
        r = r.withColumn("_m", F.lit(0))
    return r.orderBy("_m", *KEYS, "anchor_frame_id", "classification", "anchor_id").limit(max_results).drop("_m")


def limited_relations(episodes: DataFrame, most: int, node_id: str) -> DataFrame:
    """episodes; reading one of an anchor that has more than the plan allows is an error."""
    n = F.count("*").over(Window.partitionBy(*ANCHOR))
    said = F.concat(F.lit(f"{node_id} exceeded max_relations_per_anchor={most}: anchor "), F.col("anchor_id"), F.lit(" has "), F.col("_n").cast("string"))
    return episodes.withColumn("_n", n).where(F.when(F.col("_n") > most, F.raise_error(said).cast("boolean")).otherwise(True)).drop("_n")


def limited_counts(evaluations: DataFrame, most: int, node_id: str) -> DataFrame:
    """evaluations; reading one with a relation_count beyond what the plan allows is an error."""
    if "relation_count" not in evaluations.columns:
        return evaluations
    said = F.concat(F.lit(f"{node_id} exceeded max_relations_per_anchor={most}: anchor "), F.col("anchor_id"), F.lit(" has "), F.col("relation_count").cast("string"))
    return evaluations.where(F.when(F.col("relation_count") > most, F.raise_error(said).cast("boolean")).otherwise(True))


#: Labels of the proof's second pick.
NOT_SWITCHED = ("RETAINED_NO_SWITCH", "LOST_BEFORE_SWITCH")


def proof_selection(results: DataFrame, overall: int = 16, per_match: int = 5, order: Sequence[str] = ("match_id", "period", "anchor_frame_id", "anchor_id"), shown: Sequence[str] = ("match_id", "period", "anchor_frame_id", "anchor_id")) -> DataFrame:
    """A small set to show: the first two switched ones of all, then the first two that were retained or lost, then all in order, at most per_match of a match and overall in sum; given in the order of `shown`.

    Taking one after the other while neither limit is reached is the same as the first per_match of each match, in that order, and the
    first overall of these. Of rows with one result_id the first counts. The picks at the front are four rows; a match's rows
    are cut to the limit before they are shuffled.
    """
    r = results if "result_id" in results.columns else results.withColumn("result_id", F.concat_ws(":", *ANCHOR))
    w = Window.partitionBy("result_id").orderBy(*order)
    r = r.withColumn("_one", F.row_number().over(w)).where("_one = 1").drop("_one")
    kinds = [F.col("classification") == "SWITCHED", F.col("classification").isin(*NOT_SWITCHED)]
    front = None
    for k, kind in enumerate(kinds):
        two = r.where(kind).orderBy(*order).limit(2).select("result_id", F.lit(k).alias("_front"))
        front = two if front is None else front.unionByName(two)
    r = r.join(F.broadcast(front), "result_id", "left").withColumn("_front", F.coalesce("_front", F.lit(len(kinds))))
    of = Window.partitionBy("match_id").orderBy("_front", *order)
    r = r.withColumn("_k", F.row_number().over(of)).where(F.col("_k") <= per_match)
    r = r.orderBy("_front", *order).limit(overall).drop("_front", "_k")
    return (r if "result_id" in results.columns else r.drop("result_id")).orderBy(*shown)


def inspect_target(anchors: DataFrame, traces: DataFrame, results: DataFrame, match_id: str, period: str, time_ms: int, radius_ms: int, frames: DataFrame, frame_rate_hz: int = 25) -> DataFrame:
    """The anchor nearest to a time within a radius: MATCH, NON_MATCH or NO_COMPATIBLE_ANCHOR, with its traces.

    Times count from the first of the period's frames (match_id, period, frame_id).
    """
    spark = anchors.sparkSession
    here = lambda df: df.where((F.col("match_id") == match_id) & (F.col("period") == period))
    first = here(frames).groupBy(*KEYS).agg(F.min("frame_id").alias("_first"))
    ms = (F.col("anchor_frame_id") - F.col("_first")) * (1000.0 / frame_rate_hz)
    near = here(anchors).join(first, list(KEYS)).where(F.abs(ms - time_ms) <= radius_ms).select(*ANCHOR, "anchor_frame_id", F.abs(ms - time_ms).alias("distance_ms"))
    near = near.orderBy("distance_ms", "anchor_frame_id", "anchor_id").limit(1)
    hit = near.join(results.select(*ANCHOR, "classification").distinct(), list(ANCHOR), "left").join(statuses(traces), list(ANCHOR), "left")
    hit = hit.withColumn("target_status", F.when(F.col("classification").isNotNull(), "MATCH").otherwise("NON_MATCH"))
    one = spark.range(1).select(F.lit(1).alias("_one"))
    return one.join(hit.withColumn("_one", F.lit(1)), "_one", "left").drop("_one").withColumn("target_status", F.coalesce("target_status", F.lit("NO_COMPATIBLE_ANCHOR")))


