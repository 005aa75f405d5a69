"""Ids that follow from content."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The form of the JSON, and of the hash, that ids are made from.


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def stable_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def anchor_id(match_id="match_id", period="period", anchor="anchor_frame_id", start="start_frame_id", end="end_frame_id", refs: Column | None = None) -> Column:
    """The first 16 hex digits of the SHA-256 of the anchor's canonical JSON."""
    refs = F.sort_array(refs) if refs is not None else F.array().cast("array<string>")
    fields = F.struct(
        F.col(anchor).alias("anchor_frame_id"), F.col(end).alias("end_frame_id"), refs.alias("entity_refs"), F.col(match_id).alias("match_id"), F.col(period).alias("period"), F.col(start).alias("start_frame_id")
    )
    return F.substring(F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256), 1, 16)


def result_id(plan_hash: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(plan_hash), F.lit("generic"), "match_id", "period", "anchor_id"), 256), 1, 16)
