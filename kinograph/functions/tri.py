"""Tri-state logic: PASS, FAIL and UNKNOWN as strings, true, false and null as booleans.

UNKNOWN is never FALSE: a missing measurement decides nothing. Statuses are
decided by cascades, in which the first condition that holds wins; a null
condition doesn't hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, FAIL, UNKNOWN = "PASS", "FAIL", "UNKNOWN"

Step = tuple[Column, str, str]


def cascade(steps: Sequence[Step], status: str, reason: str) -> tuple[Column, Column]:
    """Status and reason of the first step (condition, status, reason) that holds, or else those given."""
    s = r = None
    for condition, a, b in steps:
        s = F.when(condition, F.lit(a)) if s is None else s.when(condition, F.lit(a))
        r = F.when(condition, F.lit(b)) if r is None else r.when(condition, F.lit(b))
    if s is None:
        return F.lit(status), F.lit(reason)
    return s.otherwise(F.lit(status)), r.otherwise(F.lit(reason))


def status(value: Column) -> Column:
    """PASS, FAIL or UNKNOWN of a nullable boolean."""
    return F.when(value, F.lit(PASS)).when(~value, F.lit(FAIL)).otherwise(F.lit(UNKNOWN))


def truth(of: Column) -> Column:
    """The nullable boolean of a status."""
    return F.when(of == PASS, F.lit(True)).when(of == FAIL, F.lit(False))


def negated(of: Column) -> Column:
    """PASS and FAIL exchanged."""
    return F.when(of == PASS, F.lit(FAIL)).when(of == FAIL, F.lit(PASS)).otherwise(of)


def known(x: Column) -> Column:
    """NaN as null, so that no comparison with it holds."""
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def all_of(statuses: Sequence[Column]) -> Column:
    """FAIL if any is, else UNKNOWN if any is, else PASS."""
    fail = unknown = F.lit(False)
    for s in statuses:
        fail, unknown = fail | (s == FAIL), unknown | F.coalesce(s == UNKNOWN, F.lit(True))
    return F.when(fail, F.lit(FAIL)).when(unknown, F.lit(UNKNOWN)).otherwise(F.lit(PASS))


def frames_rounded(seconds: float, rate: float) -> int:
    """Frames of a duration, ties to even."""
    return int(round(seconds * rate))


def frames_up(seconds: float, rate: float) -> int:
    """Frames of a duration, rounded up but for a rounding error."""
    import math

    return math.ceil(seconds * rate - 1e-9)
