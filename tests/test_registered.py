"""Registered queries against their SQL in another engine, on the smallest tables."""

import collections
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("KINOGRAPH_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from kinograph.plans import registered  # noqa: E402

#: One of each family here; all of them are compared by the driver.
NAMES = [
    "possession_segment", "transition_regain", "outcome_window_settled", "persists_for_measure", "hysteresis_episodes", "greedy_dedupe", "exists_tristate", "unknown_policy_warn", "rule_emission", "marking", "cover_shadow", "structured_zone",
    "lane_occupancy_duplicates", "local_number", "acceleration", "off_ball_run_type", "space_region_grid", "defensive_line", "line_break", "support_arrival", "corridor_states", "join_episode_sets", "nearest_frame_alignment", "set_piece_structure",
    "time_to_arrival", "pressure", "proof_selection", "witness_evidence", "percentile_summary", "block_shift_recipe", "corridor_episodes", "relation_destination_entry",
]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    df = registered.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = db.execute(registered.ORACLES[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    a = collections.Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    b = collections.Counter(tuple(_norm(r[theirs.index(c)]) for c in cols) for r in cur.fetchall())
    assert a == b and a


def test_every_oracle_has_a_query():
    assert set(registered.ORACLES) <= set(registered.QUERIES)
