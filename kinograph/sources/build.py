"""Raw files to canonical tables, and what is checked on the way.

Tables are Parquet, in folders by build, match and period. A build writes all its
tables and then publishes them at once (versions.py); it replaces the matches that it
has rows of, in every table, and no others. `rebuild` builds only what changed since
the source lock of the last version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import HALF_LENGTH_M, HALF_WIDTH_M
from ..functions.ranks import at_ranks
from . import raw as tracking
from . import versions
from .raw import framesets
from .shared import cut, opened
from .tables import KEYS, SCHEMAS

PARTITIONED = {"positions": ("match_id", "period"), "frames": ("match_id", "period"), "ball_state": ("match_id", "period"), "events": ("match_id", "period")}

BALL_TEAM = "BALL"


def _conformed(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns and types, null where it has none."""
    fields = [part.strip().split(" ") for part in SCHEMAS[table].split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t.lower()).alias(n) for n, t in fields])


def ball_state(sets: DataFrame) -> DataFrame:
    """Possession and whether the ball is in play; whatever isn't the home side's counts as away."""
    b = sets.where(F.col("team_id") == BALL_TEAM)
    return _conformed(b.select(*KEYS, "frame_id", "timestamp_utc", F.when(F.col("possession") == 1, "home").otherwise("away").alias("possession_team_role"), F.coalesce(F.col("status") == 1, F.lit(False)).alias("ball_alive")), "ball_state")


def positions(sets: DataFrame, teams: DataFrame) -> DataFrame:
    """Positions of players and ball. Rows with a missing coordinate don't exist; entities of no team (referees) are left out."""
    roles = teams.select("match_id", "team_id", "team_role")
    p = sets.join(roles, ["match_id", "team_id"], "left").withColumn("entity_type", F.when(F.col("team_id") == BALL_TEAM, "ball").when(F.col("team_role").isNotNull(), "player"))
    ok = F.col("x_m").isNotNull() & F.col("y_m").isNotNull() & ~F.isnan("x_m") & ~F.isnan("y_m")
    p = p.where(ok & F.col("entity_type").isNotNull()).withColumns({"team_role": F.coalesce("team_role", F.lit("ball")), "source_parser": F.lit("xml")})
    return _conformed(p, "positions")


def frames(sets: DataFrame, rate_hz: int = 25) -> DataFrame:
    return _conformed(sets.where(F.col("team_id") == BALL_TEAM).select(*KEYS, "frame_id", "timestamp_utc", F.lit(rate_hz).alias("analysis_rate_hz")), "frames")


def metadata(spark: SparkSession, path: str | Sequence[str]) -> dict[str, DataFrame]:
    """matches, teams and players of match information files. Goalkeepers are told by the position TW; no position leaves it unknown."""
    team = "STRUCT<_TeamId: STRING, _TeamName: STRING, _Role: STRING, Players: STRUCT<Player: ARRAY<STRUCT<_PersonId: STRING, _FirstName: STRING, _LastName: STRING, _Shortname: STRING, _ShirtNumber: INT, _PlayingPosition: STRING, _Starting: BOOLEAN>>>>"
    ddl = f"General STRUCT<_MatchId: STRING, _CompetitionId: STRING, _CompetitionName: STRING, _Season: STRING, _MatchDay: STRING, _MatchTitle: STRING, _KickoffTime: STRING, _Result: STRING>, Environment STRUCT<_PitchX: DOUBLE, _PitchY: DOUBLE>, Teams STRUCT<Team: ARRAY<{team}>>"
    raw = spark.read.format("xml").schema(ddl).option("rowTag", "MatchInformation").load(path)
    g = lambda n: F.col(f"General.{n}")
    matches = raw.select(
        g("_MatchId").alias("match_id"), g("_CompetitionId").alias("competition_id"), g("_CompetitionName").alias("competition_name"), g("_Season").alias("season"), g("_MatchDay").alias("match_day"), g("_MatchTitle").alias("match_title"),
        g("_KickoffTime").alias("kickoff_time_utc"), g("_Result").alias("result"), F.col("Environment._PitchX").alias("pitch_length_m"), F.col("Environment._PitchY").alias("pitch_width_m"),
    )
    t = raw.select(g("_MatchId").alias("match_id"), F.explode("Teams.Team").alias("t"))
    role = F.when(F.lower("t._Role").isin("home", "hometeam"), "home").otherwise("away")
    teams = t.select("match_id", F.col("t._TeamId").alias("team_id"), F.col("t._TeamName").alias("team_name"), role.alias("team_role"))
    p = t.select("match_id", F.col("t._TeamId").alias("team_id"), role.alias("team_role"), F.explode("t.Players.Player").alias("p"))
    players = p.select(
        "match_id", "team_id", "team_role", F.col("p._PersonId").alias("player_id"), F.col("p._ShirtNumber").alias("shirt_number"), F.col("p._FirstName").alias("first_name"), F.col("p._LastName").alias("last_name"), F.col("p._Shortname").alias("short_name"),
        F.col("p._PlayingPosition").alias("playing_position"), F.col("p._Starting").alias("starting"), (F.col("p._PlayingPosition") == "TW").alias("is_goalkeeper"),
    )
    return {"matches": _conformed(matches, "matches"), "teams": _conformed(teams, "teams"), "players": _conformed(players, "players")}


def orientation(events: DataFrame, teams: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """The direction each team attacks in each half, by the first kick-off of it.

    kickoffs: match_id, period, frame order (row_index), team_left (the id of the team that starts on the left), event id.
    """
    first = kickoffs.groupBy(*KEYS).agg(F.min_by(F.struct("team_left", "event_id"), "row_index").alias("k"))
    o = first.join(teams.select("match_id", "team_id", "team_role"), "match_id")
    left = F.col("team_id") == F.col("k.team_left")
    o = o.withColumns({"start_side": F.when(left, "left").otherwise("right"), "attack_x_sign": F.when(left, 1).otherwise(-1), "evidence_event_id": F.col("k.event_id"), "source": F.lit("kick_off")})
    return _conformed(o, "orientation")


def upsert(df: DataFrame, root: str, table: str) -> int:
    """Replace the rows of df's matches in one table; the number of the version."""
    spark = df.sparkSession
    put = versions.store(_conformed(df, table), root, table, versions.new_build(), PARTITIONED.get(table, ("match_id",)))
    return versions.publish(spark, root, put, put)


def _stored(spark: SparkSession, root: str, sets: DataFrame, meta: dict[str, DataFrame], events: DataFrame | None, kickoffs: DataFrame | None) -> DataFrame:
    """All tables under one new build: rows for a manifest. Nothing is visible yet."""
    tables = {**meta, "ball_state": ball_state(sets), "frames": frames(sets), "positions": positions(sets, meta["teams"])}
    if events is not None:
        tables["events"] = _conformed(events, "events")
        if kickoffs is not None:
            tables["orientation"] = orientation(events, meta["teams"], kickoffs)
    build = versions.new_build()
    return reduce(DataFrame.unionByName, [versions.store(df, root, name, build, PARTITIONED.get(name, ("match_id",))) for name, df in tables.items()])


def _everywhere(matches: DataFrame) -> DataFrame:
    """These matches in every table."""
    return matches.select("match_id", F.explode(F.array(*map(F.lit, SCHEMAS))).alias("table"))


def build(spark: SparkSession, raw: dict[str, str], root: str, events: DataFrame | None = None, kickoffs: DataFrame | None = None) -> int:
    """All canonical tables of all matches whose files the paths in raw (tracking, information) match, in one job for each table; the number of the version."""
    put = cut(_stored(spark, root, framesets(spark, raw["tracking"]), metadata(spark, raw["information"]), events, kickoffs), "built")
    return versions.publish(spark, root, put, _everywhere(put.select("match_id").distinct()))


@dataclass(frozen=True)
class Rebuilt:
    """What a rebuild did: its version, the files that differed from the lock, and the matches that were built or removed."""

    version: int | None
    differences: DataFrame
    matches: DataFrame


def rebuild(spark: SparkSession, raw: dict[str, str], root: str, events: DataFrame | None = None, kickoffs: DataFrame | None = None) -> Rebuilt:
    """Build the matches of files that are new, changed or missing since the lock of the last version, and publish them with a new lock.

    A match is built from all its files, those that are as before included; matches that no file is about any more
    are removed. Without a difference nothing is written. Every file is read once for its digest, and only the files of
    such matches once more. The paths of those are collected to the driver, which has to name them to Spark.
    """
    last = versions.version(spark, root)
    found = reduce(DataFrame.unionByName, [source_lock(spark, raw[k]).withColumn("kind", F.lit(k)) for k in ("tracking", "information")])
    now = cut(found, "lock")
    old = spark.read.parquet(last["lock"]) if last and last.get("lock") else now.where("false").withColumn("match_ids", F.array().cast("array<string>"))
    differences = cut(lock_differences(old, now), "differences")
    if differences.isEmpty():
        return Rebuilt(None, differences, spark.createDataFrame([], "match_id string, what string"))
    fresh = differences.where("difference != 'missing'").select("path").join(now.select("path", "kind"), "path")
    paths = lambda df, kind: [r.path for r in df.where(F.col("kind") == kind).select("path").collect()]
    parsed = {k: _about(spark, k, paths(fresh, k)) for k in ("tracking", "information")}
    about = reduce(DataFrame.unionByName, [m for m, _ in parsed.values()])
    before = old.join(differences.select("path"), "path", "left_semi").select(F.explode("match_ids").alias("match_id"))
    touched = cut(before.unionByName(about.select("match_id")).distinct(), "touched")
    same = old.join(differences.select("path"), "path", "left_anti").select("path", "kind", F.explode("match_ids").alias("match_id"))
    besides = cut(same.join(touched, "match_id", "left_semi").select("path", "kind").distinct(), "besides")
    for k in parsed:
        if more := paths(besides, k):
            parsed[k] = (parsed[k][0], [*parsed[k][1], *_about(spark, k, more)[1]])
    here = lambda df: None if df is None else df.join(touched, "match_id", "left_semi")
    sets = reduce(DataFrame.unionByName, map(tracking.frames_of, parsed["tracking"][1])) if parsed["tracking"][1] else _no_frames(spark)
    names = [p for ps in parsed["information"][1] for p in ps]
    meta = metadata(spark, names) if names else {t: spark.createDataFrame([], SCHEMAS[t]) for t in ("matches", "teams", "players")}
    put = cut(_stored(spark, root, here(sets), {t: here(df) for t, df in meta.items()}, here(events), here(kickoffs)), "built")
    by_path = about.groupBy("path").agg(F.array_sort(F.collect_set("match_id")).alias("new"))
    kept = old.select("path", F.col("match_ids").alias("old"))
    lock = now.join(by_path, "path", "left").join(kept, "path", "left").join(differences.select("path", "difference"), "path", "left")
    lock = lock.withColumn("match_ids", F.coalesce(F.when(F.col("difference").isNull(), F.col("old")).otherwise(F.col("new")), F.array().cast("array<string>")))
    path = f"{root}/_manifests/lock-{versions.new_build()}"
    lock.select(*now.columns, "match_ids").write.parquet(path)
    number = versions.publish(spark, root, put, _everywhere(touched), path)
    done = touched.join(put.select("match_id").distinct().withColumn("what", F.lit("built")), "match_id", "left").select("match_id", F.coalesce("what", F.lit("removed")).alias("what"))
    return Rebuilt(number, differences, done)


def _about(spark: SparkSession, kind: str, paths: list[str]) -> tuple[DataFrame, list]:
    """path and match_id of files, and what there is to build from: parsed pieces or paths."""
    if not paths:
        return spark.createDataFrame([], "path string, match_id string"), []
    if kind == "tracking":
        parsed = tracking.pieces(spark, paths)
        return tracking.matches_of(parsed), [parsed]
    general = spark.read.format("xml").schema("General STRUCT<_MatchId: STRING>").option("rowTag", "MatchInformation").load(paths)
    return general.select(tracking.plain_path(F.col("_metadata.file_path")).alias("path"), F.col("General._MatchId").alias("match_id")).where("match_id is not null").distinct(), [paths]


def _no_frames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "match_id string, period string, team_id string, entity_id string, frame_id long, timestamp_utc string, x_m double, y_m double, possession int, status int")


def _digested(batches):
    for batch in batches:
        for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sha256, md5 = hashlib.sha256(), hashlib.md5()
            with opened(path) as f:
                while piece := f.read(1 << 20):
                    sha256.update(piece)
                    md5.update(piece)
            yield pa.RecordBatch.from_pydict({"path": [path], "length": pa.array([length], pa.int64()), "sha256": [sha256.hexdigest()], "md5": [md5.hexdigest()]})


def source_lock(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A manifest of raw files: path, length, SHA-256 and MD5 of the content, of which a task holds 1 MB at a time, whatever the file's size. Empty files are not listed, as for all of Spark's sources."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")  # the content isn't read for these
    return listed.mapInArrow(_digested, "path string, length long, sha256 string, md5 string")


def lock_differences(lock: DataFrame, now: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a manifest."""
    a, b = lock.select("path", F.col("sha256").alias("locked")), now.select("path", F.col("sha256").alias("found"))
    what = F.when(F.col("found").isNull(), "missing").when(F.col("locked").isNull(), "unlocked").when(F.col("found") != F.col("locked"), "changed")
    return a.join(b, "path", "full").withColumn("difference", what).where("difference is not null")


def quality_report(positions: DataFrame, frames: DataFrame, margin_m: float = 5.0) -> DataFrame:
    """Of each match and half: rows by type, bounds of coordinates, rows outside the pitch and far outside, frames with and without a ball."""
    x, y = F.col("x_m"), F.col("y_m")
    out: Column = (F.abs(x) > HALF_LENGTH_M) | (F.abs(y) > HALF_WIDTH_M)
    far: Column = (F.abs(x) > HALF_LENGTH_M + margin_m) | (F.abs(y) > HALF_WIDTH_M + margin_m)
    p = positions.groupBy(*KEYS).agg(
        F.count("*").alias("rows"), F.count_if(F.col("entity_type") == "player").alias("player_rows"), F.count_if(F.col("entity_type") == "ball").alias("ball_rows"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        F.count_if(out).alias("outside_rows"), F.count_if(far).alias("far_outside_rows"),
    )
    f = frames.groupBy(*KEYS).agg(F.count("*").alias("frames"), F.count_distinct("frame_id").alias("distinct_frames"))
    return p.join(f, list(KEYS), "full").withColumn("frame_parity", F.col("frames") == F.col("ball_rows"))


def parity_samples(raw: DataFrame, canonical: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The first, middle and last raw frame of each entity and half against the canonical row: ranks 0, n // 2 and n - 1 of its n frames.

    equal: the coordinates agree, or the raw frame lacks one and there is no canonical row.
    """
    keys = [*KEYS, "entity_id"]
    picks = at_ranks(raw, keys, "frame_id", lambda n: F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2), n - 1)))
    want = picks.select(*keys, F.col("value").alias("frame_id")).distinct().join(raw.select(*keys, "frame_id", F.col("x_m").alias("rx"), F.col("y_m").alias("ry")), [*keys, "frame_id"])
    both = want.join(canonical.select(*keys, "frame_id", "x_m", "y_m"), [*keys, "frame_id"], "left")
    ok = (F.abs(F.col("rx") - F.col("x_m")) <= tolerance) & (F.abs(F.col("ry") - F.col("y_m")) <= tolerance)
    lacks = F.col("rx").isNull() | F.col("ry").isNull() | F.isnan("rx") | F.isnan("ry")
    return both.withColumn("equal", F.when(lacks, F.col("x_m").isNull()).otherwise(F.coalesce(ok, F.lit(False))))


def replay_window(positions: DataFrame, match_id: str, period: str, start: int, end: int) -> DataFrame:
    """The frames of a window with their entities, rounded to millimetres, in the order of role, type and id."""
    w = positions.where((F.col("match_id") == match_id) & (F.col("period") == period) & F.col("frame_id").between(start, end))
    e = F.struct("team_role", "entity_type", "entity_id", F.round("x_m", 3).alias("x_m"), F.round("y_m", 3).alias("y_m"))
    return w.groupBy("frame_id").agg(F.first("timestamp_utc").alias("timestamp_utc"), F.array_sort(F.collect_list(e)).alias("entities")).orderBy("frame_id")


def evidence_bundle(results: DataFrame, positions: DataFrame, path: str, before: int = 50, after: int = 50) -> None:
    """Write the results, and the replay frames around each, for review; one join on frames for all.

    A frame's entities are gathered before it meets the results around it, so that nothing is grouped behind the join.
    The frames' files are compressed (gzip), as neighbouring results repeat them.
    """
    results.write.mode("overwrite").json(f"{path}/results")
    at = results.select(*KEYS, "result_id", F.explode(F.sequence(F.col("anchor_frame_id") - before, F.col("anchor_frame_id") + after)).alias("frame_id")).hint("merge")  # exploded: larger than the optimizer takes it for
    e = F.struct("team_role", "entity_type", "entity_id", F.round("x_m", 3).alias("x_m"), F.round("y_m", 3).alias("y_m"))
    frames = positions.groupBy(*KEYS, "frame_id").agg(F.array_sort(F.collect_list(e)).alias("entities"))
    rows = at.join(frames, [*KEYS, "frame_id"]).select("result_id", "frame_id", "entities")
    rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/replay")
