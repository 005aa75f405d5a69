"""The canonical tables and the views that operators read them through."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import versions
from .shared import cut

KEYS = ("match_id", "period")

#: The schemas of the canonical tables.
SCHEMAS = {
    "matches": "match_id STRING, competition_id STRING, competition_name STRING, season STRING, match_day STRING, match_title STRING, kickoff_time_utc STRING, result STRING, pitch_length_m DOUBLE, pitch_width_m DOUBLE",
    "teams": "match_id STRING, team_id STRING, team_name STRING, team_role STRING, floodlight_key STRING",
    "players": "match_id STRING, team_id STRING, team_role STRING, player_id STRING, shirt_number INT, first_name STRING, last_name STRING, short_name STRING, playing_position STRING, starting BOOLEAN, is_goalkeeper BOOLEAN",
    "orientation": "match_id STRING, period STRING, team_id STRING, team_role STRING, start_side STRING, attack_x_sign INT, evidence_event_id STRING, source STRING",
    "frames": "match_id STRING, period STRING, frame_id BIGINT, timestamp_utc STRING, analysis_rate_hz INT",
    "positions": "match_id STRING, period STRING, frame_id BIGINT, timestamp_utc STRING, team_id STRING, team_role STRING, entity_id STRING, entity_type STRING, x_m DOUBLE, y_m DOUBLE, source_parser STRING",
    "events": "match_id STRING, period STRING, team_role STRING, row_index INT, event_type STRING, gameclock_seconds DOUBLE, team_id STRING, player_id STRING, outcome DOUBLE, at_x DOUBLE, at_y DOUBLE, to_x DOUBLE, to_y DOUBLE, timestamp STRING, minute DOUBLE, second DOUBLE, qualifier_json STRING, source_parser STRING",
    "ball_state": "match_id STRING, period STRING, frame_id BIGINT, timestamp_utc STRING, possession_team_role STRING, ball_alive BOOLEAN",
}


#: Matches that a plan may name one by one.
LITERALS = 100


PART = "_part"


def dealt_out(df: DataFrame, n: int) -> DataFrame:
    """df dealt out to n partitions by match_id, the number of each row's partition in _part."""
    return df.withColumn(PART, F.pmod(F.hash("match_id"), F.lit(n))).repartitionById(n, F.col(PART))


@dataclass(frozen=True)
class Tables:
    """The canonical tables of all matches; any may be None where no operator of a plan needs it."""

    positions: DataFrame | None = None
    players: DataFrame | None = None
    orientation: DataFrame | None = None
    frames: DataFrame | None = None
    events: DataFrame | None = None
    ball_state: DataFrame | None = None
    matches: DataFrame | None = None
    teams: DataFrame | None = None
    #: The positions once more, where a source has them so: match_id, period, frame_id and entities, an array of team_role, entity_id, entity_type, x_m, y_m.
    framed: DataFrame | None = None
    #: Where framed, frames and events are dealt out by match_id: to how many partitions. Their column _part says which, and is among the keys of what meets them.
    dealt: int | None = None

    @staticmethod
    def read(spark: SparkSession, root: str) -> Tables:
        """All tables under a folder: of its last version, as sources.build publishes them, or where it has none those of its folders; match and period prune partitions."""
        found = versions.version(spark, root)
        if found:
            return Tables(**{name: versions.table(spark, root, name, ddl, found) for name, ddl in SCHEMAS.items()})
        return Tables(**{name: spark.read.schema(ddl).parquet(f"{root}/{name}") for name, ddl in SCHEMAS.items()})

    def only(self, match_ids: list[str], periods: list[str]) -> Tables:
        def cut(df: DataFrame | None) -> DataFrame | None:
            if df is None:
                return None
            if len(match_ids) > LITERALS:  # a table of them, so that the plan doesn't grow with their number
                wanted = df.sparkSession.createDataFrame([(m,) for m in set(match_ids)], "match_id string")
                df = df.join(wanted, "match_id", "left_semi")
            else:
                df = df.where(F.col("match_id").isin(match_ids))
            return df.where(F.col("period").isin(periods)) if "period" in df.columns else df

        return replace(self, **{name: cut(getattr(self, name)) for name in (*SCHEMAS, "framed")})


@dataclass(frozen=True)
class Scope:
    """What a query looks at: the tables, whose side it takes, and the host's parameters."""

    tables: Tables
    perspective: str = "home"
    analysis_rate_hz: int = 5
    frame_rate_hz: int = 25
    minimum_possession_seconds: float = 5.0
    maximum_analysis_gap_ms: float = 250.0
    minimum_outfield_players_per_team: int = 9
    #: Parameters of the recipe, by name, for operators that take them from there.
    recipe: Mapping[str, float] = field(default_factory=dict)
    #: The analysis stream, where it was written once for many readers.
    samples: DataFrame | None = None

    @property
    def defending(self) -> str:
        return "away" if self.perspective == "home" else "home"

    @property
    def stride(self) -> int:
        if self.frame_rate_hz % self.analysis_rate_hz:
            raise ValueError("the analysis rate must divide the frame rate")
        return self.frame_rate_hz // self.analysis_rate_hz

    def players(self, role: str | None = None, outfield: bool = True) -> DataFrame:
        """match_id, period, frame_id, player_id, team_role, x_m, y_m. outfield: only players who are known not to keep goal."""
        rows = self.tables.positions.where("entity_type = 'player'")
        if role:
            rows = rows.where(F.col("team_role") == role)
        rows = rows.select(*KEYS, "frame_id", F.col("entity_id").alias("player_id"), "team_role", "x_m", "y_m")
        if not outfield:
            return rows
        keep = self.tables.players.where("is_goalkeeper = false").select("match_id", "player_id").distinct()
        return rows.join(keep, ["match_id", "player_id"], "left_semi")

    def ball(self) -> DataFrame:
        """match_id, period, frame_id, ball_x, ball_y. Never broadcast: a ball for each frame, however small its table looks to the optimizer."""
        return self.tables.positions.where("entity_type = 'ball'").select(*KEYS, "frame_id", F.col("x_m").alias("ball_x"), F.col("y_m").alias("ball_y")).hint("merge")

    def gathered(self, wanted: DataFrame, role: str | None = None) -> DataFrame:
        """For each of the frames in wanted (match_id, period, frame_id, no two the same) that has outfield players, one row with all of them, _ps: player_id, team_role, x_m, y_m."""
        rows = self.players(role).join(wanted.hint("merge"), [*KEYS, "frame_id"], "left_semi")  # other frames aren't grouped
        return rows.groupBy(*KEYS, "frame_id").agg(F.collect_list(F.struct("player_id", "team_role", "x_m", "y_m")).alias("_ps")).hint("merge")

    @property
    def place(self) -> list[str]:
        """The column that tells partitions of tables that are dealt out by match."""
        return [PART] if self.tables.dealt else []

    def dealt(self, df: DataFrame) -> DataFrame:
        """df, few rows beside positions, dealt out as the tables are: what is made from it meets them where they lie, and positions aren't sent around."""
        return dealt_out(df, self.tables.dealt) if self.tables.dealt and PART not in df.columns else df

    def gatherings(self, wanted: DataFrame | None = None) -> DataFrame:
        """match_id, period, frame_id, _es: all players and balls at the frame (team_role, entity_id, entity_type, x_m, y_m). wanted: the frames, no two the same, that positions are cut to before they are grouped."""
        if self.tables.framed is not None:
            return self.tables.framed.select(*self.place, *KEYS, "frame_id", F.col("entities").alias("_es"))
        rows = self.tables.positions.where("entity_type in ('player', 'ball')")
        if wanted is not None:
            rows = rows.join(wanted, [*KEYS, "frame_id"], "left_semi")
        return rows.groupBy(*KEYS, "frame_id").agg(F.collect_list(F.struct("team_role", "entity_id", "entity_type", "x_m", "y_m")).alias("_es"))

    def see(self, df: DataFrame) -> DataFrame:
        """df (match_id, period, frame_id) with _es, null where there is nobody. Where frames are kept whole, df is hashed and they pass by unsorted; dealt out before its frames were listed, df isn't sent around either."""
        if self.tables.framed is None:
            return df.hint("merge").join(self.gatherings(df.select(*KEYS, "frame_id").distinct().hint("merge")), [*KEYS, "frame_id"], "left")
        return self.dealt(df).hint("shuffle_hash").join(self.gatherings(), [*KEYS, "frame_id", *self.place], "left")

    def at(self, df: DataFrame, *frames: str) -> Scope:
        """The same scope, where frames are kept whole with the positions of the frames in these columns of df alone, written as a table: for operators that look up places at few frames."""
        if self.tables.framed is None:
            return self
        wanted = self.dealt(df.select(*KEYS, F.explode(F.array(*frames)).alias("frame_id")).where("frame_id is not null").distinct())
        positions = cut(self.see(wanted).select(*KEYS, "frame_id", F.inline("_es")), "positions")
        return replace(self, tables=replace(self.tables, positions=positions, framed=None, dealt=None))

    def entities(self) -> DataFrame:
        """Players by their id and the ball as `ball`."""
        return self.tables.positions.select(*KEYS, "frame_id", F.when(F.col("entity_type") == "ball", "ball").otherwise(F.col("entity_id")).alias("entity_id"), "team_role", "x_m", "y_m")

    def signs(self) -> DataFrame:
        """match_id, period, team_role, sign: x * sign grows towards the goal that the team attacks."""
        return self.tables.orientation.select(*KEYS, "team_role", F.col("attack_x_sign").alias("sign"))

    def sign_of(self, role: str, name: str = "sign") -> DataFrame:
        return self.signs().where(F.col("team_role") == role).select(*KEYS, F.col("sign").alias(name))

    def first_frames(self) -> DataFrame:
        """match_id, period and first_frame_id, where the clock of a period begins."""
        rows = self.tables.frames if self.tables.frames is not None else self.tables.ball_state
        return rows.groupBy(*KEYS).agg(F.min("frame_id").alias("first_frame_id"))

    def timed(self, df: DataFrame, **frames: str) -> DataFrame:
        """df with the match time in ms, by name, of the frames in these columns: from the first frame of the period."""
        out = df.drop("first_frame_id").join(self.first_frames(), list(KEYS), "left")
        ms = {name: F.round((F.col(c) - F.col("first_frame_id")) / self.frame_rate_hz * 1000).cast("long") for name, c in frames.items()}
        return out.withColumns(ms).drop("first_frame_id")

    def last_frames(self) -> DataFrame:
        return self.tables.frames.groupBy(*KEYS).agg(F.max("frame_id").alias("last_frame_id"))

    def stream(self, step: int | None = None, ball: bool = True) -> DataFrame:
        """The analysis stream: every step-th frame with a ball state, numbered by idx within match and period.

        role, alive, ball_x and ball_y (null where the ball has no row). Not ball: without the last two, so that positions aren't read.
        """
        step = step or self.stride
        if self.samples is not None and step == self.stride:
            return self.samples if ball else self.samples.drop("ball_x", "ball_y")
        rows = self.tables.ball_state.select(*KEYS, "frame_id", F.col("possession_team_role").alias("role"), F.coalesce("ball_alive", F.lit(False)).alias("alive"))
        w = Window.partitionBy(*KEYS).orderBy("frame_id")
        rows = rows.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % step == 0).withColumn("idx", (F.col("_n") / step).cast("long")).drop("_n")
        if step == self.stride:
            rows = self._gated(rows, w)
        if not ball:
            return rows
        if self.tables.positions is None:
            return rows.withColumn("ball_x", F.lit(None).cast("double")).withColumn("ball_y", F.lit(None).cast("double"))
        return rows.join(self.ball(), [*KEYS, "frame_id"], "left")

    def sampled(self) -> Scope:
        """The same scope, its analysis stream written as a table: for compositions that read it many times."""
        return self if self.samples is not None else replace(self, samples=cut(self.stream(), "samples"))

    def _gated(self, rows: DataFrame, w) -> DataFrame:
        """The stream's rows; reading one that stands more than the maximum gap behind the row before is an error."""
        gap = (F.col("frame_id") - F.lag("frame_id").over(w)) * 1000.0 / self.frame_rate_hz
        said = F.concat(F.lit("gap in the analysis stream: "), F.concat_ws(" ", *KEYS, F.col("frame_id").cast("string")))
        return rows.withColumn("_gap", gap).where(F.when(F.col("_gap") > self.maximum_analysis_gap_ms, F.raise_error(said).cast("boolean")).otherwise(True)).drop("_gap")


ANCHOR = (*KEYS, "anchor_id")


def attach(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """anchors with the columns of found (one row for each anchor at most), which replace those of the same name."""
    new = [c for c in found.columns if c not in ANCHOR]
    return anchors.drop(*new).join(found, list(ANCHOR), "left")


def put(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns(cols)


def frame_of(anchors: DataFrame, field: str) -> Column:
    """The frame to look at: the field, or the anchor's own where there is none."""
    own = F.col("anchor_frame_id")
    return F.coalesce(F.col(field), own) if field != "anchor_frame_id" and field in anchors.columns else own


def located(scope: Scope, anchors: DataFrame, frame: str, id_col: Column | str, name: str) -> DataFrame:
    """anchors with {name}_x, {name}_y and {name}_role of an entity (an id column, or `ball`) at the frame in column `frame`."""
    found = scope.entities().select(*KEYS, F.col("frame_id").alias(frame), F.col("entity_id").alias("_e"), F.col("x_m").alias(f"{name}_x"), F.col("y_m").alias(f"{name}_y"), F.col("team_role").alias(f"{name}_role")).hint("merge")  # tracking is never broadcast, however small its files look
    anchors = anchors.drop(f"{name}_x", f"{name}_y", f"{name}_role")
    e = F.lit("ball") if isinstance(id_col, str) and id_col == "ball" else (F.col(id_col) if isinstance(id_col, str) else id_col)
    return anchors.withColumn("_e", e).join(found, [*KEYS, frame, "_e"], "left").drop("_e")
