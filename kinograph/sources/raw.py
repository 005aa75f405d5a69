"""Tracking XML as rows of frames, by a scan that Spark can split anywhere.

A tracking file has one FrameSet for each entity and half, and in it a Frame for
each moment. The file is read as text that is cut at `<Frame`, so a piece is the
start of a FrameSet or one Frame and no row is longer. Splits of a file are read
side by side; a frame's set is the last one that began before it, in its own split
or else in an earlier split of the same file.

Pieces are parsed once and written as a table in the shared folder. Of each split
only the starts of its sets are gathered, a few for each 128 MB.

Attributes may be in any order, in either kind of quotes, with the five entities of
XML. A Frame without a number or outside any set is left out, a number that can't be
read is null. Comments and CDATA sections that hold frames are not told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

#: Splits that may be broadcast with the starts of their sets, after a count.
SMALL = 100_000
#: XML's own entities; the ampersand comes last.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_BLOCK = ["path", "block"]


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?s)(?:^|\s){name}\s*=\s*([\"'])(.*?)\1", 2)
    return F.when(found != "", found)


def _text(tag: Column, name: str) -> Column:
    out = _attribute(tag, name)
    for entity, char in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Starts of sets (head) and frames, in the order of pos within each block of a path; a table."""
    text = spark.read.option("lineSep", "<Frame").text(paths)
    v = F.col("value")
    start = v.rlike(r"^Set\s")
    rows = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"),
        F.when(start, F.regexp_extract(v, r"^((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", 1)).alias("set_tag"), F.when(v.rlike(r"^\s"), F.substring_index(v, ">", 1)).alias("tag"),
    )
    set_tag, tag = F.col("set_tag"), F.col("tag")
    head = F.struct(*(_text(set_tag, a).alias(n) for a, n in (("MatchId", "match_id"), ("GameSection", "period"), ("TeamId", "team_id"), ("PersonId", "entity_id"))))
    number = lambda a, kind: _attribute(tag, a).try_cast(kind)
    rows = rows.select(
        *_BLOCK, "pos", F.when(set_tag.isNotNull(), head).alias("head"), number("N", "long").alias("frame_id"), _text(tag, "T").alias("timestamp_utc"), number("X", "double").alias("x_m"),
        number("Y", "double").alias("y_m"), number("BallPossession", "int").alias("possession"), number("BallStatus", "int").alias("status"),
    )
    return cut(rows, "pieces")


def heads(parsed: DataFrame) -> DataFrame:
    """Of every block the sets that its frames may be in, by pos: the last of the blocks before it, at -1, and its own."""
    own = parsed.groupBy(*_BLOCK).agg(F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("pos", "head")))).alias("own"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.try_element_at("own", F.lit(-1)), ignorenulls=True).over(before)
    carried = F.when(carried.isNotNull(), F.array(F.struct(F.lit(-1).cast("long").alias("pos"), carried["head"].alias("head"))))
    first = F.when(F.col("block") == 0, None).otherwise(carried)
    return own.select(*_BLOCK, F.concat(F.coalesce(first, F.slice("own", 1, 0)), "own").alias("heads"))


def plain_path(uri: Column) -> Column:
    """A file's path as Spark's listings give it, from its URI."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def matches_of(parsed: DataFrame) -> DataFrame:
    """path and match_id of the matches that each file has sets of."""
    return parsed.where("head is not null").select(plain_path(F.col("path")).alias("path"), F.col("head.match_id").alias("match_id")).where("match_id is not null").distinct()


def frames_of(parsed: DataFrame) -> DataFrame:
    """match, period, team, entity and what a frame says, one row for each frame."""
    by = cut(heads(parsed), "sets")
    by = F.broadcast(by) if by.count() <= SMALL else by
    rows = parsed.where("frame_id is not null").join(by, _BLOCK)
    rows = rows.withColumn("_h", F.try_element_at(F.filter("heads", lambda h: h["pos"] < F.col("pos")), F.lit(-1))["head"]).where("_h is not null")
    return rows.select("_h.*", "frame_id", "timestamp_utc", "x_m", "y_m", "possession", "status")


def framesets(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows of tracking files: match_id, period, team_id, entity_id, frame_id, timestamp_utc, x_m, y_m, possession and status of each frame."""
    return frames_of(pieces(spark, paths))
