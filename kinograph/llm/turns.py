"""Repair of conversations: the cheapest edits that bring their roles into the grammar (s?(ua)+)?.

A conversation's rows are taken by turn (nulls first), then role, then the text's
SHA-256. Keep (K) costs 0, Rerole to user or assistant (R) 3, Delete (D) 4, Insert
an empty user or assistant (I) 3 at any place; a truncated row that stays adds 3,
blank and duplicate rows must go. Of equal cost, the edits whose initials are least
in ASCII order count.

The work is a recursive DuckDB query inside hash-partitioned batches: each recursion
advances one row of all pieces of a batch and keeps, for each state of the grammar,
the least cost and its edits. A piece is at most `PIECE` rows that follow each other;
where one may continue a conversation it is solved from every state, and pieces are
joined by the same recursion, `FAN` at a time, until each conversation is one. So a
conversation of any length is spread over tasks. Two edits of equal cost from one
state are never the beginning of each other, so least edits of pieces make up least
edits of the whole.

Only role, hash and faults of rows are dealt with; texts are shuffled once, to write
the repaired turns in order. Rows that are equal are counted before the shuffle.

Null roles and texts are empty ones (an empty role is in no place of the grammar, an
empty text is blank), a null conv_id is a conversation, turns may be null, repeat and
be missing. Other columns are ignored, whatever their names; no rows, no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut
from .kept import nothing

#: Rows of a piece (a power of two), pieces that are joined at a time, rows of one DuckDB query, about.
PIECE, FAN, BATCH = 128, 16, 4096
_SPACE = " \t\n\x0b\x0c\r"

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 are good ends.
_STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_EXPECTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: Insertions that bring a state to a good end.
_LACKS = {0: 0, 1: 2, 2: 1, 3: 0}

_MOVES = f"""
  steps(a, initial, b) AS (VALUES {", ".join(f"({a}, '{i}', {b})" for (a, i), b in _STEPS.items())}),
  once AS (SELECT DISTINCT a, b FROM steps WHERE initial <> 's'),
  inserts(a, b, cost, audit) AS (
    SELECT s, s, 0, '' FROM range(4) t(s) UNION ALL SELECT a, b, 3, 'I' FROM once
    UNION ALL SELECT x.a, y.b, 6, 'II' FROM once x JOIN once y ON x.b = y.a),
  edits(a, b, initial, letter, cost) AS (
    SELECT a, b, initial, 'K', 0 FROM steps UNION ALL SELECT a, b, NULL, 'R', 3 FROM once
    UNION ALL SELECT s, s, NULL, 'D', 4 FROM range(4) t(s)),
  moves AS MATERIALIZED (
    SELECT i.a, e.b, e.initial, e.letter, i.cost + e.cost AS cost, i.audit || e.letter AS audit FROM inserts i JOIN edits e ON i.b = e.a)"""

#: From edges (unit, n, a, b, best), the n-th step of a unit from state a to b, to paths through all steps of each unit.
_PATHS = """
  best AS (
    SELECT unit, CAST(0 AS BIGINT) AS n, s AS a, s AS b, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS best FROM units JOIN range(4) t(s) ON s = 0 OR inner_piece
    UNION ALL
    SELECT p.unit, p.n + 1, p.a, e.b, min({'cost': p.best.cost + e.best.cost, 'audit': p.best.audit || e.best.audit})
    FROM best p JOIN edges e ON e.unit = p.unit AND e.n = p.n + 1 AND e.a = p.b GROUP BY p.unit, p.n, p.a, e.b)
SELECT u.conv_id, u.place, u.blank, u.duplicate, u.truncated, u.illegal, u.head, u.tail, u.inner_piece,
  list({'a': p.a, 'b': p.b, 'cost': p.best.cost, 'audit': p.best.audit}) AS paths
FROM units u JOIN best p ON p.unit = u.unit AND p.n = u.steps GROUP BY ALL"""

_ROWS = f"""
WITH RECURSIVE {_MOVES},
  r AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY conv_id, place // {PIECE}) AS unit, row_number() OVER w AS n,
      CASE WHEN lag(initial) OVER w || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END + copies - 1 AS illegal
    FROM taken WINDOW w AS (PARTITION BY conv_id, place // {PIECE} ORDER BY place)),
  units AS MATERIALIZED (
    SELECT unit, any_value(conv_id) AS conv_id, min(place) AS place, max(n) AS steps, min(place) % {PIECE} = 0 AS inner_piece,
      sum(CASE WHEN blank THEN copies ELSE 0 END) AS blank, sum(CASE WHEN blank THEN 0 WHEN again THEN copies ELSE copies - 1 END) AS duplicate,
      sum(CASE WHEN open AND NOT blank AND NOT again THEN 1 ELSE 0 END) AS truncated, sum(illegal) AS illegal, arg_min(initial, n) AS head, arg_max(initial, n) AS tail
    FROM r GROUP BY unit),
  edges AS MATERIALIZED (
    SELECT unit, n, a, b, min({{'cost': cost + CASE WHEN open AND letter <> 'D' THEN 3 ELSE 0 END + 4 * (copies - 1), 'audit': audit || repeat('D', copies - 1)}}) AS best
    FROM r JOIN moves m ON (m.initial IS NULL OR m.initial = r.initial) AND (m.letter = 'D' OR NOT (blank OR again)) GROUP BY unit, n, a, b),
{_PATHS}"""

_PIECES = f"""
WITH RECURSIVE
  r AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY conv_id, unit_no) AS unit, row_number() OVER w AS n,
      illegal + CASE WHEN lag(tail) OVER w || head NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS pairs
    FROM taken WINDOW w AS (PARTITION BY conv_id, unit_no ORDER BY place)),
  units AS MATERIALIZED (
    SELECT unit, any_value(conv_id) AS conv_id, min(place) AS place, max(n) AS steps, min(unit_no) > 0 AS inner_piece, sum(blank) AS blank, sum(duplicate) AS duplicate,
      sum(truncated) AS truncated, sum(pairs) AS illegal, arg_min(head, n) AS head, arg_max(tail, n) AS tail
    FROM r GROUP BY unit),
  edges AS MATERIALIZED (
    SELECT unit, n, p.a AS a, p.b AS b, {{'cost': p.cost, 'audit': p.audit}} AS best FROM (SELECT unit, n, unnest(paths) AS p FROM r)),
{_PATHS}"""

_SCHEMA = (
    "conv_id long, place long, blank long, duplicate long, truncated long, illegal long, head string, tail string, inner_piece boolean, "
    "paths array<struct<a: int, b: int, cost: long, audit: string>>"
)
_ARROW = pa.schema([
    *((x, pa.int64()) for x in ("conv_id", "place", "blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), ("inner_piece", pa.bool_()),
    ("paths", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of some `most` rows; rows of one `unit_key`, which follow each other, stay together."""
    have = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        have = part if have is None else pa.concat_tables([have, part])
        while have.num_rows > most:
            keys = have.column("unit_key")
            end = most
            while end < have.num_rows and keys[end].as_py() == keys[end - 1].as_py():
                end += 1
            if end == have.num_rows:
                break
            yield have.slice(0, end)
            have = have.slice(end)
    if have is not None and have.num_rows:
        yield have


def _solved(batches, sql: str, most: int):
    nothing()
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    for taken in _groups(batches, most):
        con.register("taken", taken)
        yield from con.sql(sql).to_arrow_table().cast(_ARROW).to_batches()
        con.unregister("taken")


def _rows(turns: DataFrame) -> DataFrame:
    """What the order and the faults of rows follow from, equal rows counted; a table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shown = F.rtrim(text, F.lit(_SPACE))
    out = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("hash"), F.substring(role, 1, 1).alias("initial"), (shown == "").alias("blank"),
        (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    return cut(out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("copies")), "turns")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for x in names:
        on &= a[x].eqNullSafe(b[x])
    return on


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in the order of all conversations, by ranges of it, each with its place and whether its role and text come earlier; a table."""
    key = F.struct(F.col("turn").isNotNull().alias("is"), F.coalesce("turn", F.lit(0)).alias("turn"))
    # blank rows must go anyway
    seen = rows.where("not blank").groupBy("conv_id", "role", "hash").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("turns"))
    seen = cut(seen.where("turns > 1").select("conv_id", "role", "hash", "first"), "seen")
    out = rows.join(seen, _same(rows, seen, "conv_id", "role", "hash"), "left").select(*(rows[x] for x in rows.columns), "first")
    out = out.withColumn("again", F.coalesce(F.col("first") != key, F.lit(False)))
    out = out.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return cut(out.select(F.monotonically_increasing_id().alias("place"), "conv_id", "initial", "blank", "open", "again", "copies"), "placed")


def _joined(pieces: DataFrame) -> DataFrame:
    """One row a conversation, from those of its pieces."""
    done = None
    while True:
        w = Window.partitionBy("conv_id")
        pieces = cut(pieces.withColumns({"no": F.row_number().over(w.orderBy("place")), "all": F.count(F.lit(1)).over(w)}), "pieces")
        single = pieces.where(F.col("all") == 1).drop("no", "all")
        done = single if done is None else done.unionByName(single)
        left = pieces.where(F.col("all") > 1)
        if left.isEmpty():
            return done
        left = left.withColumn("unit_no", F.expr(f"(no - 1) div {FAN}")).drop("no", "all")
        left = left.withColumn("unit_key", F.struct("conv_id", "unit_no")).repartition("conv_id", "unit_no").sortWithinPartitions("conv_id", "unit_no", "place")
        pieces = left.mapInArrow(partial(_solved, sql=_PIECES, most=16 * FAN), _SCHEMA)


def _gaps(rows: DataFrame) -> DataFrame:
    """Turns that are missing between the first and the last of each conversation; at most 2^63 - 1."""
    wide = lambda c: c.cast("decimal(38,0)")
    n = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("z"), F.count("turn").alias("n"))
    gaps = wide(F.col("z")) - wide(F.col("a")) + 1 - wide(F.col("n"))
    gaps = F.least(gaps, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return n.select(F.col("conv_id").alias("of"), F.when(F.col("n") > 0, gaps).otherwise(0).alias("gaps"))


def inspect(turns: DataFrame) -> DataFrame:
    """Of every conversation of turns (conv_id, turn, role, text) its gaps, blank, duplicate, truncated and illegal counts, and cost and audit (the initials) of its cheapest edits; a table."""
    rows = _rows(turns)
    placed = _placed(rows).withColumn("unit_key", F.struct("conv_id", F.shiftright("place", PIECE.bit_length() - 1).alias("piece")))
    dealt = placed.repartition("unit_key").sortWithinPartitions("unit_key", "place")
    whole = _joined(dealt.mapInArrow(partial(_solved, sql=_ROWS, most=BATCH), _SCHEMA))
    def ended(p):
        more = F.when(p["b"] == 1, _LACKS[1]).when(p["b"] == 2, _LACKS[2]).otherwise(0)
        return F.struct((p["cost"] + 3 * more).alias("cost"), F.concat(p["audit"], F.repeat(F.lit("I"), more)).alias("audit"))

    best = F.array_min(F.transform(F.filter("paths", lambda p: p["a"] == 0), ended))
    whole = whole.select("conv_id", "blank", "duplicate", "truncated", "illegal", best.alias("best"))
    gaps = _gaps(rows)
    out = whole.join(gaps, F.col("conv_id").eqNullSafe(F.col("of")))
    return cut(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit"), "inspected")


def _mended(batches, digest: bool):
    """Repaired turns, or their SHA-256 for each conversation, from rows in order, each conversation's edits before them."""
    nothing()
    names = ["conv_id", "sha256"] if digest else ["conv_id", "place", "edit", "role", "text"]
    types = [pa.int64(), pa.string()] if digest else [pa.int64(), pa.int64(), *[pa.string()] * 3]
    out: list = []
    conv, audit, at, state, place, sha, begun = None, "", 0, 0, 0, None, False

    def put(edit, role, text):
        nonlocal place
        if digest:
            sha.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
        else:
            out.append((conv, place, edit, role, text))
        place += 1

    def insert():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            role = _EXPECTED[state]
            put("I", role, "")
            state, at = _STEPS[state, role[0]], at + 1

    def end():
        insert()
        if digest:
            out.append((conv, sha.hexdigest()))

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for batch in batches:
        size = 0
        for ids, edits, roles, texts in zip(*batch.columns, strict=True):
            if (given := edits.as_py()) is not None:
                if begun:
                    end()
                conv, audit, at, state, place, sha, begun = ids.as_py(), given, 0, 0, 0, hashlib.sha256(), True
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit != "D":
                role, text = (roles.as_py() if edit == "K" else _EXPECTED[state]), texts.as_py()
                put(edit, role, text)
                size += len(text)
                state = _STEPS[state, role[0]]
            if size > 4_000_000 and out:
                yield batch_of()
                out.clear()
                size = 0
        if out:
            yield batch_of()
            out.clear()
    if begun:
        end()
    if out:
        yield batch_of()


def repaired(turns: DataFrame, inspected: DataFrame, digest: bool = False) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of every turn after the edits that inspect() found for the same turns.

    digest: conv_id and sha256 alone, of all `role:text` of each conversation joined by newlines. A conversation's turns
    go through one task in order, a batch at a time.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.col("turn").cast("long"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("hash"), F.lit(None).cast("string").alias("audit"), text.alias("text")
    )
    heads = inspected.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("hash"), "audit", F.lit("").alias("text"))
    order = [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    dealt = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    return dealt.mapInArrow(partial(_mended, digest=digest), "conv_id long, sha256 string" if digest else "conv_id long, place long, edit string, role string, text string")
