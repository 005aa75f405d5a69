"""Raw files, versions of the canonical tables, builds by change, exact ranks."""

import hashlib
import math
import os
import random
import threading
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from kinograph.functions import ranks
from kinograph.sources import build, raw, versions
from kinograph.sources.tables import SCHEMAS, Tables


def tracking(match, sets, odd=False):
    """XML of (period, team, entity, frames), frames of (n, x, y); odd: other quotes, orders, entities and white space."""
    rng, out = random.Random(match), ['<?xml version="1.0"?>\n <PutDataRequest>\n<Positions EventTime="x">']
    for period, team, entity, frames in sets:
        ids = [f'MatchId="{match}"', f"TeamId='{team}'" if odd else f'TeamId="{team}"', f'PersonId="{entity}"', f'GameSection="{period}"', 'Note="a > b"']
        if odd:
            rng.shuffle(ids)
        out.append(f"<FrameSet {'  '.join(ids)}>\n")
        for n, x, y in frames:
            parts = [f'N="{n}"', f'T="2024-01-01T00:00:{n % 60:02d}Z"', f'X="{x}"', f'Y = "{y}"' if odd else f'Y="{y}"', 'MX="9"', 'D="0.1"', f'BallPossession="{1 + n % 2}"', f'BallStatus="{n % 3 % 2}"']
            if odd:
                rng.shuffle(parts)
            out.append(f"<Frame {' '.join(parts)}/>" + ("\n" if odd else ""))
        out.append("</FrameSet>")
    return "".join(out) + "</Positions></PutDataRequest>"


def info(match, title="A:B", role="home"):
    return (
        f'<Info><MatchInformation><General MatchId="{match}" MatchTitle="{title}"/><Environment PitchX="105" PitchY="68"/><Teams><Team TeamId="T1" TeamName="A" Role="{role}"><Players>'
        '<Player PersonId="p1" PlayingPosition="TW" Starting="true"/><Player PersonId="p2"/></Players></Team></Teams></MatchInformation></Info>'
    )


def by_tree(path):
    """Frames of a file by a reader of the whole tree."""
    out = []
    for s in ET.parse(path).getroot().iter("FrameSet"):
        for f in s.iter("Frame"):
            number = lambda a, kind: None if f.get(a) in (None, "", "?") else kind(f.get(a))  # noqa: B023, E731
            out.append((s.get("MatchId"), s.get("GameSection"), s.get("TeamId"), s.get("PersonId"), number("N", int), f.get("T"), number("X", float), number("Y", float), number("BallPossession", int), number("BallStatus", int)))
    return sorted(out, key=repr)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_scan_of_splits_is_that_of_the_tree(spark, tmp_path, small_splits):
    """Sets that begin, end and go on anywhere in splits, several files, odd writing."""
    walk = [(i, round(i * 0.1, 2), -1.5) for i in range(300)]
    for k, odd in enumerate((False, True)):
        sets = [("firstHalf", "BALL", "b", walk), ("firstHalf", "T1", "p1", walk[:3]), ("firstHalf", "T&amp;1", "p&quot;2", walk[:150]), ("secondHalf", "REF", "r", []), ("secondHalf", "T1", "p1", [(7, "NaN", "?"), (8, "", "1")])]
        (tmp_path / f"{k}.xml").write_text(tracking(f"m{k}", sets, odd))
    got = raw.framesets(spark, f"file://{tmp_path}/*.xml")
    want = by_tree(tmp_path / "0.xml") + by_tree(tmp_path / "1.xml")
    shown = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert shown(got.collect()) == shown(want)


def test_one_set_is_read_by_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "one.xml").write_text(tracking("m", [("firstHalf", "BALL", "b", [(i, 0.0, 0.0) for i in range(500)])]))
    parsed = raw.pieces(spark, f"file://{tmp_path}/one.xml")
    blocks = parsed.groupBy("block").count().collect()
    assert len(blocks) > 10 and max(b["count"] for b in blocks) < 60
    assert raw.frames_of(parsed).count() == 500


def rows_of(spark, root, table, number=None):
    return sorted(repr(tuple(r)) for r in versions.table(spark, root, table, SCHEMAS[table], versions.version(spark, root, number)).collect())


def test_a_build_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    (tmp_path / "t.xml").write_text(tracking("m", [("firstHalf", "BALL", "b", [(1, 0.0, 0.0)]), ("firstHalf", "T1", "p1", [(1, 1.0, 1.0)])]))
    (tmp_path / "i.xml").write_text(info("m"))
    paths, root = {"tracking": f"file://{tmp_path}/t.xml", "information": f"file://{tmp_path}/i.xml"}, f"file://{tmp_path}/root"
    assert build.build(spark, paths, root) == 1
    before = {t: rows_of(spark, root, t) for t in SCHEMAS}
    (tmp_path / "t.xml").write_text(tracking("m", [("firstHalf", "BALL", "b", [(1, 5.0, 5.0), (2, 6.0, 6.0)])]))
    done, store = [], versions.store

    def dies(df, *rest):
        if len(done) == 5:  # between tables
            raise RuntimeError("killed")
        done.append(rest)
        return store(df, *rest)

    monkeypatch.setattr(versions, "store", dies)
    with pytest.raises(RuntimeError, match="killed"):
        build.build(spark, paths, root)
    assert {t: rows_of(spark, root, t) for t in SCHEMAS} == before and versions.version(spark, root)["number"] == 1
    monkeypatch.undo()
    assert build.build(spark, paths, root) == 2
    assert len(rows_of(spark, root, "frames")) == 2 and len(rows_of(spark, root, "positions")) == 2  # the player's row is gone
    assert {t: rows_of(spark, root, t, 1) for t in SCHEMAS} == before
    gone = versions.vacuum(spark, root, list(SCHEMAS), hours=0)
    assert len(gone) > 6 and len(rows_of(spark, root, "frames")) == 2 and Tables.read(spark, root).players.count() == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """Both base themselves on the same version; the second takes the first one's as its base."""
    root = f"file://{tmp_path}/root"
    players = lambda match, n: spark.createDataFrame([(match, f"p{i}") for i in range(n)], "match_id string, player_id string")
    build.upsert(players("a", 1), root, "players")
    meet, create = threading.Barrier(2, timeout=60), versions._create
    waited = threading.local()

    def together(*args):
        if not getattr(waited, "once", False):
            waited.once = True
            meet.wait()
        return create(*args)

    monkeypatch.setattr(versions, "_create", together)
    numbers = []
    ts = [threading.Thread(target=lambda m=m, n=n: numbers.append(build.upsert(players(m, n), root, "players"))) for m, n in (("b", 2), ("c", 3))]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert sorted(numbers) == [2, 3]
    assert sorted(r.match_id for r in Tables.read(spark, root).players.collect()) == ["a", "b", "b", "c", "c", "c"]
    monkeypatch.undo()
    build.upsert(players("b", 1), root, "players")
    assert sorted(r.match_id for r in Tables.read(spark, root).players.collect()) == ["a", "b", "c", "c", "c"]


def test_builds_by_change(spark, tmp_path):
    walk = lambda x: [("firstHalf", "BALL", "b", [(1, x, 0.0), (2, x, 0.0)]), ("firstHalf", "T1", "p1", [(1, x, 1.0)])]
    for m in "abc":
        (tmp_path / f"t-{m} +.xml").write_text(tracking(m, walk(1.0)))
        (tmp_path / f"i-{m}.xml").write_text(info(m))
    (tmp_path / "t-b2.xml").write_text(tracking("b", [("secondHalf", "BALL", "b", [(9, 3.0, 3.0)])]))
    paths, root = {"tracking": f"file://{tmp_path}/t-*.xml", "information": f"file://{tmp_path}/i-*.xml"}, f"file://{tmp_path}/root"
    what = lambda r: sorted((x.match_id, x.what) for x in r.matches.collect())
    builds = lambda: {(r.table, r.match_id): r.build for r in versions.manifest(spark, versions.version(spark, root)).collect()}

    def same_as_a_full_build(name):
        full = f"file://{tmp_path}/full-{name}"
        build.build(spark, paths, full)
        report = lambda where: sorted(map(repr, build.quality_report(Tables.read(spark, where).positions, Tables.read(spark, where).frames).collect()))
        assert report(root) == report(full) and {t: rows_of(spark, root, t) for t in SCHEMAS} == {t: rows_of(spark, full, t) for t in SCHEMAS}

    first = build.rebuild(spark, paths, root)
    assert what(first) == [(m, "built") for m in "abc"] and first.differences.count() == 7
    assert build.rebuild(spark, paths, root).version is None
    before = builds()
    (tmp_path / "t-b +.xml").write_text(tracking("b", walk(2.0)))  # one changed file; the match has another one
    assert what(build.rebuild(spark, paths, root)) == [("b", "built")]
    assert {k[1] for k, b in builds().items() if before[k] != b} == {"b"}
    same_as_a_full_build("changed")
    (tmp_path / "i-a.xml").write_text(info("a", role="guest"))  # roles go into positions
    (tmp_path / "t-d.xml").write_text(tracking("d", walk(4.0)))
    (tmp_path / "i-d.xml").write_text(info("d"))
    (tmp_path / "t-c +.xml").unlink()
    (tmp_path / "i-c.xml").unlink()
    assert what(build.rebuild(spark, paths, root)) == [("a", "built"), ("c", "removed"), ("d", "built")]
    same_as_a_full_build("more")
    (tmp_path / "t-b2.xml").unlink()  # a half of b is gone
    assert what(build.rebuild(spark, paths, root)) == [("b", "built")]
    same_as_a_full_build("less")


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.xml", "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)
    (tmp_path / "empty.xml").touch()
    sha, left = hashlib.sha256(b"head"), (3 << 30) - 4
    while left:
        n = min(left, 1 << 24)
        sha.update(bytes(n))
        left -= n
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in build.source_lock(spark, f"file://{tmp_path}/*.xml").collect()}
    assert got == {"big.xml": (3 << 30, sha.hexdigest())}
    os.truncate(tmp_path / "big.xml", 0)


def test_parity_takes_the_middle_frame(spark):
    """Rank n // 2 of all frames, with gaps and in any order; a raw frame without coordinates has no canonical row."""
    frames = {"p1": [3, 4, 9, 100, 7], "p2": [1, 2], "p3": [5], "p4": [1, 2, 3, 4, 5, 6, 8, 1000]}
    rows = [("m", "firstHalf", e, f, float("nan") if f == 9 else float(f), 0.0) for e, fs in frames.items() for f in fs]
    df = spark.createDataFrame(rows, "match_id string, period string, entity_id string, frame_id long, x_m double, y_m double").repartition(3)
    canonical = df.where("not isnan(x_m)").withColumn("x_m", F.when(F.col("frame_id") == 1000, 0.0).otherwise(F.col("x_m")))
    got = sorted((r.entity_id, r.frame_id, r.equal) for r in build.parity_samples(df, canonical).collect())
    want = {(e, sorted(fs)[i], sorted(fs)[i] != 1000) for e, fs in frames.items() for i in (0, len(fs) // 2, len(fs) - 1)}
    assert got == sorted(want)


def test_summaries(spark):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 5) for _ in range(997)], "b": [1.0, 1.0, 2.0], "c": [], "d": [4.5], None: [float(i % 7) for i in range(50)], "e": [rng.choice([1.0, 2.0, 3.0]) for _ in range(400)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("c", None), ("c", float("nan")), ("a", float("inf")), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: tuple(r)[1:] for r in ranks.summary(df, ["g"], "v").collect()}
    for g, xs in groups.items():
        xs = sorted(x for x in xs if math.isfinite(x))
        at = lambda q: xs[min(len(xs) - 1, max(0, round((len(xs) - 1) * q)))] if xs else None  # noqa: B023, E731
        assert got[g] == (len(xs), at(0), at(0.5), at(0.9), at(0.95), at(1))
