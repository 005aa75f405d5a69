"""WARC archives: what is read back from what was written, damage, and the registered query."""

import gzip
import hashlib
import io
import zlib
from base64 import b32encode
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from kinograph.llm import queries, warc


def digest(payload):
    return b32encode(hashlib.sha1(payload).digest()).decode()


def one(page_id, payload, refers_to=None, url="http://a/"):
    return warc.page_record(page_id, url, payload, hashlib.sha256(payload).digest(), refers_to, "2024-01-01T00:00:00Z")


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every page."""
    out = Counter()
    for page_id, html in rows:
        same = [p for p, h in rows if (h or "") == (html or "") and p is not None]
        payload = (html or "").encode()
        refers = max(same) if same and page_id != max(same) and len(payload) >= least else None
        out[page_id, len(payload), digest(payload), "response" if refers is None else "revisit", refers] += 1
    return out


def answer(spark, rows, folder, **options):
    pages = spark.createDataFrame([(p, "http://x/ü b\r\nX-Page-Id: 9" if p != 5 else None, h, "x", b"y") for p, h in rows], "page_id long, url string, html string, digest string, payload binary").repartition(3)
    found = warc.resolve(warc.cut(warc.read(warc.write(pages, str(folder), **options))))
    return found.where("record_type != 'warcinfo'").collect()


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400_000  # 3.6 MB, over many pieces
    rows = [(1, "<p>a"), (2, "<p>a"), (9, "<p>a"), (9, "<p>a"), (3, ""), (4, None), (5, "alone"), (None, "<p>a"), (None, "none"), (None, "none"), (-7, big), (-6, big), (2**62, "WARC/1.1\r\n\r\n")]
    for least in (0, 5):
        got = answer(spark, rows, tmp_path / str(least), least=least, roll=2_000)
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows, least)
        assert {r.status for r in got} == {"ok"} and {r.target_uri for r in got} == {"http://x/ü%20b%0D%0AX-Page-Id:%209", None}
    assert answer(spark, [], tmp_path / "none") == []


def test_groups_that_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 0)
    rows = [(i, f"p{i % 3}") for i in range(40)]
    got = answer(spark, rows, tmp_path / "a")
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)


def test_archives_are_gzip_with_a_member_a_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"<p>{i}" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write(pages, str(tmp_path / "a"), roll=1500).collect()
    assert sum(a.records for a in archives) == 30 and len(archives) > 2
    for a in archives:
        data = Path(a.path.removeprefix("file://")).read_bytes()
        assert len(data) == a.bytes and a.bytes < 3000
        members = 0
        while data:
            unpack = zlib.decompressobj(31)
            text = unpack.decompress(data)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and unpack.eof
            data, members = unpack.unused_data, members + 1
        assert members == a.records + 1


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(warc, "_PIECE", piece)
    raw = one(1, b"first" * 90) + one(2, b"") + one(3, b"first" * 90, 1)
    rows = list(warc.records_of(io.BytesIO(raw), keep=True))
    assert [(r["page_id"], r["payload_bytes"], r["status"], r["payload"]) for r in rows] == [(1, 450, "ok", b"first" * 90), (2, 0, "ok", b""), (3, 0, "ok", b"")]
    assert [r["offset"] for r in rows] == [0, rows[0]["length"], rows[0]["length"] + rows[1]["length"]] and sum(r["length"] for r in rows) == len(raw)


def test_damage_is_told_and_left_behind():
    good = [one(i, bytes(f"page {i} ", "ascii") * 60) for i in range(4)]
    status = lambda raw: [(r.get("page_id"), r["status"]) for r in warc.records_of(io.BytesIO(raw))]
    assert status(good[0] + b"junk between" + good[1]) == [(0, "ok"), (None, "not gzip"), (1, "ok")]
    assert status(good[0][:-30] + good[1] + good[2]) == [(None, "not gzip"), (1, "ok"), (2, "ok")]
    assert status(good[0] + good[1][:-9]) == [(0, "ok"), (None, "cut off")]
    assert status(good[0] + b"\x1f\x8b\x08") == [(0, "ok"), (None, "cut off")]
    flipped = bytearray(good[1])
    flipped[len(flipped) // 2] ^= 0x55
    assert status(good[0] + bytes(flipped) + good[2])[-1] == (2, "ok") and len(status(good[0] + bytes(flipped) + good[2])) == 3
    text = gzip.decompress(good[1])
    for change, why in (
        (lambda t: t.replace(b"Content-Length: ", b"Content-Length: 9", 1), "wrong length"), (lambda t: t + b"more", "wrong length"), (lambda t: b"HTTP" + t, "no record"),
        (lambda t: t[: t.index(b"\r\n\r\n")], "no head"), (lambda t: t.replace(b"\r\nContent-Length: " + str(len(t) - t.index(b"\r\n\r\n") - 8).encode(), b"", 1), "no length"),
    ):
        assert status(gzip.compress(change(text)) + good[2]) == [(None, why), (2, "ok")]
    assert status(gzip.compress(text.replace(b"page 1 page 1", b"page 1 page 7")))[0] == (1, "digest differs")
    assert status(b"") == []


def test_other_writers(spark, tmp_path):
    """Fields folded over lines and in any case, other digests, a block that is the payload itself, a revisit without a block and one whose record isn't there."""
    sha256 = b32encode(hashlib.sha256(b"abc").digest()).decode()
    raws = [
        b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: x\r\n  y\r\nwarc-payload-digest: sha256:" + sha256.encode() + b"\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Refers-To: <gone>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: application/http\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: md5:" + hashlib.md5(b"abd").hexdigest().encode() + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    ]
    path = tmp_path / "one.warc.gz"
    path.write_bytes(b"".join(map(gzip.compress, raws)))
    found = warc.resolve(warc.read(spark.createDataFrame([(f"file://{path}",)], "path string"), payload=True))
    got = sorted((r.offset, r.record_type, r.target_uri, r.payload_bytes, r.status, r.payload and bytes(r.payload)) for r in found.collect())
    assert [g[1:] for g in got] == [("resource", "x y", 3, "ok", b"abc"), ("revisit", None, None, "unresolved", b""), ("resource", None, 3, "digest differs", b"abc")]


def test_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    got = queries.op11_warc_archives(spark, sf).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(repr, con.sql(queries.ORACLES["op11_warc_archives"]).fetchall())) == sorted(repr(tuple(r)) for r in got)
