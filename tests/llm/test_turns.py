"""Repair of conversations against a search of all edits, whole conversations at a time."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import pytest

from kinograph.llm import queries, turns

SPACE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """(cost, audit, repaired) of the best edits of (initial or role, must go, truncated, text) rows, from the end to the start."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for x in "ua":
                if (last, x) in after:
                    c, a, r = best(i, x, inserts + 1)
                    options.append((c + 3, "I" + a, ((names[x], ""), *r)))
        if i < len(rows):
            role, gone, cut, text = rows[i]
            c, a, r = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, r))
            if not gone:
                if (last, role[:1]) in after:
                    c, a, r = best(i + 1, after[last, role[:1]], 0)
                    options.append((c + 3 * cut, "K" + a, ((role, text), *r)))
                for x in "ua":
                    if (last, x) in after:
                        c, a, r = best(i + 1, x, 0)
                        options.append((c + 3 + 3 * cut, "R" + a, ((names[x], text), *r)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    for i in range(len(rows), 0, -20):  # so that the search never goes deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def expected(rows):
    """{conv_id: report} of (conv_id, turn, role, text) rows."""
    talks, out = defaultdict(list), {}
    for c, t, r, x in rows:
        talks[c].append((t, r or "", x or ""))
    for c, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        kinds, seen = [], set()
        for _, r, x in talk:
            shown = x.strip(SPACE)
            kinds.append("blank" if not shown else "duplicate" if (r, x) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((r, x))
        numbers = [t for t, _, _ in talk if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        roles = [r[:1] for _, r, _ in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        cost, audit, kept = cheapest([(r, k in ("blank", "duplicate"), k == "truncated", x) for (_, r, x), k in zip(talk, kinds, strict=True)])
        n = Counter(kinds)
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def answer(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, audit string").repartition(3)
    found = turns.inspect(df)
    sha = {r.conv_id: r.sha256 for r in turns.repaired(df, found, digest=True).collect()}
    whole = defaultdict(list)
    for r in turns.repaired(df, found).collect():
        whole[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for c, h in sha.items():
        places, lines = zip(*sorted(whole[c]), strict=True) if whole[c] else ((), ())
        assert list(places) == list(range(len(places))) and hashlib.sha256("\n".join(lines).encode()).hexdigest() == h
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha[r.conv_id]) for r in found.collect()}


def talks(seed, n, most):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["", None, " \n", "Yes.", "Yes.", "no", "Why? ", "x ", f"line {t}.", f"line {t}!\t", f"open {t}"])
            rows += [(c if c else None, rng.choice([t, t, t, t + 3, 2, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def test_small_conversations(spark):
    rows = talks(1, 300, 7)
    assert answer(spark, rows) == expected(rows)


def test_pieces(spark, monkeypatch):
    """Conversations of many pieces, joined over several levels, are those of whole ones."""
    rows = talks(2, 30, 90)
    want = expected(rows)
    for piece, fan, batch in ((4, 2, 8), (8, 3, 20)):
        for name, value in (("FAN", fan), ("BATCH", batch), ("PIECE", piece)):
            monkeypatch.setattr(turns, name, value)
        monkeypatch.setattr(turns, "_ROWS", turns._ROWS.replace("place // 128", f"place // {piece}").replace("% 128", f"% {piece}"))
        assert answer(spark, rows) == want
        monkeypatch.undo()


def test_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Turn {t}." if t % 5 else "open") for t in range(900)] + [(2, 0, "user", "Hi.")] * 300 + [(2, 1, "assistant", "Ho.")]
    got = answer(spark, rows)
    assert got[2][:7] == (0, 0, 299, 0, 299, 4 * 299, "K" + "D" * 299 + "K")
    assert got == expected(rows)


def test_odd_tables(spark):
    assert answer(spark, []) == {}
    rows = [(None, None, None, None), (1, -(2**62), "user", "a."), (1, 2**62, "assistant", "b."), (2, None, "assistant", "c."), (3, 5, "system", "d."), (4, -(2**63), "user", "e"), (4, 2**63 - 1, "user", "f.")]
    got = answer(spark, rows)
    assert got[4][0] == 2**63 - 1
    want = expected(rows)
    want[4] = (2**63 - 1, *want[4][1:])
    assert got == want
    assert got[3][5:7] == (4, "D") and got[2][5:7] == (3, "IK") and got[None][5:7] == (4, "D")


def spoilt(rows):
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
        if k:
            yield from [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", EMPTY) for r in rows} | expected(list(spoilt(rows)))
    got = queries.op12_turn_repair(spark, f"/root/testdata/{sf}").collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r.conv_id: tuple(r[x] for x in names) for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.sql(queries.ORACLES["op12_turn_repair"]).fetchall()} == want
