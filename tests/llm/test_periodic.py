"""Periodic runs against brute force: all periods of all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kinograph.llm import periodic, queries


def brute(words):
    """Every stretch of period q, for all q, by start, then period; of one stretch the least period."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w, out = np.array([ids[x] for x in words], np.int64), {}
    for q in range(1, len(w) // 3 + 1):
        edges = np.diff(np.r_[0, (w[:-q] == w[q:]).astype(np.int8), 0])
        for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if e - s + q >= max(24, 3 * q):
                out.setdefault((s, e + q), q)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _nested(rng, alphabet, depth=0):
    x = [rng.randrange(alphabet) for _ in range(rng.randint(1, rng.choice([3, 10, 40, 100])))]
    if depth < 3 and rng.random() < 0.5:
        x = _nested(rng, alphabet, depth + 1) + x[:2]
    if rng.random() < 0.7:
        x = (x * rng.choice([2, 3, 5, 10, 100]))[:2000]
    return [y if rng.random() > 0.01 else rng.randrange(alphabet) for y in x]


@pytest.mark.parametrize("seed", range(6))
def test_nested_repeats(seed):
    rng = random.Random(seed)
    for _ in range(40):
        words, alphabet = [], rng.choice([1, 2, 5, 50, 5000])
        while len(words) < rng.choice([60, 300, 1500]):
            words += _nested(rng, alphabet)
        words = [str(x) for x in words]
        seq, names = periodic.numbered(" ".join(words).encode())
        runs = periodic.find(seq)
        assert runs == brute(words)
        assert periodic.collapse(seq, names, runs, " ".join(words).encode()).decode() == kept(words, runs)


def test_long_runs_of_short_periods_inside_a_long_period():
    """Blocks of the large scales begin or end with long runs of one word; their own period is found all the same."""
    words = (["a"] * 700 + ["b"] + ["a", "c"] * 450 + ["d"]) * 4
    seq, _ = periodic.numbered(" ".join(words).encode())
    assert periodic.find(seq) == brute(words)


def test_words_are_cut_in_pieces(monkeypatch):
    text = "\t".join(f"w{i % 7}" for i in range(300)).encode() + b" \x0b\x0c \xc2\xa0x\r\n"
    whole = periodic.numbered(text)
    monkeypatch.setattr(periodic, "_CHUNK", 5)
    cut = periodic.numbered(text)
    assert cut[1] == whole[1] and cut[0].tolist() == whole[0].tolist() and len(whole[0]) == 301


def test_odd_rows(spark):
    rows = [(None, "a " * 24, 1), (None, None, 1), (7, "", 1), (7, "a " * 23, 2), (7, "a " * 24, 3), (8, "a b c d e f g h " * 3, 4), (8, "x " + "a b c d e f g h i " * 3 + "a y", 5)]
    got = periodic.detect(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    want = [(None, [(0, 24, 1)], "a"), (None, [], ""), (7, [], ""), (7, [], ("a " * 23).strip()), (7, [(0, 24, 1)], "a"), (8, [(0, 24, 8)], "a b c d e f g h"), (8, [(1, 28, 9)], "x a b c d e f g h i y")]
    key = repr
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.detect(empty).count() == 0


def test_strongest_by_exact_ratio(spark):
    runs = [[(0, 30, 10), (5, 25, 8), (90, 24, 7)], [(9, 30, 10), (4, 27, 9), (4, 24, 8)], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "id int, runs array<struct<start: long, length: long, period: long>>")
    got = {r.id: r.best and tuple(r.best) for r in df.select("id", periodic.strongest(df.runs).alias("best")).collect()}
    assert got == {0: (90, 24, 7), 1: (4, 24, 8), 2: None}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_documents(spark, sf):
    """The registered query, its repeated words included, against brute force over the whole table."""
    want = set()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1] * 10**9 // x[2], -x[0], -x[2]), default=(None, None, None))
        milli = runs and 1000 * best[1] // best[2] or None
        want.add((r.doc_id, len(runs), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(kept(words, runs))))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = queries.op13_periodic_runs(spark, f"/root/testdata/{sf}")
    assert {tuple(r[x] for x in names) for r in got.collect()} == want
    assert dict(got.dtypes)["n_runs"] == dict(got.dtypes)["exponent_milli"] == "bigint"
