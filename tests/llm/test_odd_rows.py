"""Null and repeated doc_ids, equal rows, and columns with the operators' own names, for every operator."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kinograph.llm import bpe, digest, langid, packing, rlindex, similar, simhash, token_rollup, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

_rng = random.Random(15)


def _prose(n):
    return " ".join("".join(_rng.choice(["ka", "lo", "mi", "tre", "sun", "pa"]) for _ in range(3)) for _ in range(n))


SAME = _prose(60)
ROWS = [
    (None, SAME), (None, SAME), (None, "alone without a number"), (1, SAME), (1, SAME), (1, _prose(40)), (2, None), (2, ""), (3, SAME + " " + _prose(5)), (5, _prose(9) + " " + SAME[:200]), (-4, SAME), (2**62, SAME),
]
#: Names that operators use inside or return.
EXTRA = "fp string, hits string, owned int, given string, seq int, n_tokens string, ids string, block int, bin int, grp int, component_id string, fingerprint string, score string, langs string, canon int, own int, kept string, row int"


@pytest.fixture(scope="module")
def odd(spark):
    names = EXTRA.split(", ")
    rows = [(*r, "en", "s", *["x" if n.endswith("string") else 7 for n in names]) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3)


def _ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    return t.encode(text or "", add_special_tokens=False).ids


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_bpe(odd):
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode(odd, PATH, bits=5, digest=True).collect()]
    assert _sorted(got) == _sorted([(d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for d, t in ROWS for i in [_ids(t)]])


def test_run_length_index(odd):
    """A row loses what starts in a row with a smaller id; null ids are the largest, and rows of one id take nothing from each other."""
    raw = [(d, (t or "").encode()) for d, t in ROWS]
    order = lambda d: (d is None, d or 0)
    want = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if any(b[p : p + 50] in other for e, other in raw if order(e) < order(d)):
                gone[p : p + 50] = b"\1" * 50
        want.append((d, len(b), sum(gone), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rlindex.remove_repeats(odd).collect()]
    assert _sorted(got) == _sorted(want)


def test_language(odd):
    model = langid.train(odd.where(~langid.held_out()))
    got = langid.predict(odd, model).collect()
    assert _sorted([(r.doc_id, r.lang_pred) for r in got]) == _sorted([(d, "en" if t else "und") for d, t in ROWS])
    assert langid.select(odd, model, 0.0).columns == odd.columns


def test_simhash(odd):
    def fp(t):
        return simhash.fingerprint(t or "")

    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    prints = [(d, fp(t)) for d, t in ROWS]
    least = {}
    for d, f in prints:  # groups of linked fingerprints
        near = [e for e, g in prints if (f ^ g).bit_count() <= 2 and e is not None]
        least[d, f] = min(near, default=None)
    for _ in prints:
        for (d, f), (e, g) in ((a, b) for a in prints for b in prints):
            if (f ^ g).bit_count() <= 2 and None not in (least[d, f], least[e, g]):
                least[d, f] = min(least[d, f], least[e, g])
    assert _sorted(got) == _sorted([(d, f"{f:016x}", least[d, f]) for d, f in prints])


def test_similar(odd):
    got = [(r.doc_id, r.component_id) for r in similar.near_duplicates(odd).collect()]
    assert len(got) == len(ROWS) and {c for d, c in got if d == 2} == {2}
    assert sum(c == -4 for _, c in got) >= 6  # equal texts, those with null ids as well, are in the group of the least id


def test_packing(odd):
    rows = packing.pack(packing.pieces(odd, PATH, 64), 64).collect()
    want = []
    for d, t in ROWS:
        ids = [*_ids(t), 0]
        want += [(d, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert _sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]) == _sorted(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_counts(odd):
    got = [(r.doc_id, r.tokens, r.chars) for r in token_rollup.counted(odd, "v", PATH).collect()]
    assert _sorted(got) == _sorted([(d, len(_ids(t)), len(t or "")) for d, t in ROWS])


def test_digest(odd):
    rows = digest.fingerprints(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ROWS)
    prints = {}
    for r in rows:
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(prints[len(SAME)]) == 1 and len({r.fingerprint for r in rows}) == len({t or "" for _, t in ROWS})


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (0, [0.5, 1.0]), (50, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [9.0, 9.0]), (2, [-1.0, 3e-3]), (7, [1.0, 2.0, 3.0]), (3, []), (100, [])]
    table = spark.createDataFrame([(*r, 1, "x", [1], 2) for r in rows], "vec_id long, embedding array<double>, score int, shard string, v array<int>, block int")
    q = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None]
    got = {}
    for r in topk.top_k(table, k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for i in (0, 50):
        asked = {tuple(v) for j, v in q if j == i}
        best = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j) for a in asked for j, v in q if j != i and len(v) == len(a))[:4]
        assert sorted(got[i]) == [(k + 1, -s, j) for k, (s, j) in enumerate(best)]


def test_top_k_of_large_components(spark):
    make = lambda v: spark.createDataFrame([(0, [v, 1.0]), (1, [v, 2.0]), (2, [1.0, v])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(make(float(1 << 21))).orderBy("rank").collect()]
    assert got == [(1, 1, (1 << 58) + 2 * 256 * 256), (2, 2, 2 * 256 * 256 * (1 << 21))]
    for v in (float(1 << 26), 1e300):
        with pytest.raises(Exception, match="64-bit integer"):
            topk.top_k(make(v)).collect()


def test_rows_of_one_id_with_equal_short_hashes(spark):
    """Texts whose 32-bit hashes are equal, without a doc_id: each loses its own repeats alone."""
    from pyspark.sql import functions as F

    from kinograph.llm import sentence_spans

    prose = " ".join(f"{w.capitalize()} runs over the old bridge and {w} comes back home before the night falls again." for w in ("ana", "bel", "cid", "dov"))
    text = F.concat(F.lit("Text "), F.col("id").cast("string"), F.lit(f" begins here with words of its own. {prose}"))
    pair = spark.range(200_000).select(text.alias("text")).groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("all")).where("size(all) > 1").first()
    own = pair["all"][:2]
    rows = [(None, own[0] + " " + prose), (None, own[1].replace(prose, ""))]
    assert rows[0][1] != rows[1][1]
    doubled = spark.createDataFrame([(None, own[0]), (None, own[1])], "doc_id long, text string")
    alone = [sentence_spans.remove_repeats(doubled.where(F.col("text") == t)).first() for t in own]
    both = {r.text: r.n_removed for r in sentence_spans.remove_repeats(doubled).collect()}
    assert both == {r.text: r.n_removed for r in alone}
    got = sorted(r.n_removed for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == 0 and got[1] > 100
