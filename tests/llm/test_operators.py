"""The corpus operators against brute force, on small tables with nulls, ties, empty and long texts."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinograph.llm import bpe, digest, html_blocks, langid, packing, rlindex, sentence_spans, similar, simhash, token_rollup, topk
from kinograph.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("hits", T.StringType())])

_rng = random.Random(5)
_SYL = ["ka", "lo", "mi", "tre", "sun", "o", "pa", "ri", "vel", "dor", "é", "ß"]


def _word():
    return "".join(_rng.choice(_SYL) for _ in range(_rng.randint(1, 4)))


def _sentence(n=None):
    return " ".join(_word() for _ in range(n or _rng.randint(4, 14))).capitalize() + "."


PASSAGE = " ".join(_sentence(12) for _ in range(5))


def _texts():
    out = [None, "", "a", "Erinst resh.", "  \n\t ", "ha " * 3000, "x" * 9000, "日本語のテキスト " * 40, "1 2 3 !!", "a\x1cb \x00 é é"]
    for _ in range(30):
        out.append("\n".join(" ".join(_sentence() for _ in range(_rng.randint(1, 8))) for _ in range(_rng.randint(1, 5))))
    out += [out[12], out[12], out[15], out[20] + " " + PASSAGE + " " + out[21], out[22] + "\n" + PASSAGE, PASSAGE.upper(), out[25][:-30] + "different end here."]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], None if i % 7 == 0 else f"s{i % 2}", 0, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t.encode(text, add_special_tokens=False).ids, t


def test_bpe_round_trip(docs, empty):
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, bits=6, digest=True).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids, tok = _ids(t or "")
        r = got[i * 3]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(empty, PATH).count() == 0
    same = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, small=-1).collect()}  # the way without broadcasts
    assert all(np.frombuffer(same[i * 3], "<u4").tolist() == _ids(t or "")[0] for i, t in enumerate(TEXTS))


def _unbroken(rng, kind, n):
    """Texts without white space: Chinese, letters and digits, one character over and over; or all of these with words between."""
    if kind == "mixed":
        out = ""
        while len(out) < n:
            out += _unbroken(rng, rng.choice(["chinese", "letters", "same"]), rng.randint(5, 600)) + rng.choice(["", " ", "\n a word's "])
        return out
    if kind == "same":
        return rng.choice(["a", "'", "\'\'s", "é", "...", "一"]) * n
    return "".join(chr(0x4E00 + int(rng.expovariate(1 / 400))) if kind == "chinese" else rng.choice("etaoinshrdlu0123'Q.é") for _ in range(n))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kind", ["chinese", "letters", "same", "mixed"])
def test_texts_without_white_space(name, kind):
    """Ids are the tokenizer's, and a megabyte takes no more than three times its time."""
    import time

    rng, enc = random.Random(5), bpe.UnitEncoder(public_tokenizers.path(name), 100_000)
    for _ in range(20):
        text = _unbroken(rng, kind, rng.randint(500, 8000))
        pieces = bpe.chunks(text, 8, 64)
        assert bpe.joined(pieces, enc.encode(pieces), enc.encode, enc.sizes) == enc._ids(text)
    text = _unbroken(rng, kind, 400_000)
    begun = time.perf_counter()
    whole = enc._ids(text)
    plain = time.perf_counter() - begun
    pieces = bpe.chunks(text)
    assert bpe.joined(pieces, enc.encode(pieces), enc.encode, enc.sizes) == whole
    assert time.perf_counter() - begun - plain < 3 * plain + 2



@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joints_are_mended_wherever_texts_are_cut(name):
    enc = bpe.UnitEncoder(public_tokenizers.path(name))
    for text in (t for t in TEXTS if t and len(t) < 800):
        for k in (1, 3, 10, 50):
            pieces = [text[i : i + k] for i in range(0, len(text), k)] if k > 9 else [text[: len(text) * k // 10], text[len(text) * k // 10 :]]
            pieces = [p for p in pieces if p]
            whole = enc.encode([text])[0]
            assert bpe.joined(pieces, enc.encode(pieces), enc.encode, enc.sizes) == whole


def test_chunks_make_up_the_text_and_are_shared():
    for t in TEXTS:
        if t:
            assert "".join(bpe.chunks(t, 5, 20)) == t
    long = " ".join(_sentence() for _ in range(80))
    a, b = bpe.chunks(long, 6, 20), bpe.chunks("Something before. " + long, 6, 20)
    assert len(set(a) & set(b)) > len(a) / 2


def test_packing(docs, empty, spark):
    parts = packing.pieces(docs, PATH, 64)
    rows = packing.pack(parts, 64, group=15).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = [*_ids(t or "")[0], 0]
        want = [(k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by[i * 3], key=lambda r: r.piece)] == want
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(seqs) <= -(-total // 64) + 2
    assert packing.pack(packing.pieces(empty, PATH)).count() == 0


def test_bounds_are_bounds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets, n = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and n >= packing.lower_bound(sizes, 100) >= -(-sizes.sum() // 100)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_run_length_index(docs, empty):
    first, want = {}, {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        cov = bytearray(len(b))
        new = set()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if w in first:
                cov[p : p + 50] = b"\1" * 50
            new.add(w)
        for w in new:
            first.setdefault(w, i)
        want[i * 3] = (len(b), sum(cov), len(re.findall(b"\1+", bytes(cov))), bytes(c for c, m in zip(b, cov, strict=True) if not m))
    for kw in ({}, {"block": 3000, "bucket": 500}, {"block": 500, "hot": 3}, {"block": 2000, "hot": 1}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rlindex.remove_repeats(docs, **kw).collect()}
        assert got == want
    assert sum(w[1] for w in want.values()) > 2000
    assert rlindex.remove_repeats(empty).count() == 0


def test_matching_statistics_of_other_texts():
    """Texts that the index doesn't hold: a window has the least document of the indexed texts that hold it, or none."""
    rng = random.Random(2)
    for alphabet in (b"ab", b"abcdefgh", bytes(range(200))):
        make = lambda n: [bytes(rng.choice(alphabet) for _ in range(rng.randint(8, 60))) for _ in range(n)]  # noqa: B023, E731
        texts, others = make(50), make(40)
        others += [t[rng.randint(0, 3) :] + bytes(rng.choice(alphabet) for _ in range(9)) for t in texts if len(t) > 12] + [b"\xf0" * 20]
        docs_ = np.array([rng.randint(0, 50) for _ in texts], np.int64)
        index = rlindex.RunLengthIndex(texts, docs_, 8)
        found, place = index.stream(others)
        for k, t in enumerate(others):
            for p in range(len(t) - 7):
                have = [int(d) for u, d in zip(texts, docs_, strict=True) if t[p : p + 8] in u]
                assert found[place[k] + p] == (min(have) if have else rlindex._LAST)
        assert (found < rlindex._LAST).any()


def test_least_documents_by_rounds(monkeypatch):
    rng = random.Random(6)
    core = b"the same line in all"
    texts = sorted({bytes(rng.choice(b"xyz") for _ in range(rng.randint(1, 14))) + core + bytes(rng.choice(b"xyz") for _ in range(rng.randint(1, 14))) for _ in range(150)})
    texts = [t for t in texts if len(t) >= 24]
    rng.shuffle(texts)
    docs_, keys = np.array([rng.randint(0, 99) for _ in texts], np.int64), np.zeros(len(texts), np.uint32)
    sizes = []
    make = rlindex.RunLengthIndex.__init__
    monkeypatch.setattr(rlindex.RunLengthIndex, "__init__", lambda self, t, *a: (sizes.append(len(t)), make(self, t, *a))[1])
    found, place = rlindex.least_documents(texts, docs_, keys, 24)
    for k, t in enumerate(texts):
        for p in range(len(t) - 23):
            assert found[place[k] + p] == min(int(d) for u, d in zip(texts, docs_, strict=True) if t[p : p + 24] in u)
    assert sizes[:3] == [1, 8, 64] and len(sizes) < 8
    monkeypatch.setattr(rlindex.RunLengthIndex, "stream", lambda self, t: (np.full(sum(len(x) - 23 for x in t), rlindex._LAST), np.cumsum([len(x) - 23 for x in t]) - [len(x) - 23 for x in t]))
    bypassed, _ = rlindex.least_documents(texts, docs_, keys, 24)
    assert (bypassed != found).any()  # the answers come from the streams


def test_language_mixture(spark, docs, empty):
    rng = random.Random(3)
    voc = {"xx": ["the", "and", "house", "water", "think", "with"], "yy": ["der", "und", "haus", "wasser", "denken", "mit"]}
    rows = [(i, " ".join(rng.choice(voc[k]) for _ in range(30)), k, None, 0, "", "") for i in range(200) for k in [("xx", "yy")[i % 2]]]
    rows += [(1000, "the house and water " * 8 + "der und haus wasser denken " * 8, None, None, 0, "", ""), (1001, None, "xx", None, 0, "", ""), (1002, "12 34 ?!", None, None, 0, "", ""), (1003, "", "yy", None, 0, "", "")]
    d = spark.createDataFrame(rows, DOCS)
    model = langid.train(d.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(d, model).collect()}
    assert all(got[i].lang_pred == ("xx", "yy")[i % 2] and 0 <= got[i].score <= 1 for i in range(200))
    assert len(got[1000].langs) == 2 and 0.3 < got[1000].score < 0.8
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert langid.predict(docs, model).count() == len(TEXTS)
    kept = langid.select(docs, model, 0.0)
    assert kept.columns == docs.columns and 0 < kept.count() < len(TEXTS)


def _simhash(t, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(docs, empty):
    fps = {i * 3: _simhash(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_balls_lose_no_link(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)).collect()
    root = {f: f for f in signed}
    for _ in fps:
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                    root[b] = min(root[a], root[b])
    want = {f: r for f, r in root.items() if sum(x == r for x in root.values()) > 1}
    assert {r.node: r.root for r in got} == want


def test_pipeline_drops_edited_copies(spark, tmp_path):
    """The pipeline's stage against brute force: copies with a few edits each, also many of one original."""
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice(_SYL) for _ in range(4))
    texts = [[word() for _ in range(rng.randint(60, 300))] for _ in range(30)]
    for k in range(90):
        t = list(texts[k % 30 if k < 60 else 0])
        for _ in range(rng.randint(1, 1 + len(t) // 45)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    linked = [(a, b) for a in root for b in root if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()}
    assert len(linked) > 100 and got == {i for i, r in enumerate(root) if i == r}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (4, "One  two"), (None, "alone")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in similar.near_duplicates(odd).collect()} == {(None, None), (None, 3), (1, 1), (2, 1), (3, 3), (4, 3)}
    assert similar.near_duplicates(table.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def _canon(s):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", n(n(s).casefold())).strip()


@pytest.mark.parametrize("bits", [64, 2])
def test_digest(docs, bits):
    got = {r.doc_id: r for r in digest.fingerprints(docs, span=10, bits=bits).collect()}
    ids, texts, seen = sorted(got, reverse=True), {i * 3: t or "" for i, t in enumerate(TEXTS)}, {}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        edited, r = t[: len(t) - h] + nxt[:h], got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(_canon(t) == _canon(edited)) and r.near_next == float(_canon(t) == _canon(nxt))
        assert seen.setdefault(r.fingerprint, _canon(t)) == _canon(t) and seen.setdefault(r.edited_fingerprint, _canon(edited)) == _canon(edited)
    assert len(seen) == len(set(seen.values()))


def test_digest_of_odd_tables(spark, empty):
    assert digest.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "Só", None, None, 0, "", "")], DOCS)
    assert digest.fingerprints(one).first().near_next == 1.0
    twice = spark.createDataFrame([(1, "a", None, None, 0, "", ""), (1, "b", None, None, 0, "", ""), (0, "c", None, None, 0, "", ""), (None, "d", None, None, 0, "", ""), (-(2**62), "É", None, None, 0, "", ""), (2**62, "É", None, None, 0, "", "")], DOCS)
    rows = digest.fingerprints(twice).collect()
    assert len(rows) == 6
    assert {r.fingerprint for r in rows if r.doc_id in (2**62, -(2**62))} == {next(r.fingerprint for r in rows if r.doc_id == 2**62)}


def test_max_score(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)] + [(400, None), (401, [0.1, None, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1]), (402, [float("nan")] * 8), (450, [float("inf")] * 8)]
    rows += [(i, rows[7][1]) for i in range(500, 520)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=60, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for a in (i for i in q if i % 50 == 0):
        best = sorted(((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a))[:5]
        assert sorted(got[a]) == [(k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_html():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header class=site>Name</header><nav><a href=1>one</a> <a href=2>two</a></nav>
    <div class="cookie-notice"><p>we use cookies on this site for all sorts of reasons, as you know</p></div>
    <article><h1>A &amp; B</h1><p>First&nbsp;par   with <b>bold</b> &lt;tags&gt; and an <a href=x>odd link</a>.<script>var t="</p>";</script></p><!-- <p>no</p> --><p>Ok.<div class="ad">Buy!</div><p>Last</article>
    <section id=comments><p>I think that this is a really good article and will say so here</p></section><form>mail <input> <button>go</button></form><aside>Side</aside><footer>&copy; x</footer>"""
    assert html_blocks.main_text(page) == "A & B\nFirst par with bold <tags> and an odd link .\nOk.\nLast".replace("link .", "link.")
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<p") == ""
    x, y = html_blocks.labelled()
    assert [html_blocks.decide(html_blocks.trained(), r) for r in x.tolist()] == y.tolist()
    html_blocks.main_text("<div>" * 6000 + "<!-- open " + "x" * 100_000)


def test_html_table(spark):
    got = html_blocks.extract(spark.createDataFrame([(1, "u", "<article><p>Só é.</article>"), (1, None, None), (2, "v", "")], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (1, "Só é.", 5), (2, "", 0)]


def _slow_units(text):
    """Sentences read character by character: after stops with their closing marks, after line ends, and after words whose sum of powers is 0 modulo 16."""
    m, base = 2**64 - 1, 0x9E3779B97F4A7C15
    ends, i, n = {0, len(text)}, 0, len(text)
    while i < n:
        j = i
        if text[i] in ".!?…":
            while j < n and text[j] in ".!?…":
                j += 1
            while j < n and text[j] in "\"'”’)]":
                j += 1
            if j < n and not text[j].isspace():
                i += 1
                continue
        elif text[i] == "\n":
            j += 1
        else:
            i += 1
            continue
        while j < n and text[j].isspace():
            j += 1
        ends.add(j)
        i = j
    words = list(re.finditer(r"\S+", text))
    for a, b in zip(words, words[1:]):
        h = sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(a[0].casefold().encode())) & m
        h ^= h >> 31
        if (h * 0xD6E8FEB86659FD93 & m) >> 32 & 15 == 0:
            ends.add(b.start())
    ends = sorted(ends)
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def _slow_repeats(rows, least_sentences=2, least_words=20):
    """Every run of enough sentences and words, enumerated, by (doc_id, text) in order: what is left of each text."""
    units = [[] if t is None else _slow_units(t) for _, t in rows]
    first: dict = {}
    for (d, _), u in sorted(zip(rows, units, strict=True), key=lambda x: (x[0][0] is not None, x[0][0])):
        for i in range(len(u)):
            for j in range(i + least_sentences, len(u) + 1):
                run = tuple("".join(u[i:j]).casefold().split())
                if len(run) >= least_words and u[i].strip() and u[j - 1].strip():
                    first.setdefault(run, d)
    left = []
    for (d, t), u in zip(rows, units, strict=True):
        gone, own = set(), set()
        for i in range(len(u)):
            for j in range(i + least_sentences, len(u) + 1):
                run = tuple("".join(u[i:j]).casefold().split())
                if run in first and u[i].strip() and u[j - 1].strip():
                    if first[run] != d or run in own:
                        gone |= set(range(i, j))
                    own.add(run)
        left.append(None if t is None else "".join(x for k, x in enumerate(u) if k not in gone))
    return left


def test_sentence_spans(docs, empty):
    texts = [t for t in TEXTS if t is None or len(t) < 3000 and not re.search("[぀-鿿]", t)]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(docs.where(F.col("text").isNull() | F.col("text").isin([t for t in texts if t is not None]))).collect()}
    rows = [(i * 3, t) for i, t in enumerate(TEXTS) if t in texts]
    want = _slow_repeats(rows)
    assert {i: r.text for i, r in got.items()} == {d: w for (d, _), w in zip(rows, want, strict=True)}
    assert all(r.n_removed == len(t or "") - len(r.text or "") for (d, t) in rows for r in [got[d]])
    n = len(TEXTS)
    assert PASSAGE[:40] in got[(n - 4) * 3].text and PASSAGE[60:120] not in got[(n - 3) * 3].text and len(got[(n - 2) * 3].text) < 150
    assert {r.fp for r in got.values()} == {r.hits for r in got.values()} == {"clash"}  # the caller's columns
    assert sentence_spans.remove_repeats(empty).count() == 0


def test_sentence_spans_of_odd_rows(spark):
    """Null and repeated doc_ids, repeats inside a text, and columns with the names that the operator uses."""
    body = " ".join(_sentence(11) for _ in range(4))
    rows = [(None, body), (None, body), (4, body), (4, f"{_sentence(9)} {body}"), (4, f"{_sentence(9)} {body}"), (7, f"{body} {_sentence(9)} {body}"), (8, None), (9, ""), (10, body)]
    first = [(i, *r) for i, r in enumerate(rows)]
    table = spark.createDataFrame([(*r, 5, "x", 1, 2, 3, 4) for r in first], "`order` int, doc_id long, text string, n_removed int, hits string, row int, a int, h1 long, c0 int")
    out = sentence_spans.remove_repeats(table)
    assert out.columns == ["order", "doc_id", "text", "hits", "row", "a", "h1", "c0", "n_removed"]
    got = [r.text for r in sorted(out.collect(), key=lambda r: r["order"])]
    assert got == _slow_repeats(rows) and got[:2] == [body, body] and got[2] == "" and got[8] == ""
    some = spark.createDataFrame([(i, d, t) for i, d, t in first if d is not None], "`order` int, doc_id long, text string")
    got = [r.text for r in sorted(sentence_spans.remove_repeats(some).collect(), key=lambda r: r["order"])]
    assert got == _slow_repeats([r for r in rows if r[0] is not None])


def test_sentence_spans_against_all_runs(spark):
    """Every run of 2 or more sentences and 20 or more words, enumerated here; passages end in short sentences."""
    rng = random.Random(21)
    passages = [[_sentence(n) for n in sizes] for sizes in ((30, 13, 6), (9, 12, 3, 2), (5, 5, 11, 4, 1), (19, 1), (12, 12, 12, 12, 2, 2))]
    texts = [[_sentence(30), *passages[0], _sentence(15)]]
    for _ in range(60):
        parts = [[_sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 4))] for _ in range(2)]
        texts.append(parts[0] + rng.choice(passages) + parts[1])
    units = [[" ".join(t)[a:b] for a, b in sentence_spans.sentences(" ".join(t))] for t in texts]
    seen, want = {}, []
    for k, t in enumerate(units):
        gone = set()
        for i in range(len(t)):
            for j in range(i + 2, len(t) + 1):
                run = " ".join("".join(t[i:j]).split()).casefold()
                if len(run.split()) >= 20 and seen.setdefault(run, (k, i)) != (k, i):
                    gone |= set(range(i, j))
        want.append("".join(x for i, x in enumerate(t) if i not in gone))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(table).collect()}
    assert got == dict(enumerate(want)) and any(len(w) < len(" ".join(t)) for w, t in zip(want, texts, strict=True))


def test_sentence_spans_in_any_script_and_host(spark):
    """Repeats in scripts without spaces, and a passage behind words without a full stop."""
    rng = random.Random(33)
    plain = lambda n: " ".join("".join(rng.choice(_SYL) for _ in range(4)) for _ in range(n))
    script = lambda first, n: "".join(chr(first + rng.randrange(300 if first > 0x3400 else 40)) for _ in range(n))
    chinese = "。".join(script(0x4E00, 18) for _ in range(6)) + "。"
    thai = script(0x0E01, 120)
    passage = plain(26) + ". " + plain(26) + "."
    texts = [f"{script(0x4E00, 30)}。{chinese}", f"{script(0x4E00, 41)}。{chinese}{script(0x4E00, 30)}。", script(0x0E01, 60) + thai, script(0x0E01, 90) + thai + script(0x0E01, 50)]
    texts += [f"{plain(11)}. {passage} {plain(9)}.", f"{plain(12)}. {plain(14)} {passage} {plain(12)}."]
    assert all("".join(t[a:b] for a, b in sentence_spans.sentences(t)) == t for t in texts)
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in (0, 2, 4)] == [texts[i] for i in (0, 2, 4)]
    assert chinese[:18] not in got[1] and chinese[-19:] not in got[1] and texts[1][:42] in got[1] and texts[1][-31:] in got[1]
    assert thai[40:80] not in got[3] and texts[3][:60] in got[3]
    left = set(got[5].split())
    assert len(left & set(passage.split())) <= 26 and not left & set(passage.split()[26:40])


def _counts(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_rollup(spark, docs, empty, tmp_path):
    other = public_tokenizers.path("byte_bpe_50k.json")
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    assert r.read().count() == 0
    old, new = token_rollup.counted(docs, "word", PATH), token_rollup.counted(docs, "byte", other)
    assert token_rollup.counted(empty, "word", PATH).count() == 0
    sums = {"word": _counts(TEXTS, PATH), "byte": _counts(TEXTS, other)}

    def want(inserted, version):
        out = {}
        for i in inserted:
            key = (None if i % 7 == 0 else f"s{i % 2}", ("en", "fr", None)[i % 3], version)
            n, t, c = out.get(key, (0, 0, 0))
            out[key] = (n + 1, t + sums[version][i], c + len(TEXTS[i] or ""))
        return out

    got = lambda: {(x.source, x.lang, x.version): (x.docs, x.tokens, x.chars) for x in r.read().collect()}
    assert r.commit(0, token_rollup.signed(old, 1)) and not r.commit(0, token_rollup.signed(old, 1))
    assert got() == want(range(len(TEXTS)), "word")
    assert r.commit(1, token_rollup.signed(old.where("doc_id >= 60"), -1))
    assert got() == want(range(20), "word")
    assert r.commit(2, token_rollup.signed(old.where("doc_id < 60"), -1).unionByName(token_rollup.signed(new.where("doc_id < 60"), 1)))
    assert got() == want(range(20), "byte")
    r.compact()
    assert not r.commit(1, token_rollup.signed(old, -1)) and r.batches() == [(0, 2)] and got() == want(range(20), "byte")
    assert r.commit(3, token_rollup.signed(new.where("doc_id < 60"), -1)) and r.read().count() == 0


def test_rollup_takes_batches_in_any_order_and_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    rows = spark.createDataFrame([(1, "s", "en", "w", 5, 9), (2, "s", None, "w", 3, 4)], "doc_id long, source string, lang string, version string, tokens long, chars long")
    one = token_rollup.signed(rows, 1)
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/late")
    assert r.commit(0, one) and r.commit(2, one)
    r.compact()
    assert r.batches() == [(0, 0), (2, 2)] and r.commit(1, one) and not r.commit(2, one)
    assert sorted(x.docs for x in r.read().collect()) == [3, 3]
    r.compact()
    assert r.batches() == [(0, 2)] and not r.commit(1, one) and sorted(x.tokens for x in r.read().collect()) == [9, 15]
    with ThreadPoolExecutor(4) as pool:  # several writers of one batch, as retries are
        done = list(pool.map(lambda _: token_rollup.Rollup(spark, f"file://{tmp_path}/late").commit(7, one), range(4)))
    assert sum(done) >= 1 and sorted(x.docs for x in r.read().collect()) == [4, 4] and r.batches() == [(0, 2), (7, 7)]
    r.compact()
    assert sorted(x.docs for x in r.read().collect()) == [4, 4]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, " ".join(" ".join(rng.choice(["the", "house", "and", "water", "tree", "walks", "green", "stone", "river", "bird"]) for _ in range(9)).capitalize() + "." for _ in range(12)), "en", "s", 0) for i in range(40)]
    rows += [(40, rows[3][1], "en", "s", 0), (41, "!!! 123", None, "s", 0), (42, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == set(range(40))
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_grams_of_words():
    import collections

    listed = ["abab", "é", "x"]
    got = collections.Counter()
    buckets, owner = langid._grams(listed)
    for b, o in zip(buckets.tolist(), owner.tolist(), strict=True):
        got[(o, b // langid.BUCKETS)] += 1
    want = collections.Counter()
    for o, w in enumerate(listed):
        raw = b" " + w.encode() + b" "
        for k, n in enumerate(langid.ORDERS):
            want[(o, k)] = max(0, len(raw) - n + 1 - (2 if n == 1 else 0))
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert len(langid._grams([])[0]) == 0
    same = [b for b, o in zip(*(x.tolist() for x in langid._grams(["ab", "ab"])), strict=True)]
    assert collections.Counter(same) and all(v % 2 == 0 for v in collections.Counter(same).values())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_of_odd_texts_have_the_tokenizers_ids(name):
    """Marks, contractions, case that composes, odd white space and special tokens, with a memory that is let go every few texts."""
    tok = bpe.Tokenizer.from_file(public_tokenizers.path(name))
    enc, r = bpe.UnitEncoder(public_tokenizers.path(name), limit=500), random.Random(5)
    letters = "aAéÉßŒœıİſ'’sStT<|>.,!?#$%&*()0123  \n\t\x1c̀中ΣςŉĸĿ-_"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "'s's 'S x''s !'s", "ŉ Ŀl ŀ ſ ẞ", "", " \n"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    got = [i for at in range(0, len(texts), 50) for i in enc.encode(texts[at : at + 50])]
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == want


def _exact_groups(rows, shingle=5, least=0.8):
    """The smallest id of each row's group, by all pairs."""
    sets = [set(similar.shingles(t, shingle).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            n = len(x & sets[j])
            if n >= least * (len(x) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("own", [38, 60])
def test_copies_among_texts_with_a_long_common_part(spark, own):
    """Texts of similarity just below the bound fill groups of any number of min-hashes; no copy among them is lost, and none too much is linked."""
    rng = random.Random(own)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common, rows = [word() for _ in range(300)], []
    for i in range(120):
        words = common + [word() for _ in range(own)]
        rows.append((3 * i, " ".join(words)))
        for k in (1, 2)[: rng.randint(1, 2)]:
            edited = list(words)
            for _ in range(5):
                edited[rng.randrange(len(edited))] = word()
            rows.append((3 * i + k, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()}
    assert got == _exact_groups(rows) and len(set(got.values())) == 120
