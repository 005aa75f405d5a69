"""Registered queries over whole small tables, against readers written here."""

import hashlib
from collections import Counter

import pytest

from kinograph.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_languages_of_held_out_documents(spark):
    """Accuracy on the fifth of the 0.01 documents that training never sees."""
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null").collect()}
    got = [(r.lang_pred, known[r.doc_id]) for r in queries.op5_language_mixture(spark, sf).collect() if r.held_out and r.doc_id in known and r.lang_pred != "und"]
    assert len(got) > 100 and sum(a == b for a, b in got) / len(got) > 0.97


def test_token_rollups_of_all_documents(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    tok = {v: Tokenizer.from_file(public_tokenizers.path(f"{v}.json")) for v in ("word_bpe_49k", "byte_bpe_50k")}
    for t in tok.values():
        t.no_truncation()
    want: Counter = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect():
        if r.doc_id % 7:
            version = "word_bpe_49k" if r.doc_id % 11 else "byte_bpe_50k"
            text = r.text or ""
            for k, n in (("docs", 1), ("tokens", len(tok[version].encode(text, add_special_tokens=False).ids)), ("chars", len(text))):
                want[r.source, r.lang, version, k] += n
    got = {(r.source, r.lang, r.version, k): r[k] for r in queries.op8_token_rollups(spark, sf).collect() for k in ("docs", "tokens", "chars")}
    assert got == dict(want)


def test_substrings_of_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    seen: set = set()
    want = {}
    for d, b in rows:
        windows = [b[p : p + 50] for p in range(len(b) - 49)]
        gone = bytearray(len(b))
        for p, w in enumerate(windows):
            if w in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(windows)
        want[d] = (len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op4_run_length_index(spark, sf).collect()} == want
