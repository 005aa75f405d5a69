"""Language identification by multilingual mixture inference.

Each word has a likelihood under every learned language, from its byte n-grams.
Expectation-maximisation estimates the proportions of languages in a document;
the set of languages is that with the best likelihood less a penalty for each
language. The language with the largest proportion is predicted.

Null texts and texts without a letter are `und` with score 0. Training rows
with null text or language are left out. doc_id takes no part: rows of equal or null
doc_id are each answered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_groups
from .kept import nothing

_WORD = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Longer runs of letters are cut, so that scripts without spaces have words as well.
LONGEST = 16
#: Characters of the texts whose words are answered together.
NEAR = 1_000_000


def words(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def _grams(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, order by order, and the word of each."""
    raw = " ".join(["", *listed, ""]).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    space = data == 32
    word = np.cumsum(space) - 1
    buckets, owner = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(257) + data[n - 1 :]
        if n not in ORDERS:
            continue
        inner = np.zeros(m, np.int64)  # spaces inside: an n-gram may begin or end with one, not pass over it
        for k in range(1, n - 1):
            inner += space[k : k + m]
        ok = inner == 0
        if n <= 2:  # nor be spaces alone
            ok &= ~(space[:m] & space[n - 1 :])
        x = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((ORDERS.index(n) * BUCKETS + (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)))
        owner.append(word[:m][ok])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owner)


def _count(batches, names):
    at = {n: i for i, n in enumerate(names)}
    nothing()
    total = np.zeros((len(names), len(ORDERS) * BUCKETS), np.int64)
    for batch, texts in text_groups(batches):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lang, text in zip(langs, texts, strict=True):
            total[at[lang]] += np.bincount(_grams(words(text))[0], minlength=total.shape[1])
    lang, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])


class Model:
    """Log-likelihoods of n-gram buckets under each language, and the inference."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        table = []
        for k in range(len(ORDERS)):
            c = counts[:, k * BUCKETS : (k + 1) * BUCKETS] + 0.2
            table.append(np.log(c / c.sum(axis=1, keepdims=True)))
        #: orders overlap, so that each counts for its share of a word only
        self.table = (np.concatenate(table, axis=1) / len(ORDERS)).T.astype(np.float32).copy()

    def likelihoods(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Of each text its words, and their likelihoods over the best language's. Words are known while these texts are answered, no longer."""
        places: dict[str, int] = {}
        listed = [np.fromiter([places.setdefault(w, len(places)) for w in words(t)], np.int32) for t in texts]
        known, rows = list(places), np.empty((len(places), len(self.names)), np.float64)
        del places
        for i in range(0, len(known), 10_000):
            part = known[i : i + 10_000]
            buckets, owner = _grams(part)
            ll = np.stack([np.bincount(owner, self.table[buckets, k], minlength=len(part))[: len(part)] for k in range(len(self.names))], axis=1)
            ll -= ll.max(axis=1, keepdims=True)
            rows[i : i + len(part)] = np.exp(np.maximum(ll, -30))
        for at in listed:
            yield [known[k] for k in at.tolist()], rows[at]

    def mixture(self, p: np.ndarray, steps: int = 40, penalty: float = 3.0) -> np.ndarray:
        """Proportions of the languages in a document with word likelihoods p.

        penalty: what each further language must add to the log-likelihood, in
        units of the logarithm of the number of words.
        """
        n, full = len(p), p.shape[1]

        def em(cols: list[int]) -> tuple[np.ndarray, float]:
            q, pi = np.ascontiguousarray(p[:, cols]), np.full(len(cols), 1 / len(cols))
            if len(cols) > 1:
                for _ in range(steps):
                    new = pi * (q.T @ (1 / (q @ pi))) / n
                    moved = np.abs(new - pi).max()
                    pi = new
                    if moved < 1e-4:
                        break
            return pi, float(np.log(q @ pi).sum())

        pi, _ = em(list(range(full)))
        order = np.argsort(-pi, kind="stable").tolist()
        best, best_ll = None, 0.0
        for k in range(1, full + 1):
            if k > 1 and pi[order[k - 1]] < 0.005:
                break
            part, ll = em(order[:k])
            ll -= penalty * (k - 1) * np.log(n + 1)
            if best is None or ll > best_ll:
                best, best_ll = (order[:k], part), ll
        out = np.zeros(full)
        out[best[0]] = best[1]
        return out


def train(rows: DataFrame, sample: int = 3000) -> Model | None:
    """A model of the languages in rows (doc_id, text, lang); None where no row can be used.

    sample: rows of each language that are counted, about: rows are taken by a
    hash of doc_id, at the rate that gives so many; all where there are fewer.
    """
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    found = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])  # one row for each language
    if not found:
        return None
    names = [r["lang"] for r in found]
    rate = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, sample / r["count"]))])
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(share < rate[F.col("lang")])
    parts = max(2, min(64, -(-len(names) * sample // 2000)))
    counted = (
        taken.select("lang", "text").repartition(parts).mapInArrow(lambda b: _count(b, names), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    counts = np.zeros((len(names), len(ORDERS) * BUCKETS), np.float64)
    got = counted.toPandas()  # languages x buckets at most
    counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(names, counts)


def _predict(batches, model, least):
    for batch, texts in text_groups(batches, most=NEAR):
        pred, score, langs = [], [], []
        for text, (w, p) in zip(texts, model.likelihoods(texts), strict=True):
            if not w or not (any(map(str.isalpha, w)) or any(map(str.isalpha, text))):
                pred.append("und")
                score.append(0.0)
                langs.append([])
                continue
            pi = model.mixture(p)
            top = int(pi.argmax())
            pred.append(model.names[top])
            score.append(float(min(1.0, pi[top])))
            langs.append([{"lang": model.names[k], "share": float(pi[k])} for k in np.argsort(-pi, kind="stable") if pi[k] >= least])
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, kind)], ["doc_id", "lang_pred", "score", "langs"])


def _select(batches, model, least):
    for batch, texts in text_groups(batches, most=NEAR):
        keep = [bool(w) and any(map(str.isalpha, w)) and float(model.mixture(p).max()) >= least for w, p in model.likelihoods(texts)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def select(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs that have a language whose proportion is `least` or more, all their columns; none where there is no model."""
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table))
    return docs.mapInArrow(lambda b: _select(b, _model(shared), least), docs.schema)


def predict(docs: DataFrame, model: Model | None, least: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of lang_pred) and langs (all of the chosen set) of every row of docs (doc_id, text)."""
    schema = "doc_id long, lang_pred string, score double, langs array<struct<lang string, share double>>"
    if model is None:
        none = F.array().cast("array<struct<lang string, share double>>")
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("langs"))
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table))  # languages x buckets x 4 bytes, whatever the input
    return docs.select("doc_id", "text").mapInArrow(lambda b: _predict(b, _model(shared), least), schema)


def _model(shared) -> Model:
    """The broadcast model."""
    nothing()
    model = Model.__new__(Model)
    model.names, model.table = shared.value
    return model


def held_out(doc_id="doc_id"):
    """Rows kept from training: a fifth, by the CRC of doc_id's text. That of a null doc_id counts as empty: held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
