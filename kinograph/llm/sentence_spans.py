"""Substring dedup by sliding sentence spans.

Texts are taken apart into sentences. The shortest runs of consecutive sentences
with enough words that start and that end with each sentence are hashed; runs that
occur more than once are joined over the whole corpus, and the sentences that any
but the first of equal runs covers go. The first is that with the least doc_id, then the least place. Comparison
is without case and without regard to the kind and amount of white space.

Null and empty texts stay as they are. Repeats inside a text count. Rows with
equal doc_ids count as one document: they take nothing from each other. Rows with
null doc_id come first and lose only what repeats inside themselves. Other columns
are carried, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import power_tables, text_groups
from .frames import cut, drop, written
from .kept import nothing

_END = re.compile(r"(?:[.!?…]+[\"'”’)\]]*(?:\s+|$)|[。！？｡]+[\"'”’)\]」』）】》〉]*\s*|\n\s*)")
#: Letters of scripts without spaces: Thai and Lao, Burmese, Khmer, kana, Chinese. Each counts as a word.
_LETTER = "฀-໿က-႟ក-៿々-〇ぁ-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_ODD = re.compile(f"[{_LETTER}。！？｡]")
_WORD = re.compile(rf"[{_LETTER}]|[^\s{_LETTER}]+")
#: By character (0xFFFF for all beyond): 1 white space, 2 what a match of _END may begin with.
_KIND = np.zeros(0x10000, np.uint8)
_KIND[[c for c in range(0xFFFF) if chr(c).isspace()]] = 1
_KIND[[ord(c) for c in ".!?…。！？｡\n"]] |= 2
#: One word in so many ends a unit.
_CUT = 16


def _spread(words: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from sums of powers over all their bytes."""
    up, down = power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((np.frombuffer(words, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(words)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(32)


class _Parts:
    """A text's units and words. units: where they begin, and the text's end. flat: its words in one case, parted by spaces; places: where they begin there; before: words before each unit."""

    def __init__(self, text: str):
        odd = not text.isascii() and _ODD.search(text) is not None
        if text.isascii():
            kind = _KIND[np.frombuffer(text.encode(), np.uint8)]
        else:
            kind = _KIND[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
        if odd:
            found = list(_WORD.finditer(text))
            words, at = [m[0].casefold() for m in found], np.array([m.start() for m in found], np.int64)
        else:
            words = text.casefold().split()
            solid = kind & 1 == 0
            at = np.flatnonzero(solid & np.append(True, ~solid)[:-1])
        self.flat = " ".join(words).encode("utf-8", "surrogatepass")
        spaces = np.flatnonzero(np.frombuffer(self.flat, np.uint8) == 32)
        self.places = np.concatenate([[0], spaces + 1, [len(self.flat) + 1]]) if words else np.zeros(1, np.int64)
        chosen = _spread(self.flat, self.places[:-1], self.places[1:] - 1) % np.uint64(_CUT) == 0
        stops, end = [], 0
        for i in np.flatnonzero(kind & 2).tolist():
            if i >= end and (m := _END.match(text, i)):
                end = m.end()
                stops.append(end)
        self.units = np.unique(np.concatenate([at[1:][chosen[:-1]], np.array([0, *stops, len(text)], np.int64)]))
        self.before = np.searchsorted(at, self.units)


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences, white space after them included; together they are the whole text.

    All are cut after the words that a hash chooses, so that text without full
    stops has units as well and a passage has the same ones in any text.
    """
    ends = _Parts(text).units.tolist()
    return list(zip(ends, ends[1:]))


def _runs(text: str, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Where the sentences begin; of each run its first sentence, the one behind its last, and its hash."""
    parts = _Parts(text)
    units, before, places, flat = parts.units, parts.before, parts.places, parts.flat
    n = len(units) - 1
    if n < least_sentences:
        return units, np.empty(0, np.int64), np.empty(0, np.int64), []
    full = before[1:] > before[:-1]
    i = np.arange(n)
    end = np.maximum(i + least_sentences, np.searchsorted(before, before[:-1] + least_words))
    starting = (end <= n) & full
    j = np.arange(1, n + 1)
    begin = np.minimum(j - least_sentences, np.searchsorted(before, before[1:] - least_words, "right") - 1)
    ending = (begin >= 0) & full & full[np.maximum(begin, 0)]
    pairs = np.unique(np.concatenate([i[starting] * (n + 1) + end[starting], begin[ending] * (n + 1) + j[ending]]))
    i, j = pairs // (n + 1), pairs % (n + 1)
    return units, i, j, [xxhash.xxh3_128_digest(flat[a:b]) for a, b in zip(places[before[i]].tolist(), (places[before[j]] - 1).tolist(), strict=True)]


def runs(text: str, least_sentences: int, least_words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, bytes]]]:
    """The sentences, and of each run its first sentence, the one behind its last, and its hash.

    For each sentence two runs, the shortest of `least_sentences` or more with
    `least_words` or more that starts with it and the shortest that ends with it:
    those inside any longer run cover all of it.
    """
    units, i, j, hashes = _runs(text, least_sentences, least_words)
    ends = units.tolist()
    return list(zip(ends, ends[1:])), list(zip(i.tolist(), j.tolist(), hashes, strict=True))


_HASH = np.dtype([("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")])
_SPANS = "h1 long, h2 int, doc_id long, row binary, a int, b int, again boolean"


def _list(batches, least_sentences, least_words):
    """The runs of each text: hash, row, the characters [a, b), and whether the same run began before in this text."""
    nothing()
    for batch, texts in text_groups(batches):
        hashes: list[bytes] = []
        cols: list[list] = [[], [], []]
        counts = []
        for text in texts:
            units, i, j, found = _runs(text, least_sentences, least_words)
            counts.append(len(i))
            if not len(i):
                continue
            again = np.ones(len(i), bool)
            again[np.unique(np.frombuffer(b"".join(found), _HASH)["h1"], return_index=True)[1]] = False
            hashes += found
            for col, v in zip(cols, (units[i], units[j], again), strict=True):
                col.append(v)
        if not hashes:
            continue
        h = np.frombuffer(b"".join(hashes), _HASH)
        owner = pa.array(np.repeat(np.arange(len(texts)), counts))
        a, b, again = (np.concatenate(c) for c in cols)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(h["h1"])), pa.array(np.ascontiguousarray(h["h2"])), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(again)],
            ["h1", "h2", "doc_id", "row", "a", "b", "again"],
        )


def _left(text: str, a: np.ndarray, b: np.ndarray) -> tuple[str, int]:
    """A text without its characters [a, b), and how many went."""
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    begins, ends = a[new], b[np.append(new[1:], len(a)) - 1]
    kept, at = [], 0
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:begin])
        at = end
    return "".join([*kept, text[at:]]), int((ends - begins).sum())


def _remove(batches, place):
    """The texts of rows with hits less these; other rows as they are. place: that of text; hits stand last."""
    nothing()
    for batch in batches:
        hits, texts = batch.column(batch.num_columns - 1), batch.column(place)
        removed = np.zeros(batch.num_rows, np.int32)
        which = np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False))
        if len(which):
            at = hits.offsets.to_numpy()
            a, b = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            new = []
            for k, text in zip(which.tolist(), texts.take(pa.array(which)).to_pylist(), strict=True):
                text, removed[k] = _left(text, a[at[k] : at[k + 1]], b[at[k] : at[k + 1]])
                new.append(text)
            texts = pc.replace_with_mask(texts, hits.is_valid(), pa.array(new, texts.type))
        cols = [texts if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(removed)], [*batch.schema.names[:-1], "n"])


def remove_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, count_as: str = "n_removed") -> DataFrame:
    """docs with text less its repeated runs, and the number of characters that went as `count_as`, instead of any column of that name.

    The runs are listed once, in a table of the shared folder. Those that come
    again inside their own text go without a join; the others are grouped by
    hash, and joined with the least doc_id of hashes that several documents have.
    """
    docs = docs.drop(count_as)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])  # whatever the names are
    place = docs.columns.index("text")
    doc_id, text = f"c{docs.columns.index('doc_id')}", f"c{place}"
    keyed = plain.withColumn("row", F.unhex(F.md5(text)))  # rows of one doc_id are told apart by their texts
    spans = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), "row", F.col(text).alias("text")).mapInArrow(lambda b: _list(b, least_sentences, least_words), _SPANS)
    since = written()
    spans = cut(spans, "spans")
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    once = spans.where("not again")
    several = once.groupBy("h1", "h2").agg(F.min(order).alias("least"), F.max(order).alias("most")).where("least < most").drop("most")
    several = cut(several, "several")  # read back, so that both sides of the join have an exchange of their own and hot runs are split
    later = once.join(several, ["h1", "h2"]).where(order > F.col("least"))
    hit = lambda df: df.select("doc_id", "row", F.struct("a", "b").alias("hit"))
    hits = hit(later).unionByName(hit(spans.where("again"))).groupBy("doc_id", "row").agg(F.collect_list("hit").alias("hits"))
    hits = cut(hits.withColumnRenamed("row", "key"), "hits").hint("shuffle_hash")
    drop(since, but_last=1)  # the spans have been read
    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    full = keyed.join(hits, F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col("row") == F.col("key")), "left").select(*plain.columns, "hits")
    out = full.mapInArrow(lambda b: _remove(b, place), f"{fields}, n int")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("n").alias(count_as))
