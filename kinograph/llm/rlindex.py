"""Removal of long repeats between documents by run-length indexes.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller id. Repeats share the least hash of the k-grams in any
`length` bytes, so texts are taken apart into fragments of windows that have
one such least hash; fragments whose hash only one document has are left out,
and the others are dealt out by it. Hashes with very many different fragments
are split by more of the bytes around the k-gram, so that a frequent line with
other text around it each time fills no bucket; equal windows still meet.

A bucket indexes, of each hash, the fragments of the documents with the least ids:
a run-compressed Burrows-Wheeler transform, with the text positions at both ends of
each run. All fragments are streamed against it from their ends: a matching
statistic grows by one LF step as long as the run has the fragment's byte, else it
jumps to the nearest run that has it, above or below, whichever the longer common
extension from the sampled positions speaks for. Windows with a match of `length`
bytes have their least document; what no index had goes on to the next, over eight
times as many fragments of a hash. In repetitive text the first index settles nearly
all. The answers go back to the blocks of documents, not to single documents, so
that a passage that a third of all documents share costs a block one row.

Null texts are empty. Rows of equal doc_id don't remove each other. A null doc_id
counts as the largest and stays null; such rows don't remove each other either.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import power_tables, rolling, text_groups
from .frames import cut
from .kept import nothing

GRAM = 20
#: Fragments of one hash, those that are alike in one block once, from which on the hash is split.
HOT = 20_000
#: Windows of the longest text that is streamed in one piece.
SPAN = 96
_LAST = (1 << 63) - 1


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


# Blocks


def _block_rows(batches, size):
    nothing()
    held: tuple[list, list] = ([], [])
    total = 0

    def row():
        data = b"".join(held[1])
        ids = np.array([_LAST if i is None else i for i in held[0]], np.int64)
        null = np.array([i is None for i in held[0]], np.uint8)
        lens = np.array([len(t) for t in held[1]], np.int64)
        mark = int.from_bytes(hashlib.blake2b(ids.tobytes() + lens.tobytes() + data[:4096], digest_size=7).digest(), "big")
        return pa.RecordBatch.from_arrays(
            [pa.array([mark], pa.int64()), pa.array([_zip(ids)], pa.binary()), pa.array([_zip(lens)], pa.binary()), pa.array([_zip(null)], pa.binary()), pa.array([_zip(data)], pa.binary())],
            ["block", "ids", "lens", "null", "data"],
        )

    for batch, texts in text_groups(batches):
        for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            held[0].append(i)
            held[1].append(raw)
            total += len(raw)
            if total >= size:
                yield row()
                held, total = ([], []), 0
    if held[0]:
        yield row()


def blocks(docs: DataFrame, size: int = 2_500_000) -> DataFrame:
    """The rows of docs (doc_id, text) in blocks of some `size` bytes, one row each, written to the shared folder."""
    schema = "block long, ids binary, lens binary, null binary, data binary"
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: _block_rows(b, size), schema)
    return cut(rows.withColumn("block", F.xxhash64("block", F.monotonically_increasing_id())), "blocks")


def _least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The least hash of the k-grams of each window of `length` bytes, by its start."""
    h = rolling(data, GRAM)
    span, have = length - GRAM + 1, 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < span:
        h = np.minimum(h[: len(h) - (span - have)], h[span - have :])
    return h


def fragments(data: np.ndarray, lens: np.ndarray, length: int, part: int = 400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows inside one document that have the same least hash: their hash, document number, first window and number of windows."""
    ends = np.cumsum(lens)
    out: list[tuple] = []
    first, n = 0, len(lens)
    while first < n:
        begin = int(ends[first] - lens[first])
        last = int(np.searchsorted(ends, begin + part, "right"))
        last = min(n, max(last, first + 1))
        stop = int(ends[last - 1])
        least = _least_hashes(data[begin:stop], length) if stop - begin >= length else np.empty(0, np.uint64)
        if len(least):
            owner = np.repeat(np.arange(first, last), lens[first:last])
            inside = owner[: len(least)] == owner[length - 1 :]
            new = np.empty(len(least), bool)
            new[0] = True
            new[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1]) | ~inside[:-1]
            new &= inside
            at = np.flatnonzero(new)
            if len(at):
                # windows from a run's start up to the next run or to the end of the document's windows
                run_end = np.minimum(np.append(at[1:], len(least)), ends[owner[at]] - begin - length + 1)
                out.append((least[at], owner[at], at + begin, run_end - at))
        first = last
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def _open(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(_unzip(row["ids"]), np.int64), np.frombuffer(_unzip(row["lens"]), np.int64), _unzip(row["data"])


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit key of a least hash. Unlike hashes with one key make a fragment a candidate without need, never the reverse."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bounds(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(bucket):
        return []
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[at].tolist(), at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True))


def _contents(data: np.ndarray, length: int, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each fragment's bytes."""
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[start + count + length - 1] - sums[start]) * down[start]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def _keys(h: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (bucket, key) in order, whether several documents of the block have it, and each fragment's place among them."""
    b, k = _split(h, buckets)
    code, where = np.unique((b.astype(np.uint64) << np.uint64(32)) | k, return_inverse=True)
    low, high = np.full(len(code), _LAST), np.full(len(code), -1)
    np.minimum.at(low, where, doc)
    np.maximum.at(high, where, doc)
    return (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), low < high, where


def _list_keys(batches, length, buckets):
    for batch in batches:
        for row in batch.to_pylist():
            _, lens, raw = _open(row)
            data = np.frombuffer(raw, np.uint8)
            h, doc, start, count = fragments(data, lens, length)
            b, k, many, where = _keys(h, doc, buckets)
            # unlike fragments of each key
            content = _contents(data, length, start, count)
            by = np.lexsort((content, where))
            w, c = where[by], content[by]
            unlike = np.bincount(w[np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])))] if len(w) else w, minlength=len(k)).astype(np.uint32)
            cols: list[list] = [[], [], [], [], []]
            for bucket, i, j in _bounds(b):
                for col, v in zip(cols, (bucket, row["block"], _zip(np.diff(k[i:j], prepend=np.uint32(0)).astype(np.uint32)), _zip(np.packbits(many[i:j])), _zip(unlike[i:j])), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "block", "keys", "many", "unlike"])


def _shared_keys(hot: int):
    def shared_keys(part: pd.DataFrame) -> pd.DataFrame:
        """For each block of a bucket two bits for each of its keys: whether several documents of the corpus have it, and whether it has so many fragments that it is to be split."""
        keys = [np.cumsum(np.frombuffer(_unzip(k), np.uint32), dtype=np.uint32) for k in part["keys"]]
        many = [np.unpackbits(np.frombuffer(_unzip(m), np.uint8), count=len(k)).astype(bool) for m, k in zip(part["many"], keys, strict=True)]
        _, where, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[where[np.concatenate(many)]] = True
        total = np.bincount(where, np.concatenate([np.frombuffer(_unzip(x), np.uint32) for x in part["unlike"]]))
        bits, at = [], 0
        for k in keys:
            w = where[at : at + len(k)]
            bits.append(_zip(np.packbits(np.concatenate([shared[w], total[w] >= hot]))))
            at += len(k)
        return pd.DataFrame({"block": part["block"], "bucket": part["bucket"], "bits": bits})

    return shared_keys


def _split_hot(data: np.ndarray, length: int, h: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments with hot hashes as smaller ones, each of windows that agree in more bytes than the k-gram.

    In a window the first k-gram of the least hash is widened three times, on the
    side where the window has more bytes left, by half of what is left; the new
    hash is that of these bytes, so equal windows have equal ones.
    """
    n = int(count.sum())
    ends = np.cumsum(count)
    of = np.repeat(np.arange(len(h)), count)
    at = start[of] + np.arange(n) - np.repeat(ends - count, count)
    grams = rolling(data, GRAM)
    # the first place from each window's start on that has the least hash: hits are in order, and every window has one
    span = count + length - GRAM
    every = np.repeat(start, span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    hits = np.unique(every[grams[every] == np.repeat(h, span)])
    # a hit of another fragment's hash may lie between: keep to hits of the own hash by (hash, place)
    _, code = np.unique(np.concatenate([h, grams[hits]]), return_inverse=True)
    mine, theirs = code[: len(h)].astype(np.int64), code[len(h) :].astype(np.int64)
    big = np.int64(len(data) + 1)
    table = np.sort(theirs * big + hits)
    lo = table[np.searchsorted(table, mine[of] * big + at)] % big
    hi, stop = lo + GRAM, at + length
    for _ in range(3):
        left, right = lo - at, stop - hi
        more = (left + right) // 2
        wide = right >= left
        hi = np.where(wide, hi + np.minimum(more, right), hi)
        lo = np.where(wide, lo, lo - np.minimum(more, left))
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    core = (sums[hi] - sums[lo]) * down[lo]
    core ^= core >> np.uint64(31)
    core *= np.uint64(0xD6E8FEB86659FD93)
    core ^= core >> np.uint64(32)
    new = np.flatnonzero(np.append(True, (core[1:] != core[:-1]) | (of[1:] != of[:-1])))
    return core[new], doc[of[new]], at[new], np.diff(np.append(new, n))


def _candidates(row, length, buckets) -> tuple:
    """Of a block: its documents, bytes and the fragments that may be repeats, by bucket: bucket, key, document, first window, windows."""
    ids, lens, raw = _open(row)
    data = np.frombuffer(raw, np.uint8)
    h, doc, start, count = fragments(data, lens, length)
    b, _, _, place = _keys(h, doc, buckets)
    shared, hot = np.zeros(len(b), bool), np.zeros(len(b), bool)
    bits = {s["bucket"]: s["bits"] for s in row["shared"] or ()}
    for bucket, i, j in _bounds(b):
        both = np.unpackbits(np.frombuffer(_unzip(bits[bucket]), np.uint8), count=2 * (j - i)).astype(bool)
        shared[i:j], hot[i:j] = both[: j - i], both[j - i :]
    keep, split = (shared & ~hot)[place], (shared & hot)[place]
    found = [x[keep] for x in (h, doc, start, count)]
    if split.any():
        found = [np.concatenate(x) for x in zip(found, _split_hot(data, length, *(x[split] for x in (h, doc, start, count))), strict=True)]
    fb, fk = _split(found[0], buckets)
    order = np.argsort(fb, kind="stable")
    return ids, lens, raw, fb[order], fk[order], *(x[order] for x in found[1:])


def _distinct(raw: bytes, start: np.ndarray, count: np.ndarray, length: int, begin: int, end: int) -> tuple[list[bytes], np.ndarray]:
    known: dict[bytes, int] = {}
    number = np.empty(end - begin, np.int64)
    for i, (s, c) in enumerate(zip(start[begin:end].tolist(), count[begin:end].tolist(), strict=True)):
        number[i] = known.setdefault(raw[s : s + c + length - 1], len(known))
    return list(known), number


def _send_fragments(batches, length, buckets):
    for batch in batches:
        for row in batch.to_pylist():
            ids, _, raw, b, key, doc, start, count = _candidates(row, length, buckets)
            cols: list[list] = [[], [], [], [], [], []]
            for bucket, i, j in _bounds(b):
                texts, number = _distinct(raw, start, count, length, i, j)
                least = np.full(len(texts), _LAST, np.int64)
                np.minimum.at(least, number, ids[doc[i:j]])
                keys = np.empty(len(texts), np.uint32)
                keys[number] = key[i:j]
                for col, v in zip(cols, (bucket, row["block"], _zip(np.array([len(t) for t in texts], np.uint32)), _zip(b"".join(texts)), _zip(least), _zip(keys)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "block", "lens", "data", "least", "keys"])


# The index of a bucket


class Marks:
    """A bit vector with the number of ones up to each row, by counts of 64 rows."""

    def __init__(self, at: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64, np.uint8)
        bits[at] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts

    def last(self, rows: np.ndarray) -> np.ndarray:
        """The number, from 0, of the last mark at or before each row."""
        word = rows >> 6
        ones = self.words[word] << (np.uint64(63) - (rows & 63).astype(np.uint64))
        return self.before[word] + np.bitwise_count(ones) - 1


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a collection of fragments, against which texts are streamed.

    Kept: of each run its symbol, its first row, the row that this row's LF step leads
    to, and the text positions of its first and last row; marks at the first row of each
    group of rows that agree in `length` symbols, and the least document of the group;
    the text, for common extensions. Symbols are bytes plus one, which UTF-8 leaves room
    for; 0 ends a fragment.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int(sizes.sum()) + len(texts)
        t = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)  # 0xff is no byte of UTF-8
        order, same = _sorted_suffixes(t.astype(np.int64), length)
        before = t[order - 1]  # of row 0's suffix, the whole text's last symbol
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        last = np.append(first[1:], n) - 1
        self.symbols, self.first, self.last, self.runs = before[first], first.astype(np.int32), last.astype(np.int32), Marks(first, n)
        by = np.argsort(self.symbols, kind="stable")
        lengths = (last - first + 1)[by]
        self.leads = np.empty(len(first), np.int64)
        self.leads[by] = np.cumsum(lengths) - lengths
        self.leads = self.leads.astype(np.int32)
        self.first_at, self.last_at = order[first].astype(np.int32), order[last].astype(np.int32)
        self.ordered = self.symbols[by].astype(np.int64) * len(first) + by  # runs by symbol, then place
        group = np.flatnonzero(~same)
        of = np.repeat(np.arange(len(texts)), sizes + 1)[order]
        self.groups, self.group_least = Marks(group, n), np.minimum.reduceat(docs[of], group)
        self.start = np.int32(order[0])
        self.words = np.lib.stride_tricks.as_strided(np.concatenate([t, np.zeros(length + 16, np.uint8)]), (n + length + 8, 8), (1, 1))

    def _word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at].view("<u8")[:, 0]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """In how many symbols, `most` at most, the text agrees from positions a and b on."""
        out = most.copy()
        open_ = np.flatnonzero(most > 0)
        done = 0
        while len(open_):
            differ = self._word(a[open_] + done) ^ self._word(b[open_] + done)
            low = differ & (~differ + np.uint64(1))
            agree = (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int32) + done  # 8 where none differs
            out[open_] = np.minimum(agree, most[open_])
            done += 8
            open_ = open_[(agree == done) & (most[open_] > done)]
        return out

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The least document of each window of each text, _LAST where the index lacks it, and where each text's begin.

        The matching statistics of all texts, from their ends; all step together,
        longest first, so that those still running are the first of the array. Texts
        whose match can't reach the full length any more are let go.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)
        windows = sizes - self.length + 1
        place = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), _LAST, np.int64)
        by = np.argsort(-sizes, kind="stable")
        ends, sizes, at = np.cumsum(sizes)[by], sizes[by], place[by]
        rows, position, have = np.zeros(len(texts), np.int32), np.full(len(texts), self.start), np.zeros(len(texts), np.int32)
        sizes = sizes.astype(np.int32)
        n_runs = np.int64(len(self.first))
        step = 0
        while True:
            hope = have + sizes - step >= self.length
            if np.count_nonzero(hope) < 0.9 * len(hope):
                rows, position, have, sizes, ends, at = (x[hope] for x in (rows, position, have, sizes, ends, at))
            step += 1
            n = int(np.searchsorted(-sizes, -step, "right"))
            if not n:
                return out, place
            c = flat[ends[:n] - step]
            run = self.runs.last(rows[:n])
            other = np.flatnonzero(self.symbols[run] != c)
            if len(other):
                key = c[other].astype(np.int64) * n_runs
                j = np.searchsorted(self.ordered, key + run[other])
                below = self.ordered[np.minimum(j, n_runs - 1)] - key
                above = self.ordered[np.maximum(j - 1, 0)] - key
                has_below, has_above = (j < n_runs) & (below >= 0) & (below < n_runs), (j > 0) & (above >= 0) & (above < n_runs)
                below, above = np.where(has_below, below, 0), np.where(has_above, above, 0)
                was, most = position[other], have[other]
                x = np.where(has_below, self.extension(was, self.first_at[below], np.where(has_below, most, 0)), -1)
                y = np.where(has_above, self.extension(was, self.last_at[above], np.where(has_above, most, 0)), -1)
                down = x >= y
                run[other] = np.where(down, below, above)
                rows[other] = np.where(down, self.first[below], self.last[above])
                position[other] = np.where(down, self.first_at[below], self.last_at[above])
                have[other] = np.maximum(x, y)  # -1: the index hasn't the symbol, and the match begins anew
            known = have[:n] >= 0
            rows[:n] = np.where(known, self.leads[run] + (rows[:n] - self.first[run]), 0)
            position[:n] = np.where(known, position[:n] - 1, self.start)
            have[:n] = np.minimum(have[:n] + 1, self.length)
            if step >= self.length:
                full = np.flatnonzero(have[:n] == self.length)
                out[at[full] + sizes[full] - step] = self.group_least[self.groups.last(rows[full])]


def _sorted_suffixes(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of t, by doubling where order is open yet, and for each row whether it agrees with the one before in `length` symbols."""
    n = len(t)
    width = 7  # symbols of 9 bits in one integer
    key = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.full(width, 0)])
    for i in range(width):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    del key, padded
    rank = np.empty(n, np.int64)
    depth, kept = width, None
    while True:
        first = np.flatnonzero(new)
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))
        if depth <= length < 2 * depth:
            kept = (rank.copy(), depth)
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_) or depth > n:
            break
        at = order[open_]
        far = at + depth
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        k = rank[at] * (n + 1) + second
        by = np.argsort(k)
        order[open_] = at[by]
        k = k[by]
        new = new.copy()
        new[open_] |= np.append(True, k[1:] != k[:-1])
        depth *= 2
    if kept is None:  # order was settled before: rows agree in as many symbols nowhere
        return order, np.zeros(n, bool)
    rank, depth = kept
    skip = length - depth
    a, b = order[1:], order[:-1]
    near = (rank[a] == rank[b]) & (np.maximum(a, b) + length <= n)
    if skip:
        near &= rank[np.minimum(a + skip, n - 1)] == rank[np.minimum(b + skip, n - 1)]
    return order, np.append(False, near)


def least_documents(texts: list[bytes], docs: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The least document of each window of each text, and where each text's begin. docs: the least document of each text; windows are equal only where keys are.

    Of each key the texts of the least documents are indexed, at first one, and all
    are streamed against them; the windows that the index lacks go on, as smaller texts.
    What is indexed has no greater document than what is streamed, so an answer is final.
    """
    windows = np.array([len(t) for t in texts], np.int64) - length + 1
    place = np.cumsum(windows) - windows
    found = np.repeat(docs, windows)
    _, which, several = np.unique(keys, return_inverse=True, return_counts=True)
    of, most = np.flatnonzero(several[which] > 1), 1
    # long texts in parts of SPAN windows: all step together, so the longest sets the number of steps
    parts = -(-windows[of] // SPAN)
    of = np.repeat(of, parts)
    first = SPAN * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    count = np.minimum(SPAN, windows[of] - first)
    while True:
        _, which, several = np.unique(keys[of], return_inverse=True, return_counts=True)
        mixed = several[which] > 1  # what is alone has its own document
        of, first, count, which = of[mixed], first[mixed], count[mixed], which[mixed]
        if not len(of):
            return found, place
        order = np.lexsort((docs[of], which))
        of, first, count, which = of[order], first[order], count[order], which[order]
        begins = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        rank = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
        parts = [texts[i][a : a + c + length - 1] for i, a, c in zip(of.tolist(), first.tolist(), count.tolist(), strict=True)]
        indexed = rank < most
        index = RunLengthIndex([parts[i] for i in np.flatnonzero(indexed).tolist()], docs[of[indexed]], length)
        least, at = index.stream(parts)
        owner = np.repeat(np.arange(len(of)), count)
        inner = np.arange(len(least)) - at[owner]
        hit = least < _LAST
        where = place[of[owner]] + first[owner] + inner
        found[where[hit]] = least[hit]
        hit |= indexed[owner]
        left = np.flatnonzero(~hit)
        if not len(left):
            return found, place
        new = np.flatnonzero(np.append(True, (left[1:] != left[:-1] + 1) | (owner[left[1:]] != owner[left[:-1]])))
        count = np.diff(np.append(new, len(left)))
        head = left[new]
        of, first = of[owner[head]], first[owner[head]] + inner[head]
        most *= 8


def _match(length: int):
    def match(part: pd.DataFrame) -> pd.DataFrame:
        """For each block of a bucket the least document of each window of its fragments."""
        known: dict[bytes, int] = {}
        number: list[np.ndarray] = []
        for raw, size in zip((_unzip(x) for x in part["data"]), (np.frombuffer(_unzip(x), np.uint32) for x in part["lens"]), strict=True):
            ends = np.cumsum(size, dtype=np.int64)
            number.append(np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.int64))
        flat = np.concatenate(number)
        docs, keys = np.full(len(known), _LAST, np.int64), np.empty(len(known), np.uint32)
        np.minimum.at(docs, flat, np.concatenate([np.frombuffer(_unzip(x), np.int64) for x in part["least"]]))
        keys[flat] = np.concatenate([np.frombuffer(_unzip(x), np.uint32) for x in part["keys"]])
        texts = list(known)
        del known
        found, place = least_documents(texts, docs, keys, length)
        windows = np.array([len(t) for t in texts], np.int64) - length + 1
        answers = []
        for x in number:
            w = windows[x]
            ends = np.cumsum(w)
            answers.append(_zip(found[np.repeat(place[x] - (ends - w), w) + np.arange(int(ends[-1]))]))
        return pd.DataFrame({"block": part["block"], "bucket": part["bucket"], "least": answers})

    return match


def _finish(batches, length, buckets):
    for batch in batches:
        for row in batch.to_pylist():
            ids, lens, raw, b, _, doc, start, count = _candidates(row, length, buckets)
            answers = {a["bucket"]: a["least"] for a in row["answers"] or ()}
            covering = [np.empty(0, np.int64)]
            for bucket, i, j in _bounds(b):
                texts, number = _distinct(raw, start, count, length, i, j)
                least = np.frombuffer(_unzip(answers[bucket]), np.int64)
                size = np.array([len(t) for t in texts], np.int64) - length + 1
                at = np.cumsum(size) - size
                c = count[i:j]
                ends = np.cumsum(c)
                inner = np.arange(int(ends[-1])) - np.repeat(ends - c, c)
                gone = least[np.repeat(at[number], c) + inner] < np.repeat(ids[doc[i:j]], c)
                covering.append((np.repeat(start[i:j], c) + inner)[gone])
            windows = np.concatenate(covering)
            delta = np.bincount(windows, minlength=len(raw) + 1) - np.bincount(windows + length, minlength=len(raw) + 1)
            covered = np.cumsum(delta[:-1]) > 0
            null = np.frombuffer(_unzip(row["null"]), np.uint8)
            data = np.frombuffer(raw, np.uint8)
            cols: list[list] = [[], [], [], [], []]
            end = 0
            for k, (doc_id, n) in enumerate(zip(ids.tolist(), lens.tolist(), strict=True)):
                end += n
                mask = covered[end - n : end]
                removed = int(mask.sum())
                left = data[end - n : end][~mask].tobytes() if removed else raw[end - n : end]
                spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if removed else 0
                for col, v in zip(cols, (None if null[k] else doc_id, n, removed, spans, left), strict=True):
                    col.append(v)
                if k % 2000 == 1999:
                    yield _kept(cols)
                    cols = [[], [], [], [], []]
            yield _kept(cols)


def _kept(cols):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, block: int = 2_500_000, bucket: int = 2_500_000, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs (doc_id, text).

    block, bucket: bytes of text for each block of documents and for each bucket
    of hashes, about; both are as many as the input needs. hot: fragments of a
    hash from which on it is split by the bytes around its k-gram.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    held = blocks(docs, block)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // bucket))
    keys = held.mapInArrow(lambda b: _list_keys(b, length, buckets), "bucket long, block long, keys binary, many binary, unlike binary")
    shared = keys.groupBy("bucket").applyInPandas(_shared_keys(hot), "block long, bucket long, bits binary")
    shared = cut(shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("shared")), "shared")
    full = held.join(shared.hint("shuffle_hash"), "block", "left")
    sent = full.mapInArrow(lambda b: _send_fragments(b, length, buckets), "bucket long, block long, lens binary, data binary, least binary, keys binary")
    answers = sent.groupBy("bucket").applyInPandas(_match(length), "block long, bucket long, least binary")
    answers = cut(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "least")).alias("answers")), "answers")
    both = held.join(shared.join(answers, "block", "full").hint("shuffle_hash"), "block", "left")
    return both.mapInArrow(lambda b: _finish(b, length, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
