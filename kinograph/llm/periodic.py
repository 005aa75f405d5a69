"""Periodic runs of words: stretches that repeat one period at least three times.

Words are numbered by their first place in a text. For each power of two the text
is cut into aligned blocks; those that may repeat are the keys (sequences of
integers) of an Aho-Corasick automaton, and the text is searched for them. A block
of B words that occurs again B to 2B - 1 words later (1 to 15 for the least blocks,
of 8 words) is a seed, which is extended word by word in both directions as far as
the words that far apart are identical. A run of period q and at least
max(24, 3q) words holds an aligned block of the scale of q whose copy q words later
is in the run too, so none is missed; of the periods found for one stretch the least counts.

Blocks that can't repeat (a word of theirs doesn't come again within 2B) are no
keys. Blocks inside a known run whose period is at most a quarter of their length
would match at every period of it, and keys that begin with a long run make the
automaton slow: for those the ends of known runs of that period, as far apart as
the scale says, are the seeds. So a scale costs time about in proportion to the text.

Null and empty texts have no runs and an empty collapsed text. Rows of equal or null
doc_id are each answered; other columns are left out, whatever their names. One
text is one row of one task: some 25 bytes a word stay beside it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import nothing

#: A run has as many words at least, and as many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the least blocks; words of the keys of one automaton, unless one block is longer.
LEAST_BLOCK, AUTOMATON = 8, 65_536

_SPACE = re.compile(rb"[ \t-\r]")
_CHUNK = 1 << 20


def numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Every word of a text as a number, and the words by number; words are split by the ASCII white space."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    parts, at = [], 0
    while at < len(data):
        gap = _SPACE.search(data, at + _CHUNK) if at + _CHUNK < len(data) else None
        end = gap.end() if gap else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), list(ids)


def _again(seq: np.ndarray) -> np.ndarray:
    """For each word the distance to its next occurrence; the number of words where there is none."""
    n = len(seq)
    order = np.argsort(seq.astype(np.uint16) if n < 65_536 else seq, kind="stable").astype(np.int32)
    out = np.full(n, n, np.int32)
    same = seq[order[1:]] == seq[order[:-1]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def _stretch(seq: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch [start, end) around `at` whose words are identical to those d later; (at, at) if that word isn't."""
    end, step = at, 64
    while end < len(seq) - d:
        size = min(step, len(seq) - d - end)
        unlike = seq[end : end + size] != seq[end + d : end + d + size]
        if unlike.any():
            end += int(unlike.argmax())
            break
        end, step = end + size, 2 * step
    if end == at:
        return at, at
    start, step = at, 64
    while start > 0:
        size = min(step, start)
        unlike = (seq[start - size : start] != seq[start - size + d : start + d])[::-1]
        if unlike.any():
            start -= int(unlike.argmax())
            break
        start, step = start - size, 2 * step
    return start, end


def _matches(seq: np.ndarray, blocks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of the aligned blocks of these numbers and their occurrences at distances of the scale, by ascending place of the occurrence in each group of blocks."""
    low, high = (1, 2 * size - 1) if size == LEAST_BLOCK else (size, 2 * size - 1)
    each = max(1, AUTOMATON // size)
    for group in (blocks[i : i + each] for i in range(0, len(blocks), each)):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        key: dict[int, int] = {}  # of each block the first one of equal words
        for b in group.tolist():
            words = tuple(seq[b * size : (b + 1) * size].tolist())
            first = automaton.get(words, None)
            if first is None:
                automaton.add_word(words, first := b)
            key[b] = first
        automaton.make_automaton()
        cuts = np.flatnonzero(np.diff(group) > high // size + 1) + 1
        for near in np.split(group, cuts):
            a, z = int(near[0]) * size, min(len(seq), int(near[-1]) * size + size + high)
            for last, first in automaton.iter(tuple(seq[a:z].tolist())):
                place = a + last - size + 1
                for b in range(max(0, -(-(place - high) // size)), (place - low) // size + 1):
                    if key.get(b) == first:
                        yield b * size, place - b * size


def _short(known: dict[tuple[int, int], int], size: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, period, part) of the known runs that stand in for keys: a block that has `part` words of one is no key."""
    part = max(256, size // 64)
    for (s, e), q in known.items():
        if size >= 512 and 4 * q <= part <= e - s:
            yield s, e, q, part
        elif size >= 32 and 4 * q <= size <= e - s:
            yield s, e, q, size


def _ends(short: list[tuple[int, int, int, int]], seq: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(place, distance) at the ends of known runs of one short period that are as far apart as the scale says; the words beyond the ends are identical too."""
    by_period = defaultdict(list)
    for s, e, q, _ in short:
        by_period[q].append((s, e))
    for runs in by_period.values():
        runs.sort()
        for i, (s, e) in enumerate(runs):
            for s2, e2 in runs[i + 1 :]:
                if s2 >= e + 2 * size:
                    break
                if size <= s2 - s < 2 * size and s > 0 and seq[s - 1] == seq[s2 - 1]:
                    yield s, s2 - s
                if size <= e2 - e < 2 * size and e2 < len(seq) and seq[e] == seq[e2]:
                    yield e - 1, e2 - e


def find(seq: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(seq)
    if n < LEAST_WORDS:
        return []
    known: dict[tuple[int, int], int] = {}
    size, most = LEAST_BLOCK, _again(seq)[: n // LEAST_BLOCK * LEAST_BLOCK].reshape(-1, LEAST_BLOCK).max(axis=1)
    while size == LEAST_BLOCK or LEAST_PERIODS * size <= n:
        may = most < 2 * size
        short = list(_short(known, size))
        for s, e, _, part in short:
            may[max(0, -((size - part - s) // size)) : (e - part) // size + 1] = False
        seeds = list(_ends(short, seq, size))
        until: dict[int, int] = {}
        for sure, pairs in ((False, seeds), (True, _matches(seq, np.flatnonzero(may), size))):
            for place, d in pairs:
                if sure and place < until.get(d, 0):
                    continue  # inside the stretch that was found last for this distance
                start, end = _stretch(seq, place, d)
                if sure:
                    until[d] = end
                if end - start + d >= max(LEAST_WORDS, LEAST_PERIODS * d):
                    span = (start, end + d)
                    known[span] = min(d, known.get(span, d))
        pairs = len(most) // 2
        most, size = most[: 2 * pairs].reshape(-1, 2).max(axis=1), 2 * size
    return sorted(((s, e - s, q) for (s, e), q in known.items()), key=lambda r: (r[0], r[2]))


def collapse(seq: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]], text: bytes) -> bytes:
    """The words joined by one space, without those that a run has after its first period."""
    if not runs:
        return b" ".join(text.split())
    change = np.zeros(len(seq) + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(map(words.__getitem__, seq[np.cumsum(change[:-1]) == 0].tolist()))


def _detected(batches):
    nothing()
    for batch in batches:
        at, size = 0, 0
        ids, texts = batch.column(0), batch.column(1)
        rows: list = []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            seq, words = numbered(text)
            runs = find(seq)
            rows.append((len(seq), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapse(seq, words, runs, text)))
            size += len(text)
            if size > 4_000_000 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], _NAMES)
                at, size, rows = i + 1, 0, []


_NAMES = ["doc_id", "n_words", "runs", "collapsed"]
_TYPES = [pa.int64(), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.binary()]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start, then period) and collapsed (the text without repeats) of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    out = rows.mapInArrow(_detected, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs) -> F.Column:
    """Of an array of runs (a column) the one with the greatest length / period, compared exactly; ties to the least start, then period. Null if there is none."""

    def better(a, b):
        left, right = b["length"] * a["period"], a["length"] * b["period"]
        sooner = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return F.when(a.isNull() | (left > right) | ((left == right) & sooner), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
