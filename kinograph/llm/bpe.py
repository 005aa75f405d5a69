"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, so that equal
passages are cut alike wherever they stand. A chunk that occurs more than once
in the corpus is encoded once, by the document where it comes first, and its
ids are handed to all documents that hold it. Where two chunks meet, a window
over the joint is encoded again and widened until its ends agree with the ids
on both sides; then it replaces them.

Null and empty texts have no ids. Rows of equal or null doc_id are each answered; a
chunk that such rows share is encoded by whoever has it first.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .frames import cut
from .kept import kept

#: str.split() also parts words at these, the tokenizer doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Units whose case and composition are the same by any edition of Unicode.
_MARKS = ".,;:!?#*$%&)"
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u017f]+")
_WINDOW = 32
#: Characters of the texts whose units are looked up together.
_NEAR = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class UnitEncoder:
    """Exact ids of texts as little-endian unsigned 32-bit bytes, with a memory of units.

    Where the tokenizer drops white space and ends words there (an end-of-word
    suffix, and a splitting pattern that never takes white space), the ids of a
    text are those of its units between white space, one after another. Units
    and the pieces that the pattern splits them into are kept with their ids,
    some `limit` of them in all; new pieces are encoded many at once, by the same
    model without the steps that leave them as they are, and their ids are told
    apart by the suffix. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        pair = self._ids("ab cd")
        self.by_unit = pair == self._ids("ab") + self._ids("cd") == self._ids("ab \n\t  cd ") and self._ids(" \n\t ") == b""
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.pattern, self.ends, self.bare = None, None, None
        kept = json.loads(self.tok.to_str())
        self.numerals = [str(i) for i in range(self.tok.get_vocab_size())]
        names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        #: without a decoder, tokens are decoded by a space between them
        self.names = names if kept.get("decoder") is None and None not in names else None
        suffix = kept["model"].get("end_of_word_suffix")
        #: bytes of the normal form that a token stands for
        self.sizes = np.array([len((x or "").removesuffix(suffix) if suffix else x or "") for x in names], np.int64)
        found = [x["pattern"]["Regex"] for x in (kept["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed" and "Regex" in x["pattern"]]
        if self.by_unit and suffix and len(found) == 1:
            vocabulary = self.tok.get_vocab()
            self.pattern, self.ends = regex.compile(found[0]), np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            steps = [x for x in kept["pre_tokenizer"]["pretokenizers"] if x["type"] != "Split"]
            self.bare = Tokenizer.from_str(json.dumps(kept | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "added_tokens": []}))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids]) if self.names else self.tok.decode(ids, skip_special_tokens=False)

    def _ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for i in range(0, len(texts), 5000) for e in self.tok.encode_batch_fast(texts[i : i + 5000], add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """The ids of units: most are a word and marks behind it, the others are split by the pattern, and odd ones are encoded as they are.

        A piece alone is split into itself, so pieces are units too.
        """
        known = self.known
        if not self.pattern:
            known.update(zip(units, self._each(units), strict=True))
            return
        other, words, marked, split = [], [], [], []
        for u in units:
            w = u.rstrip(_MARKS)
            if w.isalpha() and (w.isascii() or _PLAIN.fullmatch(w)):
                if len(w) < len(u):
                    marked.append((u, w.lower(), u[len(w) :]))
                else:
                    words.append(u)
            elif _PLAIN.fullmatch(u) and "<|" not in u:
                split.append((u, self.pattern.findall(u.lower())))
            else:
                other.append(u)
        lower = [w.lower() for w in words]
        fresh = set(lower)
        fresh.update([w for _, w, _ in marked], [m for _, _, m in marked], *[ps for _, ps in split])
        listed = [p for p in fresh if p not in known]
        for i in range(0, len(listed), 2000):
            some = listed[i : i + 2000]
            ids = np.array(self.bare.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):  # not a piece each: one by one
                known.update(zip(some, self._each(some), strict=True))
                continue
            raw, at = ids.tobytes(), 0
            for p, end in zip(some, ends.tolist(), strict=True):
                known[p] = raw[at:end]
                at = end
        known.update([(u, known[w]) for u, w in zip(words, lower, strict=True) if u != w])
        known.update([(u, known[w] + known[m]) for u, w, m in marked])
        known.update([(u, b"".join([known[p] for p in ps])) for u, ps in split])
        known.update(zip(other, self._each(other), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return [array("I", e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        out, at = [], 0
        while at < len(texts):  # a few texts at a time, so that their units are still in the processor's caches when they are joined
            end, size = at, 0
            while end < len(texts) and size < _NEAR:
                size += len(texts[end])
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        units = [None if _ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        known, new, found = self.known, [], []
        for u in units:  # one look-up a unit: the memory is far larger than the processor's caches
            got = list(map(known.get, u)) if u else []
            if None in got:
                new += [x for x, ids in zip(u, got, strict=True) if ids is None]
            found.append(got)
        if new:
            self._learn(list(set(new)))
            found = [[known[x] if ids is None else ids for x, ids in zip(u, got, strict=True)] if None in got else got for u, got in zip(units, found, strict=True)]
        return [self._ids(t) if u is None else b"".join(got) for t, u, got in zip(texts, units, found, strict=True)]


def encoder(path: str, limit: int = 1_200_000) -> UnitEncoder:
    """One for each Python worker; some 200 bytes for each unit or piece that it keeps."""
    return kept(("encoder", path), lambda: UnitEncoder(path, limit))


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with their texts, null ones as empty, in groups of some `most` characters; one group's texts are strings of Python at a time."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_pylist()
        at = 0
        while at < len(sizes):
            end, size = at, 0
            while end < len(sizes) and (end == at or size + sizes[end] <= most):
                size += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [t or "" for t in part.column(place).to_pylist()]
            at = end


#: Characters of a unit that a window over a joint takes in, before it is doubled.
REACH = 64

_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each `window` bytes of data (uint8), by the place where they start."""
    n = len(data)
    if n < window:
        return np.empty(0, np.uint64)
    up, down = power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[window:] - sums[:-window]) * down[: n - window + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def chunks(text: str, bits: int = 10, least: int = 256, reach: int = 200) -> list[str]:
    """Content-defined pieces that make up the text.

    A cut stands after white space that follows a place where the rolling hash
    has `bits` zero bits, or `reach` bytes after that place if no white space
    comes so soon; cuts closer than `least` bytes to the last are passed over.
    """
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    hits = np.flatnonzero((rolling(data, _WINDOW) & np.uint64((1 << bits) - 1)) == 0)
    out, last = [], 0
    for at in (hits + _WINDOW).tolist():
        if at - last < least:
            continue
        near = raw[at : at + reach]
        m = re.search(rb"\s", near)
        to = at + (m.end() if m else len(near))
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to += 1
        if to >= len(raw):
            break
        out.append(raw[last:to].decode("utf-8", "surrogatepass"))
        last = to
    out.append(raw[last:].decode("utf-8", "surrogatepass"))
    return out


def _edge(text: str, units: int, tail: bool) -> str:
    """The last or first so many units of a text, from white space on, or REACH characters for each where they are longer; the whole text if it has no more."""
    most = REACH * units
    near = text[-most:] if tail else text[:most]
    found = [m.span() for m in re.finditer(r"\S+", near)]
    if len(found) <= units:
        return near
    if tail:
        return near[max(0, found[-units][0] - 1) :]  # with the white space before
    return near[: found[units - 1][1]]


def _tokens(ids: bytes, sizes: np.ndarray, start: int) -> tuple[list[tuple[int, int]], int]:
    """(start, id) of each token, in bytes of the normal form, and where they end."""
    of = np.frombuffer(ids, "<u4")
    ends = start + np.cumsum(sizes[of])
    return list(zip([start, *ends[:-1].tolist()], of.tolist())), int(ends[-1]) if len(of) else start


def _spliced(left_ids: bytes, right_ids: bytes, t: bytes, h: bytes, joint: bytes, sizes: np.ndarray, first: bool, last: bool) -> tuple[bytes, bytes] | None:
    """The ids left of the window that stay, and those from there on: both sides go over into the joint's where two tokens that follow each other are the same there.

    Places count from the joint. A sequence of BPE tokens is right if all its neighbours are, and all neighbours here are so in one of
    three encodings. first, last: the window begins with the left text or ends with the right one, so that side has nothing to go over from.
    """
    whole = _tokens(t, sizes, 0)[1]
    mid, end = _tokens(joint, sizes, -whole)
    if end != _tokens(h, sizes, 0)[1]:
        return None  # the joint changes the normal form
    i = j = 0
    if not first:
        near = left_ids[-(len(t) + 256) :]
        own, at = _tokens(near, sizes, 0)
        own = {(s - at, x): k for k, (s, x) in enumerate(own)}
        j = next((n for n in range(2, len(mid)) if mid[n][0] <= 0 and mid[n - 1] in own and own.get(mid[n - 2], -9) == own[mid[n - 1]] - 1), 0)
        if not j:
            return None
        i = len(left_ids) // 4 - len(near) // 4 + own[mid[j - 1]] + 1
    k, m = len(mid), len(right_ids) // 4
    if not last:
        own = {x: n for n, x in enumerate(_tokens(right_ids[: len(h) + 256], sizes, 0)[0])}
        k = next((n for n in range(len(mid) - 2, j - 1, -1) if mid[n][0] >= 0 and mid[n] in own and own.get(mid[n + 1], -9) == own[mid[n]] + 1), -1)
        if k < 0:
            return None
        m = own[mid[k]]
    return left_ids[: 4 * i], joint[4 * j : 4 * k] + right_ids[4 * m :]


def mend(left: str, left_ids: bytes, right: str, right_ids: bytes, encode, sizes: np.ndarray, more: bool = False) -> tuple[int, bytes, bytes] | None:
    """Of the ids of left + right those that the joint leaves alone, and the others; before these, how many characters of left the window has.

    A window over the joint is encoded. Where it ends at white space, the
    stretches before and behind the units that touch the joint are encoded too:
    the window's ids must begin and end with theirs, and the chunks must have
    them there. Where it was cut inside a unit it must go over into the chunks'
    ids by tokens that both have. Otherwise the window is doubled, up to both
    whole texts. more: there is text before left; None, if that is needed.
    """
    units = 2
    while True:
        tail, head = _edge(left, units, True), _edge(right, units, False)
        first, last = len(tail) == len(left), len(head) == len(right)
        if first and more:
            return None
        if first and last:
            return len(left), b"", encode([left + right])[0]
        t, h, joint = encode([tail, head, tail + head])
        if (first or tail[:1].isspace()) and (last or right[len(head) : len(head) + 1].isspace()):
            if left_ids.endswith(t) and right_ids.startswith(h):
                kept, rest = left_ids[: len(left_ids) - len(t)], right_ids[len(h) :]
                if joint == t + h:
                    return len(tail), kept, joint + rest
                before, after = tail[: len(tail) - len(_edge(tail, 1, True))], head[len(_edge(head, 1, False)) :]
                b, a = encode([before, after])
                if joint.startswith(b) and joint.endswith(a):
                    return len(tail), kept, joint + rest
        elif (found := _spliced(left_ids, right_ids, t, h, joint, sizes, first, last)) is not None:
            return len(tail), *found
        units *= 2


def joined(pieces: list[str], ids: list[bytes], encode, sizes: np.ndarray) -> bytes:
    """The ids of the text that the pieces make up, every joint mended.

    What lies before the last window is put aside, and taken up again only if a
    joint needs it.
    """
    if not pieces:
        return b""
    aside: list[tuple[str, bytes]] = []
    text, now = pieces[0], ids[0]
    for right, right_ids in zip(pieces[1:], ids[1:], strict=True):
        clean = text[-1:].isspace() and not right[:1].isspace()
        while (found := mend(text, now, right, right_ids, encode, sizes, bool(aside))) is None:
            before, had = aside.pop()
            text, now = before + text, had + now
        size, kept, rest = found
        if clean and kept + rest == now + right_ids:
            aside.append((text, now))  # they agree as they are: the next joint needs the last piece alone
            text, now = right, right_ids
        else:
            aside.append((text[: len(text) - size], kept))
            text, now = text[len(text) - size :] + right, rest
    return b"".join([had for _, had in aside]) + now


def _digest(piece: str) -> tuple[int, int]:
    d = hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _list_chunks(batches, bits):
    for batch, texts in text_groups(batches):
        rows: list[list] = [[], [], [], [], []]
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            for k, p in enumerate(chunks(text, bits) if text else ()):
                for col, v in zip(rows, (doc_id, key, k, *_digest(p)), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())[i]) for i, c in enumerate(rows)], ["doc_id", "row_key", "seq", "h1", "h2"])


def _encode_owned(batches, path, bits):
    enc = encoder(path)
    for batch, texts in text_groups(batches):
        pieces: list[str] = []
        for text, own in zip(texts, batch.column(batch.schema.get_field_index("owned")).to_pylist(), strict=True):
            parts = chunks(text, bits)
            pieces += [parts[k] for k in own]
        marks = [_digest(p) for p in pieces]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(enc.encode(pieces), pa.binary())], ["h1", "h2", "ids"]
        )


def _squeeze(batches):
    """Texts compressed, for the way through the shuffle."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "row_key", "packed"])


def _unsqueezed(batches, rows: int = 1000):
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, [z.decompress(x).decode("utf-8", "surrogatepass") for x in part.column(part.schema.get_field_index("packed")).to_pylist()]


def _assemble(batches, path, bits, digest):
    enc = encoder(path)
    for batch, texts in _unsqueezed(batches):
        cutup, ready, want = [], [], []
        for text, got in zip(texts, batch.column(batch.schema.get_field_index("given")).to_pylist(), strict=True):
            parts = chunks(text, bits) if text else []
            have = {g["seq"]: g["ids"] for g in got or ()}
            cutup.append(parts)
            ready.append(have)
            want += [p for k, p in enumerate(parts) if k not in have]
        made = iter(enc.encode(want))
        ids = [joined(parts, [have[k] if k in have else next(made) for k in range(len(parts))], enc.encode, enc.sizes) for parts, have in zip(cutup, ready, strict=True)]
        if digest:
            yield _digests(batch.column(0), ids, enc)
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, bits: int = 10, small: int = 200_000, digest: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row of docs (doc_id, text).

    digest: instead of ids the columns of digests(), in the same pass.
    bits: chunks have about 2**bits bytes. Only digests of chunks are grouped
    over the corpus; texts are dealt out by row once, and ids of shared chunks
    go to the rows that hold them. small: rows of (ids of rows, chunk numbers)
    that may be broadcast, after a count; beyond it they are joined by shuffle.
    """
    # Rows are told apart by doc_id and text, so that repeated ids do no harm.
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("row_key"), "text")
    listed = cut(rows.mapInArrow(lambda b: _list_chunks(b, bits), "doc_id long, row_key binary, seq int, h1 long, h2 long"), "chunks").distinct()
    shared = listed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "seq")).alias("first")).where("n > 1")
    owned = cut(shared.groupBy("first.doc_id", "first.row_key").agg(F.collect_list("first.seq").alias("owned")), "owned")
    by = F.broadcast(owned) if owned.count() <= small else owned.hint("shuffle_hash")
    once = cut(rows.join(by, ["doc_id", "row_key"]).select("doc_id", "text", "owned").mapInArrow(lambda b: _encode_owned(b, path, bits), "h1 long, h2 long, ids binary"), "encoded")
    once = once.dropDuplicates(["h1", "h2"])
    given = listed.join(once, ["h1", "h2"]).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("seq", "ids")).alias("given"))
    squeezed = rows.mapInArrow(_squeeze, "doc_id long, row_key binary, packed binary")
    full = squeezed.join(given.hint("shuffle_hash"), ["doc_id", "row_key"], "left").select("doc_id", "packed", "given")
    return full.mapInArrow(lambda b: _assemble(b, path, bits, digest), _DIGESTS if digest else "doc_id long, ids binary")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(doc_ids: pa.Array, encoded: list[bytes], enc: UnitEncoder) -> pa.RecordBatch:
    n, ids_hex, text_hex = [], [], []
    for ids in encoded:
        listed = np.frombuffer(ids, "<u4").tolist()
        n.append(len(listed))
        ids_hex.append(hashlib.sha256(" ".join([enc.numerals[i] for i in listed]).encode()).hexdigest())
        text_hex.append(hashlib.sha256(enc.decode(listed).encode("utf-8", "surrogatepass")).hexdigest())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _read_ids(batches, path):
    for batch in batches:
        yield _digests(batch.column(0), batch.column(1).to_pylist(), encoder(path))


def _decode(batches, path):
    enc = encoder(path)
    for batch in batches:
        texts = [enc.decode(np.frombuffer(i, "<u4").tolist()) for i in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of encoded (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, path), "doc_id long, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and hex SHA-256 of the listed ids and of the decoded text."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _read_ids(b, path), _DIGESTS)
