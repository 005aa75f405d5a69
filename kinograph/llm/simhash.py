"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r
bits of each. Every distinct fingerprint emits all its variants within r; those
that meet at a variant are linked to the smallest of them after their distance
is verified, and the links' connected components are the groups.

Empty and null texts have the fingerprint zero, like any text without words. Rows of
equal doc_id are each answered; a null doc_id stays null and names no group, so a
group that only such rows are in has a null component_id.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_groups
from .components import components
from .frames import cut
from .kept import nothing

#: Variants that one task emits, about.
VARIANTS = 1_000_000

_hash = partial(xxhash.xxh64_digest, seed=42)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the hashes of its word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    hashes = np.frombuffer(b"".join([_hash(flat[a:b]) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches, shingle):
    nothing()
    for batch, texts in text_groups(batches):
        fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (long, the bits of the unsigned fingerprint) of every row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _fingerprints(b, shingle), "doc_id long, fp long")


def _masks(radius: int) -> list[int]:
    out = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: pairs of the distinct fingerprints in fps (fp) that join all that differ in at most `radius` bits.

    A variant has at most as many sources as there are masks (65 for radius 2),
    whatever the number of documents, so the groups are bounded.
    """
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m) for m in _masks(half)])
    each = cut(fps.select("fp").distinct(), "distinct")
    # as many tasks as some million variants each take, whatever the partitions were merged to
    tasks = max(1, -(-each.count() * len(_masks(half)) // VARIANTS))
    balls = each.repartition(tasks, "fp").select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    met = balls.groupBy("v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_sort("fps").alias("fps"))
    if radius % 2 == 0:  # all at a variant are within the radius of each other: the smallest stands for them
        pairs = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, len(_masks(half)))).alias("b"))
    else:  # bounded by the masks, squared
        pairs = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def groups(fps: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by pairs a, b of fp) of every row of fps (doc_id, fp)."""
    linked = components(pairs)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = cut(
        first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")),
        "roots",
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(named.join(lowest, "root").select("fp", "component_id"), "of")
    return fps.select("doc_id", "fp").join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text)."""
    fps = cut(fingerprints(docs, shingle), "fp")
    return groups(fps, links(fps, radius)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
