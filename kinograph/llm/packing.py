"""Best-fit packing, certified by lower bounds and repaired by exchange.

Every partition packs its pieces by best-fit decreasing and computes a lower
bound on its number of sequences from dual-feasible functions. Where the two
differ, the pieces of sequences that aren't full go into a pool, are dealt out
anew and packed again, until no partition has a gap or the rounds are over. A
round that doesn't lower the number of sequences is not taken.

Null and empty texts have the end id alone. Rows of equal or null doc_id are documents
each, and their pieces are placed each for itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, text_groups
from .frames import cut
from .kept import nothing

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each size its bin and its place in the bin, and the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # rooms: bit r is set if a bin has r free
    for i in order.tolist():
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - room
        if room > s:
            by_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return bins, offsets, count


def lower_bound(sizes: np.ndarray, capacity: int, most: int = 32) -> int:
    """Bins that any packing needs: the largest bound of two families of dual-feasible functions.

    One rounds sizes to multiples of capacity/k where (k+1)x/capacity is not
    whole; the other counts sizes over capacity - t whole and drops those under t.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, most + 1):
        w = np.where((k + 1) * x % capacity == 0, k * x, capacity * ((k + 1) * x // capacity))
        best = max(best, -(-int((count * w).sum()) // (k * capacity)))
    total, number = np.cumsum(count * x), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = total[capacity - t] - total[t - 1]
    return max(best, int((large + -(-middle // capacity)).max()))


def _pieces(batches, path, capacity, end_id, limit):
    enc, end = encoder(path, limit), np.array([end_id], "<u4").tobytes()
    for batch, texts in text_groups(batches):
        cols: list[list] = [[], [], [], [], []]
        for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for col, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, limit: int = 1_200_000) -> DataFrame:
    """The pieces of at most `capacity` tokens of every row of docs (doc_id, text), end_id after each text (null: empty). limit: units and pieces that an encoder keeps."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(b, path, capacity, end_id, limit), _PIECES)


def _packed(capacity: int, round_: int):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        nothing()  # texts have been encoded
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = part["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(bins, weights=sizes, minlength=n)
        gap = n - lower_bound(sizes, capacity)
        group = int(part["grp"].iloc[0])
        return part.assign(
            bin=((round_ << 56) | (group << 30)) + bins, offset=offsets, loose=(gap > 0) & (filled[bins] < capacity), bin_gap=np.int64(gap)
        ).drop(columns="grp")

    return pack


def pack(parts: DataFrame, capacity: int = 2048, group: int = 32_768, rounds: int = 3) -> DataFrame:
    """parts (see pieces()) with sequence_id and offset.

    group: pieces that one task packs, about; tasks grow in number with the
    input, never in size. Pieces of full length are sequences as they are.
    """
    schema = _PIECES + ", bin long, offset long, loose boolean, bin_gap long"
    parts = cut(parts, "pieces")
    whole = parts.where(F.col("length") >= capacity)
    open_ = parts.where(F.col("length") < capacity)

    def packed(rows: DataFrame, round_: int) -> DataFrame:
        groups = max(1, -(-rows.count() // group))
        # rows are dealt out by their file's and row's place as well, so that equal rows don't fill one group
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_), F.monotonically_increasing_id()), F.lit(groups)).cast("long")
        return cut(rows.withColumn("grp", key).groupBy("grp").applyInPandas(_packed(capacity, round_), schema), f"packed{round_}")

    done, now = [], packed(open_, 0)
    for round_ in range(1, rounds + 1):
        loose = now.where("loose")
        before = loose.agg(F.count_distinct("bin")).first()[0]
        if before < 2:
            break
        again = packed(loose.select(*parts.columns), round_)
        if again.agg(F.count_distinct("bin")).first()[0] >= before:
            break
        done.append(now.where("not loose"))
        now = again
    out = now
    for x in done:
        out = out.unionByName(x)
    cols = [F.col(c) for c in parts.columns]
    return out.select(*cols, (F.col("bin") * 2 + 1).alias("sequence_id"), "offset").unionByName(
        whole.select(*cols, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
