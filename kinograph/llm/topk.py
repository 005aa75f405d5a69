"""Exact top-k search by MaxScore over quantised vectors.

Components are terms; the postings of a term hold the component of every row
of a shard. A term's share of a score lies between bounds from the least and
greatest component in the shard. A query's terms are taken by the width of
these bounds: essential terms are traversed for all rows of a block, until the
widths of the rest can't carry a row past the k-th best score met so far except
for a few; only rows that stay competitive are probed in the non-essential
terms. Shards keep their k best and are merged.

Vectors that are null, or have null, NaN or infinite components, take no part.
Vectors meet those of their own length only; scores and components beyond 64 bits are
an error. Scores tie to the smaller id. Rows with equal ids are each a candidate, but not
for a query of that id; equal queries are asked once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

_OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v (array of long: floor(scale * x), x as double) of the rows that take part."""
    e = F.col("embedding")
    ok = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    wide = F.raise_error(F.lit("a component is too large for a 64-bit integer")).cast("long")
    whole = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    v = F.transform(e, lambda x: F.when(F.abs(F.lit(scale) * x.cast("double")) < float(1 << 62), whole(x).cast("long")).otherwise(wide))
    return vectors.where(ok & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))


def max_score(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of x for the query q, without rows of id `own`; x is column-major."""
    n, dims = x.shape
    if dims and float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dims >= float(1 << 60):
        return _large(x, ids, q, own, k)
    live = ids != own
    lo, hi = x.min(axis=0), x.max(axis=0)
    width = np.abs(q) * (hi - lo)
    floor_ = np.minimum(q * lo, q * hi)  # the least share of each term
    order = np.argsort(-width, kind="stable")
    rest = np.concatenate([np.cumsum(width[order][::-1])[::-1], [0]])  # the most that terms from there on add to their floors
    base = int(floor_.sum())

    # The score of a few rows, taken by the widest terms, is the bar to begin with.
    rows = np.flatnonzero(live)
    if len(rows) <= k:
        s = x[rows] @ q
        by = np.lexsort((ids[rows], -s))
        return ids[rows][by], s[by]
    step = max(8, dims // 8)
    part = np.full(len(rows), base, np.int64)
    bar, at = None, 0
    while at < dims:
        terms = order[at : at + step]
        part += x[np.ix_(rows, terms)] @ q[terms] - int(floor_[terms].sum())
        at += step
        if at >= dims:
            break
        guess = rows[np.argpartition(-part, min(4 * k, len(part) - 1))[: 4 * k]]
        best = np.sort(x[guess] @ q)[::-1]
        if len(best) >= k and (bar is None or best[k - 1] > bar):
            bar = best[k - 1]
        keep = part + int(rest[min(at, dims)]) >= bar
        rows, part = rows[keep], part[keep]
        if len(rows) <= 16 * k:  # the remaining terms are non-essential: probe the few that compete
            part = x[rows] @ q
            break
    by = np.lexsort((ids[rows], -part))[:k]
    return ids[rows][by], part[by]


def _large(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for components whose products may pass 64 bits: in integers of any size; a score that does is an error."""
    rows = np.flatnonzero(ids != own)
    scores = x[rows].astype(object) @ q.astype(object)
    by = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    best = [scores[i] for i in by]
    if any(not -(1 << 63) <= s < 1 << 63 for s in best):
        raise OverflowError("a score is too large for a 64-bit integer")
    return ids[rows[by]], np.array(best, np.int64)


def _search(k: int):
    def search(part: pd.DataFrame) -> pd.DataFrame:
        rows, asks = part[part["is_query"] == 0], part[part["is_query"] == 1]
        out: list[list] = [[], [], []]
        for width, some in asks.groupby(asks["v"].map(len)):
            same = rows[rows["v"].map(len) == width]
            if not len(same):
                continue
            x, ids = np.asfortranarray(np.stack(same["v"].to_list()).astype(np.int64)), same["vec_id"].to_numpy()
            for q_id, q in zip(some["vec_id"].to_list(), some["v"].to_list(), strict=True):
                got, scores = max_score(x, ids, np.asarray(q, np.int64), q_id, k)
                out[0] += [q_id] * len(got)
                out[1] += got.tolist()
                out[2] += scores.tolist()
        return pd.DataFrame({"query_id": pd.Series(out[0], dtype="int64"), "vec_id": pd.Series(out[1], dtype="int64"), "score": pd.Series(out[2], dtype="int64")})

    return search


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, shard: int = 4096, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query (rows whose vec_id is divisible by `every`).

    shard: rows of one shard, about; block: queries of one block, about. Each
    pair of a block and a shard is one task, in bounded memory.
    """
    rows = cut(quantised(vectors).withColumn("is_query", F.when(F.col("vec_id") % every == 0, 1).otherwise(0)), "vectors")
    found = rows.agg(F.count("*").alias("n"), F.sum("is_query").alias("q")).first()
    shards, blocks = max(1, -(-found["n"] // shard)), max(1, -(-(found["q"] or 0) // block))
    salt = F.xxhash64("vec_id", F.hash("v"), F.monotonically_increasing_id())
    held = rows.select(F.pmod(salt, F.lit(shards)).cast("int").alias("shard"), "vec_id", "v").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "vec_id", "v", F.lit(0).alias("is_query")
    )
    asks = rows.where("is_query = 1").select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v").distinct()
    asks = asks.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v", F.lit(1).alias("is_query"))
    near = held.unionByName(asks).groupBy("block", "shard").applyInPandas(_search(k), _OUT)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


