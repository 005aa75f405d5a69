"""Exact order statistics of groups of any size.

Equal values are counted first, the counts are dealt by ranges of (group, value), and
running counts of the ranges tell which one holds a rank; only inside that range are
rows numbered. So a group of any size is spread over tasks, and nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: The percentiles of a summary.
SUMMARY = {"p50": 0.50, "p90": 0.90, "p95": 0.95}


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """keys, n (non-null values of the group), rank and value at each rank (from 0) that ranks(n) names, an array of longs; ranks outside are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = cut(counted.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()), "ranks")
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "n": F.sum("_sum").over(group)})
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_sum"))
    parts = parts.withColumn("_ranks", F.filter(ranks(F.col("n")), inside)).where(F.size("_ranks") > 0)
    named = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_at"), "_before", "_ranks", "n")
    on = dealt["_part"] == named["_at"]
    for i, k in enumerate(keys):
        on &= dealt[k].eqNullSafe(named[f"_k{i}"])
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("value"))
    rows = dealt.join(named, on).withColumn("_end", end)
    return rows.select(*keys, "n", F.explode(F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n")))).alias("rank"), "value")


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Of each group count, min, p50, p90, p95 and max of its finite values: the value at rank (n - 1) * q, rounded half to even; count 0 and nulls where there is none."""
    finite = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(finite) & (F.abs(finite) != float("inf")), finite).alias("value"))
    place = {name: lambda n, q=q: F.bround((n - 1) * F.lit(q), 0).cast("long") for name, q in SUMMARY.items()}
    at = at_ranks(rows, keys, "value", lambda n: F.array_distinct(F.array(*(f(n) for f in place.values()))))
    picked = at.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(*(F.max(F.when(F.col("rank") == f(F.col("n")), F.col("value"))).alias(name) for name, f in place.items()))
    base = rows.groupBy(*keys).agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return base.join(picked, on, "left").select(*keys, "count", "min", *SUMMARY, "max")
