"""Reading tables; cutting lineage is the library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import cut, drop, release, scratch, shared_dir, written

__all__ = ["cut", "drop", "load", "release", "scratch", "shared_dir", "written"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
