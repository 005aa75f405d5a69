"""Which rows of the canonical tables count: versions that are published at once.

Every build writes its rows to folders of its own, <root>/<table>/build=<id>/match_id=…;
nothing is overwritten. A manifest says for each table and match which build holds
its rows, and a version, one small file, names a manifest. Readers take the last
version; a build that dies leaves files that no version names.

A version's file appears whole or not at all, and only if its number is free: by a
hard link on a local disk, else by a rename that fails where the target exists (HDFS;
on object stores it must be made so by their committer). A writer that comes second
takes the version of the first as its base and tries the next number, so writers of
unlike matches both count, and of the same match the later one.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a manifest that may be broadcast, after a count.
SMALL = 500_000
_MANIFEST = "table string, match_id string, build string"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _hadoop(spark, f"{root}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _name(root: str, number: int) -> str:
    return f"{root}/_versions/{number:010d}.json"


def version(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """The last version, or that of a number: its number and the paths of its manifest and lock; none if nothing was published."""
    number = max(_numbers(spark, root), default=None) if number is None else number
    if number is None:
        return None
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(_name(root, number)).collect())
    return {"number": number, **json.loads(text)}


def _create(spark: SparkSession, target: str, text: str) -> bool:
    """Write a file that appears whole, unless there is one already; whether it was written."""
    fs, path = _hadoop(spark, target)
    fs.mkdirs(path.getParent())
    local = urlparse(fs.makeQualified(path).toString())
    if local.scheme == "file":
        name = unquote(local.path)
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(name), prefix=".new-") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
            try:
                os.link(f.name, name)
            except FileExistsError:
                return False
        return True
    draft = _hadoop(spark, f"{target}.{uuid.uuid4().hex}")[1]
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(path) and fs.rename(draft, path):
        return True
    fs.delete(draft, False)
    return False


def manifest(spark: SparkSession, found: dict | None) -> DataFrame:
    """table, match_id and build of a version."""
    return spark.read.schema(_MANIFEST).parquet(found["manifest"]) if found else spark.createDataFrame([], _MANIFEST)


def new_build() -> str:
    return f"b{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex}"


def store(df: DataFrame, root: str, table: str, build: str, parts: tuple[str, ...]) -> DataFrame:
    """Write rows under a build, in files of their own for each match (and period), and say which matches it holds: rows for a manifest."""
    path = f"{root}/{table}/build={build}"
    out = df.repartition(*parts).sortWithinPartitions(*[c for c in ("frame_id", "row_index") if c in df.columns] or parts)
    out.write.mode("overwrite").option("compression", "zstd").partitionBy(*parts).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).select("match_id").distinct()
    return found.select(F.lit(table).alias("table"), "match_id", F.lit(build).alias("build"))


def publish(spark: SparkSession, root: str, put: DataFrame, gone: DataFrame, lock: str | None = None) -> int:
    """A new version: the last one without the (table, match_id) rows of gone and put, and with those of put; its number.

    lock: path of a source lock that goes with it; else the last one's.
    """
    while True:
        last = version(spark, root)
        replaced = gone.select("table", "match_id").unionByName(put.select("table", "match_id")).distinct()
        rows = manifest(spark, last).join(replaced, ["table", "match_id"], "left_anti").unionByName(put)
        path = f"{root}/_manifests/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(path)
        number = (last["number"] if last else 0) + 1
        text = json.dumps({"manifest": path, "lock": lock or (last or {}).get("lock"), "parent": last and last["number"]})
        if _create(spark, _name(root, number), text):
            return number


def table(spark: SparkSession, root: str, name: str, ddl: str, found: dict) -> DataFrame:
    """The rows of a table that a version names. Match and build are folders, so others are not read."""
    wanted = manifest(spark, found).where(F.col("table") == name).select("match_id", "build")
    fs, folder = _hadoop(spark, f"{root}/{name}")
    if not fs.exists(folder):
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(f"{ddl}, build STRING").parquet(f"{root}/{name}")
    by = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    return rows.join(by, ["match_id", "build"], "left_semi").drop("build")


def vacuum(spark: SparkSession, root: str, tables: list[str], hours: float = 24.0, keep: int = 1) -> list[str]:
    """Remove builds that none of the last `keep` versions names and whose folder is older than `hours` (younger ones may be under way); their paths."""
    kept = {r.build for n in _numbers(spark, root)[-keep:] for r in manifest(spark, version(spark, root, n)).select("build").distinct().collect()}
    gone = []
    for name in tables:
        fs, folder = _hadoop(spark, f"{root}/{name}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            build = s.getPath().getName().removeprefix("build=")
            if build not in kept and s.getModificationTime() <= (time.time() - hours * 3600) * 1000:
                fs.delete(s.getPath(), True)
                gone.append(s.getPath().toString())
    return gone
