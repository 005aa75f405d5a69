"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import defaultdict
from threading import get_ident
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: By thread of the driver, so that plans built side by side keep their tables apart.
_written: defaultdict[int, list[tuple[SparkSession, str]]] = defaultdict(list)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs inside this one process (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinograph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/kinograph-{name}-{uuid.uuid4().hex}"
    _written[get_ident()].append((spark, path))
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The table outlives lost executors and is read instead of being computed
    again. It is removed when the driver ends, or by release().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(path: str):
    """A file, open for reading from its start: of this machine's folders or of any store that pyarrow knows, by its path as Spark's listings give it."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file" or not colon:
        return pa.fs.LocalFileSystem().open_input_stream("/" + (rest or path).lstrip("/"), compression=None)
    files, name = pa.fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return files.open_input_stream(name, compression=None)


def written() -> int:
    """How many tables this thread has written; for drop()."""
    return len(_written[get_ident()])


def drop(since: int, but_last: int = 0) -> None:
    """Remove the tables that this thread wrote since then, except the last few, where nothing reads them any more."""
    mine = _written[get_ident()]
    end = len(mine) - but_last
    gone = mine[since:end]
    del mine[since:end]
    for spark, path in gone:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Remove the tables that cut() wrote; frames that read them are void afterwards."""
    for mine in list(_written.values()):
        while mine:
            spark, path = mine.pop()
            try:
                _remove(spark, path)
            except Exception:  # noqa: BLE001  the session may be gone
                return


atexit.register(release)
