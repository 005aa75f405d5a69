"""Delta-maintained token counts.

A batch of changes holds signed rows: +1 for an inserted document, -1 for a
deleted one, and a pair of both for a revised count. Totals by source, language
and tokenizer version are additive, so a batch is folded in by adding its own
totals. Deletions and revisions take the counts that were added, from a table of
counts, and encode nothing again.

A batch is committed once, under its number, in any order. Every writer writes to
a folder of its own that counts from the moment its mark is there; of several
folders of one batch the one marked first counts, so that retries and writers at
the same time add a batch once. compact() folds the batches into a base that lists
their numbers; a batch that comes late is taken, one that is listed is not.

Null source or language is a group of its own; null and empty texts have no
tokens. Rows of equal doc_id are documents each; doc_id takes no part in totals.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, text_groups

KEYS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, docs long, tokens long, chars long"
_COUNTED = "doc_id long, source string, lang string, version string, tokens long, chars long"


def _count(batches, path, version):
    enc = encoder(path, 500_000)
    for batch, texts in text_groups(batches, most=1_000_000):
        tokens = [len(ids) // 4 for ids in enc.encode(texts)]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array([version] * n, pa.string()), pa.array(tokens, pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
            ["doc_id", "source", "lang", "version", "tokens", "chars"],
        )


def counted(docs: DataFrame, version: str, path: str) -> DataFrame:
    """doc_id, source, lang, version, tokens and chars of every row of docs (doc_id, source, lang, text), by the tokenizer file at path."""
    cols = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text"]
    return docs.select(*cols).mapInArrow(lambda b: _count(b, path, version), _COUNTED)


def signed(counts: DataFrame, sign: int | Column) -> DataFrame:
    return counts.withColumn("sign", F.lit(sign) if isinstance(sign, int) else sign)


def totals(changes: DataFrame) -> DataFrame:
    """The totals of signed changes; few rows, whatever the number of changes."""
    s = F.col("sign")
    return changes.groupBy(*KEYS).agg(F.sum(s).cast("long").alias("docs"), F.sum(s * F.col("tokens")).cast("long").alias("tokens"), F.sum(s * F.col("chars")).cast("long").alias("chars"))


def _ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Numbers as ranges, both ends included."""
    out: list[list[int]] = []
    for n in sorted(set(numbers)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [(a, b) for a, b in out]


class Rollup:
    """Totals kept in a folder that all executors share: a sub-folder for each batch, and for each base."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> dict[int, str]:
        """By number, the folder that was marked first."""
        p, fs = self._fs(kind)
        best: dict[int, tuple[int, str]] = {}
        if fs.exists(p):
            for s in fs.listStatus(p):
                name = s.getPath().getName()
                mark = self._fs(f"{kind}/{name}/_DONE")[0]
                if fs.exists(mark):
                    number, when = int(name.split("-")[0]), (fs.getFileStatus(mark).getModificationTime(), name)
                    best[number] = min(best.get(number, when), when)
        return {n: name for n, (_, name) in best.items()}

    def _write(self, kind: str, number: int, tables: dict[str, DataFrame]) -> str:
        name = f"{number:020d}-{uuid.uuid4().hex}"
        for table, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{self.path}/{kind}/{name}/{table}")
        mark, fs = self._fs(f"{kind}/{name}/_DONE")
        fs.create(mark, False).close()
        return name

    def _base(self) -> tuple[int, str | None, list[tuple[int, int]]]:
        """The number and name of the last base, and the ranges of batches in it."""
        found = self._marked("base")
        if not found:
            return -1, None, []
        last = max(found)
        rows = self.spark.read.schema("lo long, hi long").parquet(f"{self.path}/base/{found[last]}/folded").collect()  # a row for each gap between batches
        return last, found[last], sorted((r.lo, r.hi) for r in rows)

    def _open(self, folded: list[tuple[int, int]]) -> dict[int, str]:
        return {n: name for n, name in self._marked("batch").items() if not any(a <= n <= b for a, b in folded)}

    def batches(self) -> list[tuple[int, int]]:
        """Ranges of the numbers of all committed batches."""
        folded = self._base()[2]
        return _join([*folded, *_ranges(list(self._open(folded)))])

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing done, if it was committed before."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        if any(a <= batch <= b for a, b in self.batches()):
            return False
        name = self._write("batch", batch, {"totals": totals(changes)})
        folded = self._base()[2]
        if self._open(folded).get(batch) == name:
            return True
        p, fs = self._fs(f"batch/{name}")  # another writer's was marked before
        fs.delete(p, True)
        return False

    def read(self) -> DataFrame:
        """The totals after all committed batches; groups that no document is left in go."""
        _, base, folded = self._base()
        paths = [f"{self.path}/batch/{name}/totals" for name in self._open(folded).values()]
        if base:
            paths.append(f"{self.path}/base/{base}/totals")
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths)
        out = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "chars")])
        return out.where("docs <> 0 or tokens <> 0 or chars <> 0")

    def compact(self) -> None:
        """Fold all batches into a new base. Readers that began before may have to read again."""
        last, base, folded = self._base()
        new = self._open(folded)
        if not new:
            return
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/batch/{n}/totals" for n in new.values()], *([f"{self.path}/base/{base}/totals"] if base else []))
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "chars")])
        listed = self.spark.createDataFrame(_join([*folded, *_ranges(list(new))]), "lo long, hi long")
        self._write("base", last + 1, {"totals": sums, "folded": listed})
        folded = self._base()[2]  # of two writers' bases the one that counts
        p, fs = self._fs("batch")
        for s in fs.listStatus(p):
            if any(a <= int(s.getPath().getName().split("-")[0]) <= b for a, b in folded):
                fs.delete(s.getPath(), True)


def _join(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
