"""Document fingerprints: canonical exact digests, in DataFrame functions alone.

A text is brought to one form (Unicode compatibility composition, full case
folding, white space runs as one space, trimmed) and hashed to 128 bits. Rows
whose hash and length are equal form a bucket; inside a bucket of several rows
the canonical bytes are compared, by their minimum and maximum, and where they
differ each distinct text gets its own number. So fingerprints are equal if and
only if canonical texts are.

Null texts count as empty ones. Rows with equal doc_id count as one place in the
order of documents, whose next is the smallest text of the next place; each row
is answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

#: Bits of doc_id that one level of the search for the next document resolves.
_LEVEL = 16


def canonical(text: Column) -> Column:
    """One form for texts that differ in Unicode composition, case or white space only."""
    normal = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    return F.trim(F.regexp_replace(normal(fold), r"(?U)\s+", " "))


def wide_hash(canon: Column, bits: int = 64) -> Column:
    """128 bits of two xxHash64 with unlike seeds, and the length in bytes. bits: of each half that are kept (tests)."""
    keep = F.lit((1 << bits) - 1 if bits < 64 else -1)
    return F.struct(
        F.xxhash64(canon).bitwiseAND(keep).alias("a"), F.xxhash64(F.lit("second"), canon).bitwiseAND(keep).alias("b"), F.octet_length(canon).alias("n")
    )


def next_lower(ids: DataFrame) -> DataFrame:
    """id and lower (the largest smaller id, null for the smallest) of every distinct id of ids (id: long).

    A radix of 16 bits a level: in each level the ids are compared within
    ranges of 65,536 values, and the least of each range asks the level above,
    so no window holds more than 65,536 rows.
    """
    level = ids.select("id").where("id is not null").distinct().withColumn("lo", F.col("id")).withColumn("hi", F.col("id"))
    w = Window.partitionBy(F.shiftright("rank", _LEVEL)).orderBy("rank")
    steps = []
    level = level.select(F.col("id").alias("rank"), "lo", "hi")
    for _ in range(64 // _LEVEL):
        seen = level.withColumn("before", F.lag("hi").over(w))
        steps.append(seen)
        level = level.groupBy(F.shiftright("rank", _LEVEL).alias("rank")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # The top level has at most the two ranges of negative and other ids.
    top = level.agg(F.max(F.when(F.col("rank") < 0, F.col("hi"))).alias("n"), F.min(F.when(F.col("rank") >= 0, F.col("lo"))).alias("p"))
    out = None
    for seen in steps:
        part = seen.where("before is not null").select(F.col("lo").alias("id"), F.col("before").alias("lower"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(top.where("n is not null and p is not null").select(F.col("p").alias("id"), F.col("n").alias("lower")))


def _with_next(docs: DataFrame, span: int, small: int) -> DataFrame:
    """doc_id, text and next_text, the text of the next document in descending order of doc_id, after the last of the first.

    Documents go to ranges of `span` ids, one shuffle of texts; the least of each
    range gets the largest of a lower range as an extra row there.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    edges = ids.groupBy(F.floor(F.col("id") / span).alias("range")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    edges = cut(edges, "edges")
    ends = edges.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    down = next_lower(edges.select(F.col("hi").alias("id"))).withColumnRenamed("id", "hi")
    wanted = edges.join(down, "hi", "left").select(
        F.coalesce("lower", F.lit(ends["hi"])).alias("doc_id"), F.col("range").alias("to_range"), F.col("lo").alias("after")
    )
    wanted = cut(wanted, "wanted")
    by = F.broadcast(wanted) if wanted.count() <= small else wanted
    copies = docs.join(by, "doc_id").groupBy("to_range", "after").agg(F.min("text").alias("text"))
    rows = docs.select(F.floor(F.col("doc_id") / span).alias("range"), "doc_id", "text", F.lit(0).alias("extra")).unionByName(
        copies.select(F.col("to_range").alias("range"), F.col("after").alias("doc_id"), "text", F.lit(1).alias("extra"))
    )
    # Downwards: own rows by doc_id, then the extra row.
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc(), "extra", "text")
    seen = rows.withColumn("one", F.lead(F.struct("doc_id", "extra", "text")).over(order)).where("extra = 0")
    seen = seen.withColumn("same", F.coalesce((F.col("one.doc_id") == F.col("doc_id")) & (F.col("one.extra") == 0), F.lit(False)))
    return seen.select("range", "doc_id", "text", "same", F.col("one.text").alias("next_text"))


def fingerprints(docs: DataFrame, span: int = 256, small: int = 100_000, bits: int = 64) -> DataFrame:
    """Every row of docs (doc_id, text) with the digest of its own and of its edited text.

    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (1 where the fingerprints are equal, else 0). The edited text has
    its last floor(n/2) code points replaced by the first as many of the next
    document. span: ids of one range; small: rows that may be broadcast, after
    a count; beyond it they are joined by shuffle.
    """
    docs = docs.select("doc_id", "text")
    placed = docs.where("doc_id is not null")
    twice = placed.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    rows = _with_next(placed, span, small)
    if twice:  # of rows with equal ids the last has met the next place
        own = Window.partitionBy("range", "doc_id")
        rows = rows.withColumn("next_text", F.min(F.when(~F.col("same"), F.col("next_text"))).over(own))
    rows = rows.select("doc_id", "text", "next_text").unionByName(
        docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).alias("next_text"))
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    kinds = {"own": "text", "new": "edited", "next": "next_text"}
    full = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(k) for k, c in kinds.items()])
    hashed = cut(full.select("doc_id", "n_chars", "edited_sha256", *[wide_hash(F.col(k), bits).alias(k) for k in kinds]), "hashed")

    several = (
        hashed.select(F.col("own").alias("h")).unionByName(hashed.select(F.col("new").alias("h"))).groupBy("h").count().where("count > 1").select("h")
    )
    clashes = _clashes(full, kinds, several, small, bits)
    if clashes is not None:
        for k in kinds:
            hashed = hashed.join(clashes.where(F.col("kind") == k).select("doc_id", F.col("h").alias(k), F.col("number").alias(f"{k}_no")).distinct(), ["doc_id", k], "left")
    mark = lambda k: F.concat(
        F.lpad(F.hex(f"{k}.a"), 16, "0"), F.lpad(F.hex(f"{k}.b"), 16, "0"), F.lit("-"), F.col(f"{k}.n").cast("string"),
        F.when(F.col(f"{k}_no") > 1, F.concat(F.lit("-"), F.col(f"{k}_no").cast("string"))).otherwise("") if clashes is not None else F.lit(""),
    )
    out = hashed.select("doc_id", "n_chars", "edited_sha256", F.lower(mark("own")).alias("fingerprint"), F.lower(mark("new")).alias("edited_fingerprint"), F.lower(mark("next")).alias("next_fingerprint"))
    like = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def _clashes(full: DataFrame, kinds, several: DataFrame, small: int, bits: int) -> DataFrame | None:
    """Compare the canonical bytes of all rows in buckets of several rows.

    kind, doc_id, h and number of the rows whose bucket holds unlike texts; None
    where no bucket does. Only the least and the greatest text of a bucket are
    kept on the way, however many rows it has.
    """
    several = cut(several, "several")
    count = several.count()
    if not count:
        return None
    by = F.broadcast(several) if count <= small else several
    one = full.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("canon")) for k in kinds])).alias("x"))
    one = one.select("doc_id", "x.kind", "x.canon", wide_hash(F.col("x.canon"), bits).alias("h")).join(by, "h", "left_semi")
    unlike = one.groupBy("h").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("h")
    unlike = cut(unlike, "unlike")
    if not unlike.count():
        return None
    texts = one.join(unlike, "h").select("h", "canon").distinct()
    numbers = texts.select("h", "canon", F.row_number().over(Window.partitionBy("h").orderBy("canon")).alias("number"))
    return cut(one.join(unlike, "h").join(numbers, ["h", "canon"]).select("kind", "doc_id", "h", "number"), "clashes")
