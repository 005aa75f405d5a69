"""The registered queries: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, digest, html_blocks, langid, packing, periodic, rlindex, sentence_spans, simhash, token_rollup, topk, turns, warc
from .frames import cut, load, scratch


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(load(spark, sf_dir, "pages"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs).select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_removed")


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"), tokenizer_path(), digest=True)


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlindex.remove_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "langs")


def op6_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(load(spark, sf_dir, "documents"), tokenizer_path(), limit=1_500_000))


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents inserted; those whose id is divisible by 7 deleted; those divisible by 11 counted anew by another tokenizer; the second batch once more, without effect."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.Rollup(spark, scratch(spark, "rollup"))
    gone, again = F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False)), F.coalesce((F.col("doc_id") % 7 != 0) & (F.col("doc_id") % 11 == 0), F.lit(False))
    old = cut(token_rollup.counted(docs, "word_bpe_49k", tokenizer_path()), "counts")
    new = token_rollup.counted(docs.where(again), "byte_bpe_50k", tokenizer_path("byte_bpe_50k.json"))
    rollup.commit(0, token_rollup.signed(old, 1))
    rollup.commit(1, token_rollup.signed(old.where(gone), -1))
    rollup.commit(2, token_rollup.signed(old.where(again), -1).unionByName(token_rollup.signed(new, 1)))
    rollup.commit(1, token_rollup.signed(old.where(gone), -1))
    return rollup.read()


def op9_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(load(spark, sf_dir, "documents"))


def op10_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"))


_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(load(spark, sf_dir, "pages"), scratch(spark, "warc"), least=0)
    records = cut(warc.read(archives).where("record_type is null or record_type != 'warcinfo'"), "records")
    return warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


_OP11 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS first, count(*) AS n FROM p GROUP BY payload),
r AS (
  SELECT p.page_id, octet_length(p.payload) AS size, sha1(p.payload) AS hex,
    CASE WHEN g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
  FROM p JOIN g ON p.payload = g.payload)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(10 * (x // 8) + 1 AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (x % 8))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, 'ok' AS status
FROM r
"""


def _spoilt(talks: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with one fault in five of twenty rows, by a hash of conversation and turn; nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(shown("role"))
    rows = talks.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind != 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = load(spark, sf_dir, "conversations")
    rows = _spoilt(talks)
    found = turns.inspect(rows)
    digests = turns.repaired(rows, found, digest=True).withColumnRenamed("conv_id", "of")
    ids = talks.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("id").eqNullSafe(F.col("of")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of the empty string
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))


_OP12 = r"""
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM conversations),
hashed AS (
  SELECT * EXCLUDE (bytes, t), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS kind
  FROM keyed, bits),
rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END))
  FROM hashed WHERE kind <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    row_number() OVER w AS n, lag(left(role, 1)) OVER w AS before
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
faults AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
counted AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n_rows
  FROM faults GROUP BY conv_id),
grammar(a, r, b) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
ways(letters, edit, a, r, b, cost) AS (
  SELECT '', 'D', a, '', a, 4 FROM (VALUES (''), ('s'), ('u'), ('a')) x(a)
  UNION ALL SELECT '', 'K', a, r, b, 0 FROM grammar UNION ALL SELECT '', 'R', a, '', b, 3 FROM grammar WHERE r <> 's'
  UNION ALL SELECT 'I', 'D', a, '', b, 7 FROM grammar WHERE r <> 's'
  UNION ALL SELECT 'I', 'K', g.a, h.r, h.b, 3 FROM grammar g JOIN grammar h ON h.a = g.b WHERE g.r <> 's'
  UNION ALL SELECT 'I', 'R', g.a, '', h.b, 6 FROM grammar g JOIN grammar h ON h.a = g.b WHERE g.r <> 's'),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, '' AS state, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS way FROM counted
  UNION ALL
  SELECT p.conv_id, p.n + 1, w.b, min({'cost': p.way.cost + w.cost + CASE WHEN f.fault = 'truncated' AND w.edit <> 'D' THEN 3 ELSE 0 END, 'audit': p.way.audit || w.letters || w.edit})
  FROM best p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1
    JOIN ways w ON w.a = p.state AND (w.r = '' OR w.r = f.i) AND (w.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.conv_id, p.n, w.b),
chosen AS (
  SELECT c.conv_id, min({'cost': b.way.cost + CASE WHEN b.state = 'u' THEN 3 ELSE 0 END, 'audit': b.way.audit || CASE WHEN b.state = 'u' THEN 'I' ELSE '' END}) AS way
  FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.n = c.n_rows WHERE b.state <> 's' GROUP BY c.conv_id),
letters AS (
  SELECT conv_id, way.audit AS audit, CAST(unnest(range(1, len(way.audit) + 1)) AS BIGINT) AS k FROM chosen),
edits AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit, k - (len(left(audit, k)) - len(replace(left(audit, k), 'I', ''))) AS n FROM letters),
kept AS (
  SELECT e.conv_id, e.k, e.edit, f.role, f.text, f.i, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS spot
  FROM edits e LEFT JOIN faults f ON e.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = e.n WHERE e.edit <> 'D'),
shifted AS (
  SELECT *, CASE WHEN first_value(CASE WHEN edit = 'K' THEN i END) OVER (PARTITION BY conv_id ORDER BY spot) = 's' THEN spot - 1 ELSE spot END AS turn_no FROM kept),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN turn_no % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS whole
  FROM shifted GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(h.way.cost, 0) AS cost, coalesce(h.way.audit, '') AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _repeating(doc_id: Column, text: Column) -> Column:
    """Every tenth text, by a hash of its id, with all words from one place on replaced by the first few from there, again and again."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def spoilt(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, spoilt(w))), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic.detect(docs).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_blocks, op2_sentence_spans, op3_bpe_chunks, op4_run_length_index, op5_language_mixture,
        op6_simhash_balls, op7_best_fit_packing, op8_token_rollups, op9_exact_digest, op10_max_score, op11_warc_archives, op12_turn_repair, op13_periodic_runs, pipeline,
    )
}

ORACLES = {"op10_max_score": _OP10, "op11_warc_archives": _OP11, "op12_turn_repair": _OP12}
