"""The registered queries of the training-data operators: one per operator, over whole tables.

Most have no SQL form (models, automata, tokenizers, permutations and components
are beyond it); ``tests/llm`` holds each against brute force.  The last two have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsweave.llm import backoff_lm, bin_completion, compression_bands, content_sort, external_shuffle, jacobi_whitening, secret_automaton, simhash_popcount, string_tiling, subword_classifier, template_lines, token_resync, tuple_resampling
from oddsweave.llm._shared import remainder, table

SHARDS = 24
QUALITY_FROM = 0.3


def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return compression_bands.verdicts(table(spark, sf_dir, "documents")).select(*base, "n_bytes", "ratio", "n_chunks", "n_chunks_low", "n_chunks_high", "band")


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = external_shuffle.shuffle(table(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        external_shuffle.text_size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = template_lines.rewrite(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("row_id", "doc_id")


def op7_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subword_classifier.train(docs, table(spark, sf_dir, "labels"), lambda key: remainder(key, 5) != 0)
    scored = subword_classifier.score(docs, model)
    return scored.select(F.col("row_id").alias("doc_id"), (remainder(F.col("row_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op8_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_automaton.scan(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")
    first = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return found.select(*first, *(c for c in found.columns if c not in first))


def op9_token_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_resync.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


def op10_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_popcount.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = jacobi_whitening.clean(table(spark, sf_dir, "embeddings"))
    model = jacobi_whitening.fit(sound)
    rows = jacobi_whitening.whiten(sound, model).select(F.col("row_id").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained[:32].tolist())) if model is not None else F.array().cast("array<double>")
    error = jacobi_whitening.identity_error(sound, model) if model is not None else 0.0
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_tuple_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = tuple_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("row_id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_sort.classes(table(spark, sf_dir, "documents"), largest=True)
    return found.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: crc32 is linear over exclusive or: a byte adds what its value and its distance from the end decide, the length adds the rest.
OP12_SQL = r"""
WITH RECURSIVE
bytes AS (SELECT range::BIGINT AS b FROM range(256)),
first_step AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM bytes),
far(d, b, c) AS (
  SELECT 0, b, c FROM first_step
  UNION ALL
  SELECT f.d + 1, f.b, xor(f.c >> 8, s.c) FROM far f JOIN first_step s ON s.b = f.c & 255
  WHERE f.d + 1 < (SELECT 3 * max(strlen(w)) + 2 FROM (SELECT unnest(string_split_regex(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents UNION ALL SELECT unnest(string_split_regex(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark))),
start(n, c) AS (
  SELECT 0, 4294967295::BIGINT
  UNION ALL
  SELECT t.n + 1, xor(t.c >> 8, s.c) FROM start t JOIN first_step s ON s.b = t.c & 255 WHERE t.n <= (SELECT max(d) FROM far)),
given AS (
  SELECT 'd' AS side, row_number() OVER () AS row_no, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark),
listed AS (
  SELECT side, row_no, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM given),
words AS (SELECT side, row_no, unnest(w) AS w1, unnest(range(len(w))) AS k FROM listed),
runs AS (SELECT side, row_no, w1, lag(w1) OVER p AS w0, lag(w1, 2) OVER p AS w00 FROM words WINDOW p AS (PARTITION BY side, row_no ORDER BY k)),
features AS (
  SELECT side, row_no, w1 AS f FROM runs
  UNION ALL SELECT side, row_no, w0 || ' ' || w1 FROM runs WHERE w0 IS NOT NULL
  UNION ALL SELECT side, row_no, w00 || ' ' || w0 || ' ' || w1 FROM runs WHERE w00 IS NOT NULL),
counted AS (SELECT side, row_no, f, count(*) AS n FROM features GROUP BY ALL),
spelled AS (SELECT f, lower(hex(encode(f))) AS h, strlen(f) AS len FROM (SELECT DISTINCT f FROM counted)),
spread AS (SELECT f, len, unnest(range(len)) AS k, h FROM spelled),
valued AS (SELECT f, len, len - 1 - k AS d, (instr('0123456789abcdef', h[2 * k + 1]) - 1) * 16 + instr('0123456789abcdef', h[2 * k + 2]) - 1 AS b FROM spread),
hashed AS (
  SELECT v.f, xor(xor(bit_xor(far.c), any_value(start.c)), 4294967295) % 10000 AS bucket
  FROM valued v JOIN far ON far.d = v.d AND far.b = v.b JOIN start ON start.n = v.len GROUP BY v.f),
placed AS (SELECT side, row_no, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
buckets AS (
  SELECT r.range AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t
  FROM range(10000) r LEFT JOIN placed p ON p.bucket = r.range GROUP BY r.range),
sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM buckets, sums),
weights AS (SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_no),
scores AS (
  SELECT l.doc_id, len(l.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || l.doc_id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM listed l LEFT JOIN weights USING (row_no) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS drawn FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= drawn THEN r END AS rank FROM ranked
"""

OP13_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict:
    own = (op1_backoff_lm, op2_compression_bands, op3_external_shuffle, op4_template_lines, op5_bin_completion, op6_string_tiling, op7_subword_classifier, op8_secret_automaton, op9_token_resync, op10_simhash_popcount, op11_jacobi_whitening, op12_tuple_resampling, op13_content_sort)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op12_tuple_resampling": OP12_SQL, "op13_content_sort": OP13_SQL}
