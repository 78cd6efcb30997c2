"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.llm import alignment, bpe, chat, html, licences, mtree, near, packing, pieces, quality, ring, toxic, whitening
from inkveil.llm.common import table

TOKENIZER = "word_bpe_49k.json"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 16


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs.select("doc_id", "source", "text"), F.col("source")).select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
        "quality.n_repeat_words", "quality.base_failed", "quality.kept",
    )


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trip = bpe.round_trip(F.col("text"), public_tokenizers.path(TOKENIZER))
    return docs.select("doc_id", trip.alias("t")).select("doc_id", "t.*")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("gap")


def op4_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("group"),
    )
    placed = ring.sharded(docs, F.col("group"), "doc_id", SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_mtree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", mtree.integers(F.col("embedding")).alias("v"))
    vectors = vectors.where("v IS NOT NULL AND vec_id IS NOT NULL")
    return mtree.best_of(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op7_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    return chat.formatted_digests(given.unionByName(trap))


def op8_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), into="found")
    confirmed = "filter(found, x -> x.family <> 'unknown' AND x.confirmed)"
    return found.selectExpr(
        "doc_id",
        f"array_join(array_sort(array_distinct(transform({confirmed}, x -> x.family))), ',') AS licences",
        f"cast(size({confirmed}) AS long) AS n_confirmed",
        "cast(size(filter(found, x -> x.family <> 'unknown' AND NOT x.confirmed)) AS long) AS n_unconfirmed",
        "cast(size(filter(found, x -> x.family = 'unknown')) AS long) AS n_unknown",
    )


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic.fit_on(docs, table(spark, sf_dir, "labels"), ~toxic.held_out())
    rows = docs.select("doc_id", toxic.held_out().alias("held_out"), toxic.scored(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= toxic.THRESHOLD).cast("int"))


def op10_host_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html.main_texts(pages, html.host_of(F.col("url")))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trip = pieces.round_trip(F.col("text"), public_tokenizers.path(PIECES))
    return docs.select("doc_id", trip.alias("t")).select("doc_id", "t.*")


def op12_hashed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = alignment.aligned(docs, ["doc_id"], "text", public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("embedding"))
    error = whitening.identity_error(rows.select("white.whitened"), len(model.components))
    long = rows.select("vec_id", "white.deviation", F.posexplode("white.whitened").alias("place", "whitened"))
    return long.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, model.explained)).cast("array<double>"), "place").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_bpe_transducer, op3_best_fit_packing, op4_minhash_near, op5_ring_shards, op6_mtree_top5, op7_chat_template, op8_licence_paragraphs, op9_string_kernel_toxicity, op10_host_path_text, op11_prefix_table_pieces, op12_hashed_alignment, op13_exact_whitening)}

_SOFT = {
    "thin": "n_words < 20",
    "repetitive": "100 * n_repeat_words > 10 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "n_dup_lines >= 3",
}

OP1_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (
    SELECT r, i, unnest(range(0, 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1)
  GROUP BY r),
lines AS (
  SELECT r, sum(c - 1) AS n FROM (
    SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line)
  GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines ON lines.r = d.r LEFT JOIN repeated ON repeated.r = d.r),
hosts AS (
  SELECT source AS host, count(*) AS n, {", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS {r}" for r, c in _SOFT.items())}
  FROM m GROUP BY source),
total AS (
  SELECT sum(n) AS n, count(*) AS h, {", ".join(f"sum({r}) / sum(n) AS {r}, sum({r} * {r} / n) / sum(n) AS {r}_sq" for r in _SOFT)}
  FROM hosts),
weights AS (
  SELECT *, {", ".join(f'''CASE WHEN {r}_sq - {r} * {r} - {r} * (1 - {r}) * h / n > 0
    THEN least(greatest({r} * (1 - {r}) / ({r}_sq - {r} * {r} - {r} * (1 - {r}) * h / n) - 1, 2), 1000) ELSE 1000 END AS {r}_w''' for r in _SOFT)}
  FROM total),
habits AS (
  SELECT host, {", ".join(f"(hosts.{r} + weights.{r} * {r}_w) / (hosts.n + {r}_w) >= 0.5 AS {r}" for r in _SOFT)}
  FROM hosts, weights)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
    OR {" OR ".join(f"(habits.{r} AND {c})" for r, c in _SOFT.items())}) AS kept
FROM m LEFT JOIN habits ON m.source IS NOT DISTINCT FROM habits.host
"""

OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.r AS r, y.r AS q, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r) p
  JOIN n a ON a.r = p.r JOIN n b ON b.r = p.q
  WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.r = d.r JOIN least ON least.a = d.doc_id
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""

ORACLES = {"op1_quality_rules": OP1_SQL, "op4_minhash_near": OP4_SQL, "op6_mtree_top5": OP6_SQL, "op8_licence_paragraphs": licences.twin_sql()}
