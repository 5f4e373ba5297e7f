"""Queries of the operators over whole tables, and their SQL equivalents."""

from __future__ import annotations

import public_tokenizers
from framesift.llm import (
    decontamination, forest_search, jaccard_join, language_model, line_dedup, merkle_log, mixing, quality_rules, substring_dedup, token_files, tokens, toxicity,
    vector_codes,
)
from framesift.llm import queries_sql
from framesift.llm.common import table
from pyspark.sql import functions as F


def op1_line_dedup(spark, folder):
    rows = line_dedup.without_later_passages(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["units"])
    return rows.select("doc_id", "n_units", gone.alias("n_removed"), spans.alias("removed_spans"), "text")


def op2_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_language_model(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text", "lang"), table(spark, folder, "labels")
    return language_model.classified(docs, labels).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")


def op10_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    rows = quality_rules.judged(docs, table(spark, folder, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_jaccard_join(spark, folder):
    rows = jaccard_join.joined(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    return toxicity.scored(docs, toxicity.learn(docs, labels))


def op5_decontamination(spark, folder):
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    rows = decontamination.judged(decontamination.matches(docs, items))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op6_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = tokens.token_prefixes(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit"))


def op7_suffix_dedup(spark, folder):
    rows = substring_dedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark, folder):
    path = token_files.new_path(spark)
    token_files.write_tokens(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.token_digests(token_files.read_tokens(spark, path))


def op11_forest_search(spark, folder):
    found = forest_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)
    return found.select("query_id", "rank", "vec_id", "score")


def op12_vector_codes(spark, folder):
    rows, codes = vector_codes.coded(table(spark, folder, "embeddings"))
    return vector_codes.with_label_errors(rows).select(
        F.col("id").alias("vec_id"), "code", vector_codes.as_long("error"), vector_codes.as_long("label_error"),
        F.lit(vector_codes.digest_of(codes)).alias("codebooks_sha256"),
    )


def op13_merkle_log(spark, folder):
    return merkle_log.proven(table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_mixing, op3_jaccard_join, op4_toxicity, op5_decontamination,
        op6_token_counts, op7_suffix_dedup, op8_token_files, op9_language_model, op10_quality_rules,
        op11_forest_search, op12_vector_codes, op13_merkle_log,
    )
}

_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
limits AS (
  SELECT *, 2 * source_size AS lim, 3 * sum(source_size) OVER () AS wanted, 2 * source_size * (10 // weight) AS rank FROM sources),
marked AS (
  SELECT *, (wanted - 2 * coalesce(sum(lim) OVER (ORDER BY rank, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
            >= 2 * lim * sum(weight) OVER (ORDER BY rank, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_limit
  FROM limits),
parts AS (
  SELECT *, weight * (wanted - 2 * coalesce(sum(lim) FILTER (at_limit) OVER (), 0)) AS part, 2 * sum(weight) FILTER (NOT at_limit) OVER () AS whole FROM marked),
targets AS (
  SELECT source, source_size, CASE WHEN at_limit THEN lim::DOUBLE ELSE part::DOUBLE / whole::DOUBLE END AS target,
         CASE WHEN at_limit THEN lim ELSE part // whole END::BIGINT AS budget
  FROM parts),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before,
         CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS epochs
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - words_before, 0), size))::BIGINT AS taken
FROM placed
"""

_OP1 = r"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS p FROM documents)),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS start,
         lag(piece) OVER (PARTITION BY doc_id ORDER BY i) AS blanks, lag(piece, 2) OVER (PARTITION BY doc_id ORDER BY i) AS word
  FROM pieces),
words AS (
  SELECT *, sum(CASE WHEN word IS NULL OR contains(blanks, chr(10)) OR right(word, 1) IN ('.', '!', '?', ',', ';', ':') THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY i) AS unit
  FROM placed WHERE NOT regexp_matches(piece, '^[\x20\x09-\x0D]')),
units AS (
  SELECT doc_id, unit, min(start) AS start, count(*) AS n_words, sum(length(piece)) AS n_characters,
         string_agg(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY i) AS norm
  FROM words GROUP BY doc_id, unit),
ranked AS (
  SELECT u.doc_id, unit, start, n_words, n_characters, row_number() OVER (PARTITION BY norm ORDER BY u.doc_id, unit) > 1 AS later,
         coalesce(lead(start) OVER (PARTITION BY u.doc_id ORDER BY unit), length(text)) AS next
  FROM units u JOIN documents d ON u.doc_id = d.doc_id),
runs AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id, later ORDER BY unit) AS run FROM ranked),
marked AS (
  SELECT *, later AND (sum(n_words) OVER (PARTITION BY doc_id, later, run) >= 40
                       OR sum(n_characters) OVER (PARTITION BY doc_id, later, run) >= 300) AS gone
  FROM runs),
spans AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans
  FROM (SELECT doc_id, run, min(start)::BIGINT AS a, max(next)::BIGINT AS b FROM marked WHERE gone GROUP BY doc_id, run) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, min(start) AS head FROM marked GROUP BY doc_id),
kept AS (
  SELECT m.doc_id, string_agg(substring(text, (start + 1)::BIGINT, (next - start)::BIGINT), '' ORDER BY unit) AS rest
  FROM marked m JOIN documents d ON m.doc_id = d.doc_id WHERE NOT gone GROUP BY m.doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_spans, '') AS removed_spans,
       CASE WHEN n_units IS NULL THEN coalesce(text, '') ELSE left(text, head::BIGINT) || coalesce(rest, '') END AS text
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE = {
    "op1_line_dedup": _OP1,
    "op2_mixing": _OP2,
    "op12_vector_codes": queries_sql.vector_codes(),
    "op13_merkle_log": queries_sql.merkle_log(),
}
