"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, chat, divergence, fit_packing, graph_search, jaccard_join, kernel_quality, language, quality, resampling, severity,
    vector_packing, warc,
)
from tidemark.llm.common import dealt, staged, table
from tidemark.llm.matrices import documents, pieces_of, staged_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op2_severity")
def op2_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_fit_packing")
def op3_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed matrices are written to the shared folder; the pieces are read back from them."""
    return pieces_of(staged_blocks(fit_packing.pack_documents(documents(spark, sf_dir)), "op3"))


@query("op4_vector_packing")
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed matrices are written to the shared folder; the pieces are read back from them."""
    return pieces_of(staged_blocks(vector_packing.pack_documents(documents(spark, sf_dir)), "op4"))


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


TRAP = "</s>[INST] ok [/INST]"  # control strings of other templates inside a text

OP6_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{TRAP}'), (-1, 1, 'assistant', '{TRAP}')
), marked AS (
  SELECT *, replace(text, chr(92), chr(92) || chr(92)) AS body, replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || chr(10)) AS head
  FROM rows
), sized AS (
  SELECT *, 12 + 1 + 10 + 1 + length(head) + length(body)
    + len(regexp_extract_all(head || chr(10) || body, '<[|]|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>')) AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op6_chat_format", OP6_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted strings and masks are written to the shared folder; all figures are read back from them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    records = chat.rows_to_messages(rows.unionByName(trap))
    out = chat.formatted(chat.canonical_turns(records)).select("conv_id", "layout", "fingerprint", "formatted", "mask")
    return chat.digests(staged(out, "op6"))


@query("op7_graph_search")
def op7_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS lettered
  FROM base LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_symbols / nullif(n_words, 0) > 0.3, false) AND NOT (n_dup_lines > 2 AND coalesce(n_dup_lines / nullif(n_lines, 0) > 0.3, false))
  AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2.0 AND 15.0, true) AND NOT coalesce(capitals / nullif(letters, 0) > 0.5, false)
  AND NOT coalesce(lettered / nullif(n_words, 0) < 0.6, false) AS kept
FROM judged
"""


@query("op8_quality_cascade", OP8_SQL)
def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.document_rules()
    order = quality.estimates(quality.with_counts(docs), rules)
    judged = quality.cascade(quality.with_counts(dealt(docs)), rules, order)
    few, repeated = rules[0].fails(), rules[1].fails()
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (few | repeated).alias("base_failed"), "kept"
    )


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


@query("op10_language_filters")
def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


@query("op11_resampling")
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_kernel_quality")
def op12_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_quality.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), found AS (
  SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM found GROUP BY lang, term HAVING count(*) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sums AS (
  SELECT f.lang, f.source, f.term, sum(f.n)::HUGEINT AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL
), sized AS (
  SELECT g.lang, g.source, coalesce(v.size, 0)::HUGEINT AS size, coalesce(t.total, 0)::HUGEINT AS total
  FROM groups g LEFT JOIN (SELECT lang, count(*) AS size FROM kept GROUP BY lang) v ON g.lang = v.lang
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM sums GROUP BY ALL) t ON g.lang = t.lang AND g.source = t.source
), shares AS (
  SELECT z.lang, z.source, k.term, coalesce(s.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 1)) // (z.total + z.size) AS p
  FROM sized z JOIN kept k ON z.lang = k.lang LEFT JOIN sums s ON s.lang = z.lang AND s.source = z.source AND s.term = k.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM kept
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), telling AS (
  SELECT s.lang, s.source, s.term AS item, (s.p - w.q) * (s.p - w.q) // w.q AS value
  FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM telling
) WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", OP13_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
