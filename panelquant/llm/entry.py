"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontaminate, fingerprint, langid, line_dedup, mixing, ngram_join, packing, quality, substrings, toxicity, vector_codes
from .tokenizer import tokenizer_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprint.fingerprint_with_edits(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose like stands earlier in the corpus."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_duplicate_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text under the mixing model and under word counts."""
    return mixing.score_documents(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of ten words of the benchmark."""
    index = decontaminate.build_index(_read(spark, sf_dir, "documents"))
    return decontaminate.digest(decontaminate.contamination(index, _read(spark, sf_dir, "benchmark")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text."""
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard similarity 0.85 or more."""
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return langid.classify(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its repaired role and its part of the rendered conversation."""
    return chat.format_turns(_read(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every embedding by eight codebooks of sixteen entries."""
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, in groups that cover the same bytes."""
    return alignment.digest(_read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages of 20 words that start earlier in the corpus."""
    return substrings.drop_repeats(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_line_dedup,
        op3_lm_scoring,
        op4_decontamination,
        op5_toxicity,
        op6_quality,
        op7_ngram_join,
        op8_language,
        op9_packing,
        op10_chat_format,
        op11_vector_codes,
        op12_tokenizer_alignment,
        op13_substring_dedup,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The k-means rounds one after the other; the bounds only save distances, so they don't show in the rows."""

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT r, p, e, d FROM (
    SELECT v.r, v.p, c.e, sum((v.x - c.x) * (v.x - c.x)) AS d,
           row_number() OVER (PARTITION BY v.r, v.p ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.e) AS n
    FROM v JOIN c{k} c ON c.p = v.p AND c.i = v.i GROUP BY v.r, v.p, c.e)
  WHERE n = 1)"""

    def moved(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM c{k} c LEFT JOIN (
    SELECT v.p, a.e, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{k} a ON a.r = v.r AND a.p = v.p GROUP BY ALL
  ) m ON m.p = c.p AND m.e = c.e AND m.i = c.i)"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT r, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS j, len(embedding) // {parts} AS w FROM kept
), v AS MATERIALIZED (SELECT r, j // w AS p, j % w AS i, CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT) AS x FROM flat),
c0 AS (SELECT p, r - 1 AS e, i, x FROM v WHERE r <= {entries}),
{steps},
{assigned(rounds)},
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM a{rounds} a JOIN kept k ON k.r = a.r GROUP BY k.r, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{rounds}) AS codebooks_sha256
FROM coded
"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _vector_codes_sql(),
    "op13_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 19)) AS i)
  WHERE len(w) >= 20
), again AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), removed AS (SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS k FROM again),
words AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN removed USING (r, k) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
""",
    "op4_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows), phrases AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)
  WHERE len(w) >= n
), found AS (SELECT p.r, p.i, p.n, x.item_id FROM phrases p JOIN windows x ON p.s = x.s AND p.n = x.n),
hit AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN items ON items.r = d.r
""",
    "op7_ngram_join": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
""",
}
