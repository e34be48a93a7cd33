"""Registered queries of the training-data operators, and their SQL where there is one.

Every query applies its operator with production parameters to the whole table and
returns the digest columns of the result.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, licenses, line_dedup, mixing, ngram_join, packing, phrases, pii_bootstrap, rendezvous,
               rule_ledger, token_files, toxic_segments, whitening)
from .common import documents, table

#: File name of the tokenizer of operators 1 and 13; its folder is found through the tokenizer package.
TOKENIZER = "word_bpe_49k.json"
#: Id that ends a document in the token files.
END_ID = 2
#: Id that ends a document in the packed sequences.
PACK_END_ID = 1
#: Shards of operator 4.
SHARDS = 16


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A tokenizer file: in ``CACHESCOPE_TOKENIZERS`` if set, else where the package has it."""
    if folder := os.environ.get("CACHESCOPE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_files.tokens_round_trip(docs, tokenizer_path(), END_ID)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "text_class", "n_copies", "n_links", "class_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    place = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = docs.select("doc_id", place.alias("path"), "text")
    return licenses.scan(files).select("doc_id", "path", "license", F.round("cosine", 9).alias("cosine"), "line_no",
                                       "scope", "inherited_from")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    sharded = rendezvous.assign(docs, [1.0] * SHARDS, grown_weights=[1.0] * (SHARDS + 1), keep_text=False)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.find(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_context")


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(documents(spark, sf_dir).select("doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "fail_bits", "policy")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), grams AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM words)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
         coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(w.text, '[^0-9]', '', 'g')) AS n_digits,
         length(regexp_replace(w.text, '[^A-Z]', '', 'g')) AS n_upper
  FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), judged AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
    + 64 * (100 * n_digits > 30 * word_chars)::BIGINT + 128 * (100 * n_upper > 50 * word_chars)::BIGINT AS fail_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'web-2' AS policy
FROM judged
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT a.doc_id, a.pos, a.line, h.k IS NOT NULL AND a.doc_id <> h.keeper AS gone
  FROM keyed a LEFT JOIN hot h ON a.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * 3 AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sources
), levels AS (
  SELECT *, cap / w AS ratio,
         ((sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, (ratio, rank)) FROM levels WHERE ratio >= level) * w) AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM placed
)
SELECT doc_id, size, source_size, target,
       rounds * size + least(size, greatest(0, budget - rounds * source_size - before)) AS taken
FROM cut
"""


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxic_segments.fit(docs, table(spark, sf_dir, "labels"))
    return toxic_segments.score(docs, model).select(
        "doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir).select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?
-]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p
        FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), counted AS (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), often AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM counted WHERE n >= 30
), halves AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r,
         (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM often WHERE k >= 2) c
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
), lowest AS (
  SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), absorbed AS (
  SELECT DISTINCT s.lang, s.phrase
  FROM (SELECT lang, k, a, array_to_string(w[p:p + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS p
              FROM often, (SELECT unnest([2, 3]) AS m) WHERE k >= 3 AND m < k)) g
  JOIN often s ON s.lang = g.lang AND s.phrase = g.phrase
  WHERE 100::HUGEINT * g.a >= 80::HUGEINT * s.a
), ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank
  FROM lowest c ANTI JOIN absorbed d ON c.lang = d.lang AND c.phrase = d.phrase
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), PACK_END_ID, keep_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_license_scan": op3_license_scan,
    "op4_rendezvous_shards": op4_rendezvous_shards,
    "op5_pii_bootstrap": op5_pii_bootstrap,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}

ORACLE: dict[str, str] = {
    "op6_rule_ledger": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_mixing": OP9_SQL,
    "op11_phrase_mining": OP11_SQL,
}
