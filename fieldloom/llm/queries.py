"""The queries of the corpus operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    out = quality(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_of, near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "kept.n_lines", "kept.n_dropped", F.col("kept.sha256").alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_read(spark, sf_dir, "documents")).drop("spans")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_simhash, op4_language_id, op5_token_counts, op6_secret_scan, op7_decontamination, op8_line_dedup, op9_license_scan, op10_sentencepiece)}


OP2_SQL = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 1))) AS i) r),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS j) z GROUP BY rid),
b AS (SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(list_filter(ws, lambda x: length(x) > 3 AND x = upper(x) AND x <> lower(x))) AS n_shouted,
length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0E-\\x1F\\x21-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS n_marks
FROM d JOIN w ON d.rid = w.rid LEFT JOIN l ON d.rid = l.rid LEFT JOIN r ON d.rid = r.rid),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [1000 * n_marks // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1), 1000 * n_shouted // greatest(n_words, 1), 1000 * word_chars // greatest(n_words, 1)] AS rates FROM b),
v AS (SELECT rid, lang, source, base_failed, m, rates[m]::BIGINT AS v FROM x, (SELECT unnest([1, 2, 3, 4, 5]) AS m) z),
s AS (SELECT lang, source, m, CASE WHEN v < 256 THEN v ELSE (v >> (length(bin(v)) - 8)::BIGINT) << (length(bin(v)) - 8)::BIGINT END AS bin FROM v WHERE NOT base_failed),
u AS (SELECT lang, source, m, bin, count(*) AS n, 1 AS level FROM s GROUP BY ALL UNION ALL SELECT lang, NULL, m, bin, count(*), 2 FROM s GROUP BY ALL UNION ALL SELECT NULL, NULL, m, bin, count(*), 3 FROM s GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS size FROM u),
q AS (SELECT level, lang, source, m, max(size) AS size, min(bin) FILTER (WHERE upto * 4 >= size) AS q1, min(bin) FILTER (WHERE upto * 4 >= size * 3) AS q3 FROM k GROUP BY ALL),
e AS (SELECT level, lang, source, m, size, q1 - [NULL, NULL, NULL, NULL, 4][m] * greatest(q3 - q1, [1, 100, 100, 20, 1][m]) AS low, q3 + [10, 4, 4, 4, 4][m] * greatest(q3 - q1, [1, 100, 100, 20, 1][m]) AS high FROM q),
t AS (SELECT o.lang, o.source, o.m, CASE WHEN o.size >= 100 THEN o.low WHEN l.size >= 100 THEN l.low ELSE a.low END AS low, CASE WHEN o.size >= 100 THEN o.high WHEN l.size >= 100 THEN l.high ELSE a.high END AS high
FROM e o JOIN e l ON l.level = 2 AND l.m = o.m AND l.lang IS NOT DISTINCT FROM o.lang JOIN e a ON a.level = 3 AND a.m = o.m WHERE o.level = 1),
f AS (SELECT v.rid, bool_or(coalesce(v.v > t.high, false) OR coalesce(v.v < t.low, false)) AS over FROM v LEFT JOIN t ON t.m = v.m AND t.lang IS NOT DISTINCT FROM v.lang AND t.source IS NOT DISTINCT FROM v.source GROUP BY v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM x JOIN f ON x.rid = f.rid"""

OP8_SQL = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT rid, i, a[i] AS line, translate(trim(a[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) r),
c AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
k AS (SELECT l.rid, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256 FROM l LEFT JOIN c ON l.key = c.key GROUP BY l.rid)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN k ON d.rid = k.rid"""


def oracle_sql() -> dict[str, str]:
    """The others hash by XXH64, learn, lex or search, which SQL can't express; tests hold them against brute force."""
    return {"op2_quality_rules": OP2_SQL, "op8_line_dedup": OP8_SQL}
