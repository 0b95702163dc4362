"""The engine's operators over the driver's tables, each beside SQL that says the same.

Lines of `documents` stand in for blocks of a card, `source` for identities, order dates for printed dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.dates import extract_date
from ..functions.fields import address_of, label_block, name_of, near_stopword, normalized_lines
from ..functions.text import character_error_rate, compact_text, normalize_text, normalized_edit_distance, tokens, word_error_rate
from ..functions.vocabulary import ADDRESS_KEYWORDS, STOPWORDS
from ..operators import blocks as B
from ..operators import corpus, features, rules, score, split, stagelog
from ..sources import ingest, sinks
from .registry import compact, norm, query

LINES = """lines AS (SELECT doc_id, source, lang, i - 1 AS block_idx, a[i] AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS a FROM documents) s, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) r),
blocks AS (SELECT *, 0.0::DOUBLE AS x0, (6 * length(text))::DOUBLE AS x1, (block_idx * 12 + (block_idx // 5) * 40)::DOUBLE AS y0, (block_idx * 12 + (block_idx // 5) * 40)::DOUBLE + 10.0 AS y1 FROM lines)"""
CARD = ("doc_id",)


def _blocks(t) -> DataFrame:
    return B.line_blocks(t("documents"), extra=("source", "lang"))


@query(f"""WITH {LINES}, k AS (SELECT DISTINCT source, {compact('text')} AS text_key FROM blocks WHERE trim(text) <> '')
SELECT text_key, round(count(*) / (SELECT count(DISTINCT source) FROM documents)::DOUBLE, 9) AS freq FROM k GROUP BY text_key""")
def boilerplate_frequency(t):
    docs = t("documents")
    return corpus.boilerplate_frequency(_blocks(t), docs, ["source"]).withColumn("freq", F.round("freq", 9))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id")
def unlabeled_listing(t):
    files = t("documents").select(F.col("doc_id").alias("filename"))
    return ingest.unlabeled(files, t("labels").select(F.col("doc_id").alias("filename"))).withColumnRenamed("filename", "doc_id")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_ground_truth FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def ground_truth_flag(t):
    files = t("documents").select(F.col("doc_id").alias("filename"))
    return ingest.with_ground_truth_flag(files, t("labels").select(F.col("doc_id").alias("filename"))).withColumnRenamed("filename", "doc_id")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def labeled_by_source(t):
    return t("documents").join(t("labels"), "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(l.k, r.k, c.k) AS filename, l.status AS load_status, r.status AS resize_status, c.status AS contrast_status,
CASE WHEN coalesce(l.status, 'missing') = 'ok' AND coalesce(r.status, 'missing') = 'ok' AND coalesce(c.status, 'missing') = 'ok' THEN 'ok' ELSE 'failed' END AS pipeline_status
FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'ok' ELSE 'failed' END AS status FROM customer) l
FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN 'ok' ELSE 'failed' END AS status FROM supplier) r ON l.k = r.k
FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN 'ok' ELSE 'failed' END AS status FROM part) c ON coalesce(l.k, r.k) = c.k""")
def stage_log_merge(t):
    log = lambda name, key, ok: t(name).select(F.col(key).alias("filename"), F.when(ok, "ok").otherwise("failed").alias("status"), F.lit("").alias("reason"))
    out = stagelog.consolidate(log("customer", "c_custkey", F.col("c_acctbal") > 0), log("supplier", "s_suppkey", F.col("s_acctbal") > 0), log("part", "p_partkey", F.col("p_size") > 10))
    return out.drop("load_reason", "resize_reason", "contrast_reason")


@query(f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, block_idx) - 1 AS rank, greatest(count(*) OVER (PARTITION BY doc_id) - 1, 1) AS last_rank,
row_number() OVER (PARTITION BY doc_id ORDER BY length(text), block_idx) - 1 AS lr FROM blocks)
SELECT doc_id, block_idx, rank, round(rank / last_rank::DOUBLE, 9) AS rank_from_top_frac, round(1 - rank / last_rank::DOUBLE, 9) AS rank_from_bottom_frac, round(lr / last_rank::DOUBLE, 9) AS length_rank_on_card FROM r""")
def rank_features(t):
    out = features.rank_features(_blocks(t), CARD)
    return out.select("doc_id", "block_idx", "rank", *[F.round(c, 9).alias(c) for c in ("rank_from_top_frac", "rank_from_bottom_frac", "length_rank_on_card")])


@query(f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, block_idx) - 1 AS rank, greatest(count(*) OVER (PARTITION BY doc_id) - 1, 1) AS last_rank FROM blocks),
a AS (SELECT doc_id, rank AS at FROM r WHERE regexp_matches(text, '[0-9]'))
SELECT r.doc_id, r.block_idx, round(coalesce(min(abs(r.rank - a.at)) / max(r.last_rank)::DOUBLE, 1.0), 9) AS dist FROM r LEFT JOIN a ON r.doc_id = a.doc_id GROUP BY r.doc_id, r.block_idx""")
def anchor_distance(t):
    marked = features.rank_features(_blocks(t), CARD).withColumn("anchor", F.col("text").rlike("[0-9]").cast("int"))
    out = features.anchor_distance(marked, "anchor", CARD)
    return out.select("doc_id", "block_idx", F.round("date_anchor_rank_dist", 9).alias("dist"))


@query(f"""WITH {LINES}, c AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM blocks),
m AS (SELECT *, median(cx) OVER (PARTITION BY doc_id) AS mx, median(cy) OVER (PARTITION BY doc_id) AS my FROM c),
d AS (SELECT *, median(abs(cx - mx)) OVER (PARTITION BY doc_id) AS dx, median(abs(cy - my)) OVER (PARTITION BY doc_id) AS dy FROM m)
SELECT doc_id, block_idx, abs(cx - mx) <= 4 * coalesce(nullif(dx, 0), 1) AND abs(cy - my) <= 4 * coalesce(nullif(dy, 0), 1) AS inlier FROM d""")
def robust_inliers(t):
    b = _blocks(t).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    return features.inliers(b, card=CARD).select("doc_id", "block_idx", "inlier")


SCORED = f"""{LINES}, s AS (SELECT *, CASE WHEN length(text) > 60 THEN 1.0 ELSE length(text) / 60.0 END AS score, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, block_idx) = 1 AS seed FROM blocks)"""


def _scored(t) -> DataFrame:
    b = _blocks(t).withColumn("score", F.least(F.length("text") / 60, F.lit(1.0)))
    return b.withColumn("seed", rules.argmax_flag(F.length("text"), CARD))


@query(f"""WITH {SCORED}, ok AS (SELECT *, max(y1) OVER (PARTITION BY doc_id ORDER BY y0, block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE seed OR score >= 0.15),
g AS (SELECT *, sum(CASE WHEN y0 - reach > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, block_idx) AS island FROM ok)
SELECT g.doc_id, g.block_idx FROM g JOIN (SELECT doc_id, island FROM g WHERE seed) z ON g.doc_id = z.doc_id AND g.island = z.island""")
def interval_islands(t):
    return rules.seed_island(_scored(t), "seed", "score", F.lit(15.0), card=CARD).filter("in_island").select("doc_id", "block_idx")


@query(f"""WITH {SCORED}, z AS (SELECT doc_id, y0 AS lo, y1 AS hi FROM s WHERE seed),
g AS (SELECT s.doc_id, s.block_idx, s.text, greatest(0.0, s.y0 - hi, lo - s.y1) AS gap FROM s JOIN z ON s.doc_id = z.doc_id WHERE NOT s.seed),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, block_idx DESC) AS k FROM g)
SELECT doc_id, block_idx FROM n WHERE k = 1 AND gap <= 20 AND len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) <= 3""")
def name_continuations(t):
    return rules.name_continuation(_scored(t), "seed", F.lit(20.0), card=CARD).filter("continues").select("doc_id", "block_idx")


GRAMS = f"""{LINES}, q AS (SELECT b.doc_id, block_idx, {compact('text')} AS s, CASE WHEN quality = 1 THEN 'name' ELSE 'other' END AS label FROM blocks b JOIN labels l ON b.doc_id = l.doc_id),
g AS (SELECT doc_id, block_idx, label, substr(s, i, 3) AS gram FROM q, LATERAL (SELECT unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i) r WHERE s <> ''),
c AS (SELECT gram, count(*) FILTER (WHERE label = 'name') AS p, count(*) FILTER (WHERE label = 'other') AS n FROM g GROUP BY gram),
m AS (SELECT gram, ln(((p + 1.0) / (tp + v)) / ((n + 1.0) / (tn + v))) AS llr FROM c, (SELECT sum(p) AS tp, sum(n) AS tn, count(*) AS v FROM c) t)"""


def _labeled(t) -> DataFrame:
    return _blocks(t).join(t("labels"), "doc_id").withColumn("label", F.when(F.col("quality") == 1, "name").otherwise("other"))


@query(f"WITH {GRAMS} SELECT gram, round(llr, 7) AS llr FROM m")
def ngram_log_ratios(t):
    return corpus.ngram_model(_labeled(t)).withColumn("llr", F.round("llr", 7))


@query(f"""WITH {GRAMS} SELECT q.doc_id, q.block_idx, round(coalesce(avg(coalesce(m.llr, 0)), 0), 6) AS ngram_score FROM q LEFT JOIN g ON q.doc_id = g.doc_id AND q.block_idx = g.block_idx LEFT JOIN m ON g.gram = m.gram GROUP BY q.doc_id, q.block_idx""")
def ngram_scores(t):
    rows = _labeled(t)
    return corpus.ngram_score(rows, corpus.ngram_model(rows), ["doc_id", "block_idx"]).withColumn("ngram_score", F.round("ngram_score", 6))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS dotted, strftime(o_orderdate, '%Y-%m-%d') AS worded, strftime(o_orderdate, '%Y-%m-%d') AS id_number FROM orders""")
def date_extraction(t):
    o = t("orders")
    as_text = lambda pattern: F.date_format("o_orderdate", pattern)
    forms = {
        "iso": F.concat(F.lit("DATE OF BIRTH\n"), as_text("yyyy-MM-dd")),
        "dotted": F.concat(F.lit("4b. "), as_text("dd.MM.yyyy"), F.lit(" CITY")),
        "worded": F.concat(F.lit("born "), as_text("d"), F.lit(" "), F.upper(as_text("MMM")), F.lit(" "), as_text("yyyy")),
        "id_number": F.concat(as_text("yyMMdd"), F.lit("-10-1234")),
    }
    return o.select("o_orderkey", *[extract_date(c, 2026).alias(k) for k, c in forms.items()])


@query(f"""SELECT p_brand, count(*) AS n, round(avg(levenshtein({norm('p_name')}, {norm('p_type')}) / greatest(length({norm('p_name')}), 1)::DOUBLE), 6) AS cer,
round(avg(levenshtein({compact('p_name')}, {compact('p_type')}) / greatest(length({compact('p_name')}), 1)::DOUBLE), 6) AS distance FROM part GROUP BY p_brand""")
def error_rates(t):
    rows = t("part").select("p_brand", character_error_rate("p_name", "p_type").alias("c"), normalized_edit_distance("p_name", "p_type").alias("d"))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("cer"), F.round(F.avg("d"), 6).alias("distance"))


WORDS = """w AS (SELECT *, list_distinct(list_concat(e, p)) AS v FROM s), z AS (SELECT *, array_to_string(list_transform(e, lambda x: chr(32 + list_position(v, x)::INTEGER)), '') AS es, array_to_string(list_transform(p, lambda x: chr(32 + list_position(v, x)::INTEGER)), '') AS ps FROM w)"""
WORD_RATE = "CASE WHEN len(e) = 0 THEN CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END ELSE levenshtein(es, ps) / len(e)::DOUBLE END"


def words(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda x: x <> '')"


@query(f"WITH s AS (SELECT p_brand, {words('p_name')} AS e, {words('p_type')} AS p FROM part), {WORDS} SELECT p_brand, round(avg({WORD_RATE}), 6) AS wer FROM z GROUP BY p_brand")
def word_error_rates(t):
    """Words stand as single characters in the SQL, one for each distinct word of a pair."""
    return t("part").groupBy("p_brand").agg(F.round(F.avg(word_error_rate("p_name", "p_type")), 6).alias("wer"))


@query(f"SELECT conv_id, turn, {norm('text')} AS normalized, {compact('text')} AS compact FROM conversations")
def normalized_turns(t):
    return t("conversations").select("conv_id", "turn", normalize_text("text").alias("normalized"), compact_text("text").alias("compact"))


@query(f"SELECT doc_id, len(list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: x <> ''))) AS n_tokens FROM documents")
def distinct_tokens(t):
    return t("documents").select("doc_id", F.size(tokens("text")).cast("long").alias("n_tokens"))


STOP = ", ".join(f"'{s}'" for s in STOPWORDS)
STOP_COMPACT = ", ".join(f"'{''.join(c for c in s if c.isalnum())}'" for s in STOPWORDS if len("".join(c for c in s if c.isalnum())) >= 4)


@query(f"""WITH {LINES}, w AS (SELECT doc_id, block_idx, unnest(string_split(text, ' ')) AS word FROM blocks), k AS (SELECT doc_id, block_idx, {norm('word')} AS n, {compact('word')} AS c FROM w)
SELECT c AS word, count(*) AS n FROM k WHERE n IN ({STOP}) OR (length(c) >= 4 AND EXISTS (SELECT 1 FROM (SELECT unnest([{STOP_COMPACT}]) AS s) z WHERE abs(length(s) - length(c)) <= 1 AND levenshtein(c, s) <= 1)) GROUP BY c""")
def fuzzy_stopwords(t):
    words = _blocks(t).select(F.explode(F.split("text", " ")).alias("word"))
    kinds = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # each word is judged once; as results of an aggregate its forms are computed once, too, and not put into the filter in their place
    kinds = kinds.groupBy("word").agg(F.max(normalize_text("word")).alias("norm"), F.max(compact_text("word")).alias("compact"), F.max("n").alias("n"))
    return kinds.filter(F.col("norm").isin(*STOPWORDS) | near_stopword("compact")).groupBy(F.col("compact").alias("word")).agg(F.sum("n").alias("n"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, block_idx, {norm('text')} AS line FROM blocks),
nm AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, block_idx) AS k FROM n WHERE line <> '' AND NOT regexp_matches(line, '\\p{{Nd}}') AND line NOT IN ({STOP})),
ad AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, block_idx) AS k FROM n WHERE line <> '' AND (regexp_matches(line, '{"|".join(ADDRESS_KEYWORDS)}') OR regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])\\d{{4,5}}($|[^\\p{{L}}\\p{{N}}_])')))
SELECT d.doc_id, coalesce(nm.line, '') AS name, coalesce(ad.line, '') AS address FROM documents d LEFT JOIN nm ON d.doc_id = nm.doc_id AND nm.k = 1 LEFT JOIN ad ON d.doc_id = ad.doc_id AND ad.k = 1""")
def field_heuristics(t):
    norm = t("documents").select("doc_id", normalized_lines("text").alias("norm"))  # normalised once for both
    return norm.select("doc_id", name_of(F.col("norm")).alias("name"), address_of(F.col("norm")).alias("address"))


@query(f"""WITH w AS (SELECT p_partkey, list_distinct(string_split({norm('p_name')}, ' ')) AS own, list_distinct(string_split({norm('p_type')}, ' ')) AS a, list_distinct(string_split({norm("p_name || ' ' || p_brand")}, ' ')) AS b FROM part),
s AS (SELECT p_partkey, len(own) AS n, len(list_intersect(own, a)) / len(own)::DOUBLE AS x, len(list_intersect(own, b)) / len(own)::DOUBLE AS y FROM w)
SELECT p_partkey, CASE WHEN n < 2 THEN 'other' WHEN x >= 0.6 AND x >= y THEN 'name' WHEN y >= 0.6 THEN 'address' ELSE 'other' END AS label FROM s""")
def weak_labels(t):
    p = t("part")
    return p.select("p_partkey", label_block("p_name", "p_type", F.lit(""), F.concat_ws(" ", "p_name", "p_brand")).alias("label"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1""")
def latest_per_group(t):
    e = t("events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return score.latest(e, ["user_id", "event_type"], "at").drop("at")


@query("""SELECT user_id, arg_max(value, struct_pack(ts := ts, e := event_id)) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS before, arg_max(value, struct_pack(ts := ts, e := event_id)) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS after FROM events GROUP BY user_id""")
def before_and_after(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id"))
    return score.before_after(e, ["user_id"], "at", F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "value")


@query("""SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE y = 1992), 2) AS "1992", round(sum(o_totalprice) FILTER (WHERE y = 1993), 2) AS "1993", round(sum(o_totalprice) FILTER (WHERE y = 1994), 2) AS "1994", round(sum(o_totalprice) FILTER (WHERE y = 1995), 2) AS "1995" FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY o_orderstatus""")
def pivoted_totals(t):
    sums = t("orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return score.pivot_table(sums, ["o_orderstatus"], "y", ["total"], [1992, 1993, 1994, 1995])


@query("SELECT p_partkey, CASE WHEN p_retailprice <= (SELECT quantile_cont(p_retailprice, 0.5) FROM part) THEN 'small' ELSE 'large' END AS bin FROM part")
def quantile_halves(t):
    return stagelog.halves(t("part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "bin")


@query("""(SELECT p_partkey, p_retailprice, 'low' AS side FROM part ORDER BY p_retailprice, p_partkey LIMIT 4) UNION ALL (SELECT p_partkey, p_retailprice, 'high' AS side FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 4)""")
def top_and_bottom(t):
    return score.top_bottom(t("part").select("p_partkey", "p_retailprice"), "p_retailprice", 4, "p_partkey")


DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS q25, round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS q50, round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS q75, round(max({c})::DOUBLE, 4) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)


@query(DESCRIBE)
def described(t):
    out = stagelog.describe(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("""WITH e AS (SELECT min(n_chars) AS lo, (max(n_chars) - min(n_chars)) / 30.0 AS w FROM documents) SELECT least(floor((n_chars - lo) / w) + 1, 30)::INTEGER AS bin, count(*) AS n FROM documents, e GROUP BY 1""")
def length_histogram(t):
    return stagelog.histogram(t("documents"), "n_chars").select("bin", "n")


@query("SELECT source, round(avg(n_chars), 4) AS mean_chars, count_if(lang = 'en')::BIGINT AS english, count(DISTINCT lang) AS languages FROM documents GROUP BY source")
def source_means(t):
    return stagelog.means(t("documents"), ["source"], {"mean_chars": "n_chars"}, {"english": F.col("lang") == "en"}, {"languages": "lang"}).withColumn("mean_chars", F.round("mean_chars", 4))


RECORDS = "records AS (SELECT o_orderkey::VARCHAR AS filename, 'C' || o_custkey AS name, CASE WHEN o_orderstatus = 'P' THEN year(o_orderdate)::VARCHAR WHEN o_orderstatus = 'F' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS birth_date, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE '' END AS address FROM orders)"


def _records(t) -> DataFrame:
    o = t("orders")
    date = F.when(F.col("o_orderstatus") == "P", F.year("o_orderdate").cast("string")).when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").cast("string").alias("filename"), F.concat(F.lit("C"), "o_custkey").alias("name"), date.alias("birth_date"), F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise("").alias("address"))


@query(f"WITH {RECORDS} SELECT count(*) AS rows, count(filename) - count(DISTINCT filename) AS duplicate_filenames, count_if(name = '')::BIGINT AS empty_name, count_if(birth_date = '')::BIGINT AS empty_birth_date, count_if(address = '')::BIGINT AS empty_address, count_if(birth_date <> '' AND NOT regexp_matches(birth_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'))::BIGINT AS odd_dates FROM records")
def record_audit(t):
    return ingest.audit(_records(t))


@query(f"WITH {RECORDS} SELECT filename, birth_date FROM records WHERE birth_date <> '' AND NOT regexp_matches(birth_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')")
def nonstandard_dates(t):
    return ingest.odd_dates(_records(t)).select("filename", "birth_date")


@query("""WITH s AS (SELECT p_partkey, p_size * 97 AS w, (p_partkey * 37) % 3000 + 1 AS h FROM part), f AS (SELECT *, least(1.0::DOUBLE, 1800.0::DOUBLE / greatest(w, h)) AS k FROM s)
SELECT p_partkey, greatest(round_even(w * k, 0), 1)::INTEGER AS width, greatest(round_even(h * k, 0), 1)::INTEGER AS height, greatest(w, h) > 1800 AS downscaled, greatest(w, h) < 300 AS very_low_res FROM f""")
def resize_arithmetic(t):
    s = stagelog.resized(F.col("p_size") * 97, ((F.col("p_partkey") * 37) % 3000 + 1).cast("int"))
    return t("part").select("p_partkey", s.alias("s")).select("p_partkey", "s.width", "s.height", "s.downscaled", "s.very_low_res")


@query("SELECT c_name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier) EXCEPT SELECT s_name FROM supplier")
def set_operations(t):
    both = t("customer").select("c_custkey").intersect(t("supplier").select("s_suppkey"))
    return t("customer").join(both, "c_custkey", "left_semi").select("c_name").exceptAll(t("supplier").select("s_name"))


@query("SELECT lang, row_number() OVER (ORDER BY min(doc_id)) AS position FROM documents GROUP BY lang")
def ordered_distinct(t):
    keys = stagelog.ordered_distinct(t("documents"), "lang", "doc_id")
    return keys.select("lang", F.row_number().over(W.orderBy("first_at")).cast("long").alias("position"))  # a row a key, few by now


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM r WHERE k = 1")
def keep_first_copy(t):
    return stagelog.keep_first(t("documents").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("text")), "text", "doc_id").select("doc_id")


@query(f"WITH {RECORDS}, i AS (SELECT CASE WHEN address <> '' THEN 'train' ELSE 'val' END AS split, name, birth_date, count(*) AS n, count_if(address <> '') AS a FROM records GROUP BY ALL) SELECT split, sum(n)::BIGINT AS rows, count(*) AS identities, max(n) AS max_rows, sum(a)::BIGINT AS address_rows FROM i GROUP BY split")
def split_summary(t):
    return sinks.split_summary(_records(t).withColumn("split", F.when(F.col("address") != "", "train").otherwise("val")))


SPLIT = f"""WITH RECURSIVE {RECORDS}, i AS (SELECT concat_ws(chr(31), name, birth_date) AS id, count(*) AS n, bool_or(address <> '') AS has FROM records GROUP BY 1),
k AS (SELECT *, md5(concat_ws(chr(31), id, '42')) AS key FROM i), r AS (SELECT *, has AND row_number() OVER (PARTITION BY has ORDER BY key, id) <= 15 AS reserved FROM k),
f AS (SELECT *, reserved OR n > 2 AS fixed FROM r), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, key, id) AS pos FROM f WHERE NOT fixed), t AS (SELECT sum(n)::DOUBLE AS total, coalesce(sum(n) FILTER (WHERE fixed), 0)::BIGINT AS held, count_if(fixed)::BIGINT AS ids, coalesce(max(n) FILTER (WHERE fixed), 0) AS top FROM f),
g AS (SELECT 0::BIGINT AS pos, held AS a, 0::BIGINT AS b, 0::BIGINT AS c, ids AS ka, 0::BIGINT AS kb, 0::BIGINT AS kc, top AS ma, 0::BIGINT AS mb, 0::BIGINT AS mc, total FROM t
UNION ALL SELECT pos, CASE s WHEN 0 THEN a + n ELSE a END, CASE s WHEN 1 THEN b + n ELSE b END, CASE s WHEN 2 THEN c + n ELSE c END, CASE s WHEN 0 THEN ka + 1 ELSE ka END, CASE s WHEN 1 THEN kb + 1 ELSE kb END, CASE s WHEN 2 THEN kc + 1 ELSE kc END,
CASE s WHEN 0 THEN greatest(ma, n) ELSE ma END, CASE s WHEN 1 THEN greatest(mb, n) ELSE mb END, CASE s WHEN 2 THEN greatest(mc, n) ELSE mc END, total
FROM (SELECT o.pos, o.n, g.* EXCLUDE (pos), CASE WHEN a - 0.8 * total <= b - 0.1 * total AND a - 0.8 * total <= c - 0.1 * total THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS s FROM g JOIN o ON o.pos = g.pos + 1) z)
SELECT unnest(['train', 'val', 'test']) AS split, unnest([a, b, c]) AS rows, unnest([ka, kb, kc]) AS identities, unnest([ma, mb, mc]) AS max_rows FROM g WHERE g.pos = (SELECT max(pos) FROM g)"""


@query(SPLIT)
def identity_split(t):
    """Rows and identities per split. The SQL gives one identity after the other to the split that lacks most; disjointness and caps are tested."""
    return sinks.split_summary(split.group_split(_records(t))).drop("address_rows")


@query(f"""WITH w AS (SELECT p_partkey, p_name, string_split(p_type, ' ') AS a FROM part), b AS (SELECT p_partkey, p_name, i, a[i] AS one, concat_ws(' ', a[i], CASE WHEN i < len(a) THEN a[i + 1] END) AS two FROM w, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) r),
s AS (SELECT p_partkey, least(levenshtein({norm('p_name')}, {norm('one')}), levenshtein({norm('p_name')}, {norm('two')})) / greatest(length({norm('p_name')}), 1)::DOUBLE AS c FROM b) SELECT p_partkey, round(min(c), 9) AS best FROM s GROUP BY p_partkey""")
def best_block_runs(t):
    b = t("part").select("p_partkey", "p_name", F.posexplode(F.split("p_type", " ")).alias("block_idx", "text"))
    return B.best_runs(b, F.col("p_name"), character_error_rate, 2, ("p_partkey",)).withColumn("best", F.round("best", 9))


@query(f"""WITH b AS (SELECT doc_id, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')) AS have, list_distinct(list_filter(string_split({norm('source || chr(32) || lang')}, ' '), lambda x: x <> '')) AS want FROM documents) SELECT doc_id, round(len(list_intersect(want, have)) / len(want)::DOUBLE, 9) AS covered FROM b""")
def field_recoverability(t):
    b = _blocks(t).withColumn("want", F.concat_ws(" ", "source", "lang"))
    return B.coverage(b, tokens, F.col("want"), CARD).withColumn("covered", F.round("covered", 9))


@query("""SELECT p_mfgr AS kind, value AS value, votes FROM (SELECT p_mfgr, value, votes, row_number() OVER (PARTITION BY p_mfgr ORDER BY votes DESC, value) AS k FROM (SELECT p_size AS p_mfgr, p_brand AS value, count(*) AS votes FROM part GROUP BY p_size, p_brand)) WHERE k = 1""")
def majority_vote(t):
    return rules.vote(t("part").select(F.col("p_size").alias("kind"), F.col("p_brand").alias("value")), ["kind"], "value")


@query(f"""WITH r AS (SELECT c_mktsegment AS method, 'name' AS field, c_name AS expected, n_name AS predicted FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_mktsegment, 'address', n_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT method, field, {norm('expected')} AS e, {norm('predicted')} AS p FROM r)
SELECT method, field, count(*) AS n, round(count_if(e = p) / count(*)::DOUBLE, 6) AS exact_accuracy, round(avg(levenshtein(e, p) / greatest(length(e), 1)::DOUBLE), 6) AS character_error_rate FROM s GROUP BY method, field""")
def field_scores(t):
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = both.select(F.col("c_mktsegment").alias("method"), F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("expected"), F.col("n_name").alias("predicted")), F.struct(F.lit("address").alias("field"), F.col("n_name").alias("expected"), F.col("n_name").alias("predicted")))).alias("r")).select("method", "r.*")
    out = score.field_metrics(rows, ["method"])
    return out.select("method", "field", "n", F.round("exact_accuracy", 6).alias("exact_accuracy"), F.round("character_error_rate", 6).alias("character_error_rate"))


@query()
def rule_layer(t):
    """The whole rule layer over documents as cards; probabilities come from line shapes. Held against a plain model in tests."""
    b = _blocks(t).withColumns({"engine": F.lit("text"), "split": F.col("lang"), "filename": F.col("doc_id").cast("string"), "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "height": F.lit(400)})
    size = F.length("text")
    b = b.withColumns({"p_name": F.when(size < 120, size / 120).otherwise(0.1), "p_birth_date": (extract_date("text", 2026) != "").cast("double"), "p_address": F.least(size / 400, F.lit(1.0))})
    cards = t("documents").select(F.lit("text").alias("engine"), F.col("lang").alias("split"), F.col("doc_id").cast("string").alias("filename"))
    freq = corpus.boilerplate_frequency(_blocks(t), t("documents"), ["source"])
    return rules.predict_geometric(b, cards, freq, as_of_year=2026)
