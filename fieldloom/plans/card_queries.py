"""The layout operators over cards made from orders, each beside SQL that says the same.

Each order is a card of seven blocks: a heading, a name, a line after it, a date, two address lines, a last line. Places, sizes and
probabilities follow from the order's number, so that both sides can compute them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import ends_with_name_particle, has_name_particle, is_id_fragment, parse_fields, starts_with_name_particle
from ..functions.dates import extract_date
from ..functions.text import normalized_equal, title_case
from ..functions.vocabulary import ADDRESS_KEYWORDS, NAME_PARTICLES
from ..operators import blocks as B
from ..operators import corpus, features, rules, score
from ..operators.features import FEATURES
from . import pipelines
from .queries import STOP, STOP_COMPACT, WORD_RATE, WORDS, words
from .registry import compact, norm, query

YEAR = 2026
LETTERS = ("0123456789", "ABCDEFGHIJ")


def letters(c: Column) -> Column:
    return F.translate(c.cast("string"), *LETTERS)


def _texts(k: Column, date: Column) -> list[Column]:
    return [
        F.when(k % 9 == 0, "IDENTTY CARD").otherwise("IDENTITY CARD"),
        F.when(k % 6 == 0, F.concat(F.lit("NUR "), letters(k), F.lit(" BINTI"))).otherwise(F.concat(F.lit("AHMAD "), letters(k))),
        F.concat(F.when(k % 10 == 3, "BIN ").otherwise(""), F.lit("OMAR "), letters(k % 97)),
        F.when(k % 5 == 0, "no date").when(k % 5 == 1, F.date_format(date, "yyyy-MM-dd")).otherwise(F.date_format(date, "dd.MM.yyyy")),
        F.concat(F.lit("No "), (k % 50).cast("string"), F.lit(", Jalan "), letters(k)),
        F.when(k % 5 == 2, "50000 Taman SAMA").otherwise(F.concat(F.lpad(((k * 7) % 100000).cast("string"), 5, "0"), F.lit(" Taman "), letters(k % 13))),
        F.when(k % 4 == 0, F.concat(F.lit("123456"), k.cast("string"))).otherwise("Republic"),
    ]


def reports(t, engine: str = "main", only: tuple[int, ...] = tuple(range(7)), shift: float = 0.0) -> DataFrame:
    """As read_reports gives them, with a split."""
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    texts = _texts(k, date)
    if engine != "main":
        texts[3] = F.date_format(date, "yyyy/MM/dd")
    slot = lambda i: F.when(k % 3 != 0, i).otherwise(6 - i)
    away = (k % 8 == 0).cast("int")

    def block(i: int) -> Column:
        x0 = (10 + (k % 7) * 3 + i + (3000 * away if i == 6 else 0)).cast("double")
        y0 = (20 + 30 * slot(i) + k % 5 + (2000 * away if i == 6 else 0)).cast("double") + shift
        x1, y1 = x0 + 8 * F.length(texts[i]), y0 + 20
        box = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
        return F.struct(texts[i].alias("text"), box.alias("bbox"), (0.5 + (k % 50) / 100).alias("confidence"))

    name = F.when(k % 6 == 0, F.concat_ws(" ", texts[1], texts[2])).otherwise(texts[1])
    expected = F.struct(name.alias("name"), F.when(k % 5 == 0, "").otherwise(F.date_format(date, "yyyy-MM-dd")).alias("birth_date"), F.concat_ws(", ", texts[4], texts[5]).alias("address"))
    raw = F.struct(F.concat_ws("\n", *[texts[i] for i in only]).alias("full"), F.array(*[block(i) for i in only]).alias("blocks"))
    split = F.when(k % 10 < 8, "train").when(k % 10 == 8, "val").otherwise("test")
    return t("orders").select(F.lit(engine).alias("engine"), F.concat(k.cast("string"), F.lit(".jpg")).alias("filename"), expected.alias("expected"), raw.alias("raw"), split.alias("split"), "o_custkey")


def sizes(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select(F.concat(k.cast("string"), F.lit(".jpg")).alias("filename"), (600 + k % 100).cast("int").alias("width"), F.lit(400).alias("height"), F.when(k % 11 != 0, 500.0).alias("face_x"), (100 + k % 50).cast("double").alias("face_y"))


_L = lambda c: f"translate(({c})::VARCHAR, '0123456789', 'ABCDEFGHIJ')"
CARDS = f"""o AS (SELECT o_orderkey AS k, o_custkey, o_orderdate AS d, o_orderkey || '.jpg' AS filename, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM orders),
ts AS (SELECT *, [CASE WHEN k % 9 = 0 THEN 'IDENTTY CARD' ELSE 'IDENTITY CARD' END, CASE WHEN k % 6 = 0 THEN 'NUR ' || {_L('k')} || ' BINTI' ELSE 'AHMAD ' || {_L('k')} END, CASE WHEN k % 10 = 3 THEN 'BIN ' ELSE '' END || 'OMAR ' || {_L('k % 97')},
CASE k % 5 WHEN 0 THEN 'no date' WHEN 1 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%d.%m.%Y') END, 'No ' || (k % 50) || ', Jalan ' || {_L('k')}, CASE WHEN k % 5 = 2 THEN '50000 Taman SAMA' ELSE lpad(((k * 7) % 100000)::VARCHAR, 5, '0') || ' Taman ' || {_L('k % 13')} END, CASE WHEN k % 4 = 0 THEN '123456' || k ELSE 'Republic' END] AS a FROM o),
b0 AS (SELECT *, i - 1 AS block_idx, a[i] AS text FROM ts, (SELECT unnest(range(1, 8)) AS i) r),
b1 AS (SELECT *, (10 + (k % 7) * 3 + block_idx + CASE WHEN block_idx = 6 AND k % 8 = 0 THEN 3000 ELSE 0 END)::DOUBLE AS x0, (20 + 30 * CASE WHEN k % 3 <> 0 THEN block_idx ELSE 6 - block_idx END + k % 5 + CASE WHEN block_idx = 6 AND k % 8 = 0 THEN 2000 ELSE 0 END)::DOUBLE AS y0, 0.5 + (k % 50) / 100.0::DOUBLE AS confidence FROM b0),
b AS (SELECT *, x0 + 8 * length(text) AS x1, y0 + 20 AS y1, x0 + 4 * length(text) AS cx, y0 + 10 AS cy FROM b1),
e AS (SELECT k, filename, split, CASE WHEN k % 6 = 0 THEN a[2] || ' ' || a[3] ELSE a[2] END AS name, CASE WHEN k % 5 = 0 THEN '' ELSE strftime(d, '%Y-%m-%d') END AS birth_date, a[5] || ', ' || a[6] AS address FROM ts)"""


@query(f"WITH {CARDS} SELECT filename, block_idx, text, confidence, x0, x1, y0, y1, cx, cy FROM b")
def report_blocks(t):
    return B.report_blocks(reports(t)).select("filename", F.col("block_idx").cast("long").alias("block_idx"), "text", "confidence", "x0", "x1", "y0", "y1", "cx", "cy")


@query(f"""WITH {CARDS}, m AS (SELECT filename, text, y0, x0, 0 AS s, block_idx FROM b UNION ALL SELECT filename, strftime(d, '%Y/%m/%d'), y0 + 1, x0, 1, 0 FROM b WHERE block_idx = 3)
SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY y0, x0, s, block_idx) - 1 AS block_idx, text FROM m""")
def merged_reading_order(t):
    """Blocks of two engines for the first one's cards, in reading order."""
    out = B.merge_engines(B.report_blocks(reports(t)), B.report_blocks(reports(t, "second", (3,), 1.0)))
    return out.select("filename", F.col("block_idx").cast("long").alias("block_idx"), "text")


FREQ = f"""q AS (SELECT text_key, count(*) / (SELECT count(DISTINCT o_custkey) FROM orders)::DOUBLE AS freq FROM (SELECT DISTINCT o_custkey, {compact('text')} AS text_key FROM b WHERE trim(text) <> '') z GROUP BY text_key)"""
GRAM_MODEL = f"""lg AS (SELECT CASE WHEN block_idx = 1 THEN 'name' ELSE 'other' END AS label, {compact('text')} AS s FROM b WHERE block_idx IN (1, 6)), gr AS (SELECT label, substr(s, i, 3) AS gram FROM lg, LATERAL (SELECT unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i) r),
gc AS (SELECT gram, count(*) FILTER (WHERE label = 'name') AS p, count(*) FILTER (WHERE label = 'other') AS n FROM gr GROUP BY gram), gm AS (SELECT gram, ln(((p + 1.0) / (tp + v)) / ((n + 1.0) / (tn + v))) AS llr FROM gc, (SELECT sum(p) AS tp, sum(n) AS tn, count(*) AS v FROM gc) t),
bg AS (SELECT filename, block_idx, substr(s, i, 3) AS gram FROM (SELECT filename, block_idx, {compact('text')} AS s FROM b) z, LATERAL (SELECT unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i) r WHERE s <> ''),
gs AS (SELECT bg.filename, bg.block_idx, avg(coalesce(llr, 0)) AS ngram FROM bg LEFT JOIN gm ON bg.gram = gm.gram GROUP BY 1, 2)"""


def _frequency(t) -> DataFrame:
    ids = t("orders").select("o_custkey")
    return corpus.boilerplate_frequency(B.report_blocks(reports(t)).join(reports(t).select("filename", "o_custkey"), "filename"), ids, ["o_custkey"])


def _n(pattern: str) -> str:
    return f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))"


@query(f"""WITH {CARDS}, {FREQ}, {GRAM_MODEL},
r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY y0, block_idx) - 1 AS rank, row_number() OVER (PARTITION BY filename ORDER BY length(text), block_idx) - 1 AS lr, 600 + k % 100 AS w FROM b),
an AS (SELECT filename AS fa, rank AS at FROM r WHERE block_idx = 3 AND k % 5 <> 0)
SELECT r.filename, r.block_idx, round(y0 / 400, 6) AS y_frac, round(x0 / w, 6) AS x_frac, round(20 / 400.0::DOUBLE, 6) AS height_frac, round((x1 - x0) / w, 6) AS width_frac, round(rank / 6.0::DOUBLE, 6) AS rank_from_top_frac, round(1 - rank / 6.0::DOUBLE, 6) AS rank_from_bottom_frac,
length(text)::DOUBLE AS char_count, len(string_split(text, ' '))::DOUBLE AS token_count, round({_n('0-9')} / length(text)::DOUBLE, 6) AS digit_ratio, round({_n('A-Za-z')} / length(text)::DOUBLE, 6) AS alpha_ratio, round({_n('A-Z')} / greatest({_n('A-Za-z')}, 1)::DOUBLE, 6) AS upper_ratio,
confidence, (r.block_idx = 3 AND k % 5 <> 0)::INTEGER::DOUBLE AS has_date_regex, regexp_matches(upper(text), '{"|".join(ADDRESS_KEYWORDS)}')::INTEGER::DOUBLE AS has_address_keyword, regexp_matches(text, '(^|[^A-Za-z0-9_])[0-9]{{4,5}}($|[^A-Za-z0-9_])')::INTEGER::DOUBLE AS has_postcode_pattern,
(upper(text) IN ({STOP}))::INTEGER::DOUBLE AS has_header_stopword, round(lr / 6.0::DOUBLE, 6) AS length_rank_on_card, round(coalesce(q.freq, 0), 6) AS boilerplate_freq, round(coalesce(gs.ngram, 0), 5) AS name_char_ngram_score, round(coalesce(abs(rank - an.at) / 6.0::DOUBLE, 1.0), 6) AS date_anchor_rank_dist,
round(CASE WHEN k % 11 = 0 THEN 1.0 ELSE sqrt(((x0 + x1) / 2 - 500) ** 2 + ((y0 + y1) / 2 - (100 + k % 50)) ** 2) / sqrt((w * w + 160000)::DOUBLE) END, 6) AS dist_to_face_frac
FROM r LEFT JOIN an ON r.filename = fa LEFT JOIN q ON q.text_key = {compact('text')} LEFT JOIN gs ON gs.filename = r.filename AND gs.block_idx = r.block_idx""")
def block_features(t):
    """All 21 features."""
    blocks = B.report_blocks(reports(t))
    labeled = blocks.filter("block_idx in (1, 6)").withColumn("label", F.when(F.col("block_idx") == 1, "name").otherwise("other"))
    out = features.block_features(blocks, sizes(t), _frequency(t), corpus.ngram_model(labeled), use_face=True, as_of_year=YEAR)
    exact = {"char_count", "token_count", "confidence"}
    return out.select("filename", F.col("block_idx").cast("long").alias("block_idx"), *[F.col(c) if c in exact else F.round(c, 5 if c == "name_char_ngram_score" else 6).alias(c) for c in FEATURES])


LABEL = f"""lw AS (SELECT filename, block_idx, text, k, list_distinct({words('text')}) AS own, list_distinct({words('name')}) AS nm, list_distinct({words('address')}) AS ad FROM (SELECT b.*, e.name, e.address FROM b JOIN e ON b.filename = e.filename) z),
ls AS (SELECT *, len(own) AS n, len(list_intersect(own, nm)) / greatest(len(own), 1)::DOUBLE AS x, len(list_intersect(own, ad)) / greatest(len(own), 1)::DOUBLE AS y FROM lw)"""


@query(f"WITH {CARDS}, {LABEL} SELECT filename, block_idx, CASE WHEN block_idx = 3 AND k % 5 <> 0 THEN 'birth_date' WHEN n < 2 THEN 'other' WHEN x >= 0.6 AND x >= y THEN 'name' WHEN y >= 0.6 THEN 'address' ELSE 'other' END AS label FROM ls")
def training_table(t):
    """Blocks with features and weak labels, dates included."""
    out = pipelines.build_table(reports(t), sizes(t), as_of_year=YEAR)
    return out.select("filename", F.col("block_idx").cast("long").alias("block_idx"), "label")


P_NAME = "CASE block_idx WHEN 0 THEN 0.95 WHEN 1 THEN CASE WHEN k % 10 = 7 THEN 0.1 ELSE 0.9 END WHEN 2 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.05 END"
P_ADDRESS = "CASE block_idx WHEN 4 THEN CASE WHEN k % 12 = 5 THEN 0.1 ELSE 0.6 END WHEN 5 THEN CASE WHEN k % 12 = 5 THEN 0.12 ELSE 0.5 END WHEN 6 THEN 0.7 WHEN 2 THEN CASE WHEN k % 12 = 5 THEN 0.05 ELSE 0.2 END ELSE 0.05 END"
PROB = f"pb AS (SELECT *, ({P_NAME})::DOUBLE AS p_name, CASE WHEN block_idx = 3 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS p_date, ({P_ADDRESS})::DOUBLE AS p_address FROM b)"
DATE = "CASE WHEN k % 5 = 0 THEN '' ELSE strftime(d, '%Y-%m-%d') END"


def scored(t, engine: str = "main") -> DataFrame:
    k = F.regexp_extract("filename", r"^(\d+)", 1).cast("long")
    i = F.col("block_idx")
    p_name = F.when(i == 0, 0.95).when((i == 1) & (k % 10 == 7), 0.1).when(i == 1, 0.9).when(i == 2, 0.4).when(i == 4, 0.2).otherwise(0.05)
    low = k % 12 == 5
    p_address = F.when(i == 4, F.when(low, 0.1).otherwise(0.6)).when(i == 5, F.when(low, 0.12).otherwise(0.5)).when(i == 6, 0.7).when(i == 2, F.when(low, 0.05).otherwise(0.2)).otherwise(0.05)
    out = B.report_blocks(reports(t, engine))
    return out.withColumns({"p_name": p_name, "p_birth_date": F.when(i == 3, 0.8).otherwise(0.0), "p_address": p_address, "height": F.lit(400)})


@query(f"""WITH {CARDS}, {PROB}, n AS (SELECT filename, text, row_number() OVER (PARTITION BY filename ORDER BY p_name DESC, block_idx) AS r FROM pb), ad AS (SELECT filename, string_agg(text, ', ' ORDER BY block_idx) AS address FROM pb WHERE p_address >= 0.5 GROUP BY filename)
SELECT o.filename, {norm('n.text')} AS name, {DATE} AS birth_date, {norm("coalesce(ad.address, '')")} AS address FROM o JOIN n ON n.filename = o.filename AND r = 1 LEFT JOIN ad ON ad.filename = o.filename""")
def plain_fields(t):
    """The plain method: best name block, best date block, all blocks that look like an address."""
    cards = reports(t).select("engine", "split", "filename")
    return rules.predict_plain(scored(t), cards, as_of_year=YEAR).select("filename", "name", "birth_date", "address")


NEAR = f"(length({compact('text')}) >= 4 AND EXISTS (SELECT 1 FROM (SELECT unnest([{STOP_COMPACT}]) AS s) zz WHERE abs(length(s) - length({compact('text')})) <= 1 AND levenshtein({compact('text')}, s) <= 1))"
_PARTICLES = "|".join(NAME_PARTICLES)
GEO = f"""{PROB}, {FREQ}, hot AS (SELECT text_key FROM q WHERE freq >= 0.15 AND length(text_key) >= 4),
m1 AS (SELECT *, median(cx) OVER (PARTITION BY filename) AS mx, median(cy) OVER (PARTITION BY filename) AS my FROM pb), m2 AS (SELECT *, median(abs(cx - mx)) OVER (PARTITION BY filename) AS dx, median(abs(cy - my)) OVER (PARTITION BY filename) AS dy FROM m1),
m3 AS (SELECT *, abs(cx - mx) <= 4 * coalesce(nullif(dx, 0), 1) AND abs(cy - my) <= 4 * coalesce(nullif(dy, 0), 1) AS inlier, row_number() OVER (PARTITION BY filename ORDER BY y0, block_idx) = 1 AS is_top, {compact('text')} IN (SELECT text_key FROM hot) AS is_freq, ({norm('text')} IN ({STOP})) OR {NEAR} AS is_stop FROM m2),
m4 AS (SELECT *, CASE WHEN inlier AND NOT is_top AND NOT is_stop AND NOT is_freq THEN p_name END AS ns FROM m3), m5 AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ns DESC NULLS LAST, block_idx) = 1 AND ns IS NOT NULL AS is_name FROM m4),
sd AS (SELECT filename AS sf, y0 AS lo, y1 AS hi, regexp_matches(list_extract(string_split(trim(upper(text)), ' '), -1), '({_PARTICLES})$') AS open_ended FROM m5 WHERE is_name),
m6 AS (SELECT m5.*, open_ended, CASE WHEN NOT is_name THEN greatest(0.0, y0 - hi, lo - y1) END AS gap FROM m5 LEFT JOIN sd ON filename = sf),
m7 AS (SELECT *, coalesce(row_number() OVER (PARTITION BY filename ORDER BY gap NULLS LAST, block_idx DESC) = 1 AND gap <= 20 AND len(string_split(trim(text), ' ')) <= 3 AND open_ended, false) AS cont FROM m6),
m8 AS (SELECT *, CASE WHEN is_stop OR is_freq OR regexp_matches(string_split(trim(upper(text)), ' ')[1], '^({_PARTICLES})') OR regexp_matches({compact('text')}, '^[0-9]{{6,}}$') OR is_name OR cont OR p_name >= 0.7 THEN -1.0 ELSE p_address END AS ascore FROM m7),
m9 AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY CASE WHEN ascore >= 0.15 THEN ascore END DESC NULLS LAST, block_idx) = 1 AND ascore >= 0.15 AS is_seed FROM m8),
ok AS (SELECT *, max(y1) OVER (PARTITION BY filename ORDER BY y0, block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m9 WHERE is_seed OR ascore >= 0.15), isl AS (SELECT *, sum(CASE WHEN y0 - reach > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY filename ORDER BY y0, block_idx) AS island FROM ok),
ad AS (SELECT x.filename, string_agg(x.text, ', ' ORDER BY x.block_idx) AS address FROM isl x JOIN isl z ON x.filename = z.filename AND x.island = z.island AND z.is_seed GROUP BY x.filename),
nm AS (SELECT filename, max(p_name) FILTER (WHERE is_name) AS p, trim(concat_ws(' ', max(text) FILTER (WHERE is_name), max(text) FILTER (WHERE cont))) AS name FROM m7 GROUP BY filename),
geo AS (SELECT o.k, o.filename, o.split, CASE WHEN nm.p > 0 THEN {norm('nm.name')} ELSE '' END AS name, {DATE} AS birth_date, {norm("coalesce(ad.address, '')")} AS address FROM o LEFT JOIN nm ON nm.filename = o.filename LEFT JOIN ad ON ad.filename = o.filename)"""


def _geo(t) -> DataFrame:
    cards = reports(t).select("engine", "split", "filename")
    return rules.predict_geometric(scored(t), cards, _frequency(t), as_of_year=YEAR)


@query(f"WITH {CARDS}, {GEO} SELECT filename, name, birth_date, address FROM geo")
def rule_layer_fields(t):
    """The whole rule layer: exclusions, name continuation, address island, on each card."""
    return _geo(t).select("filename", "name", "birth_date", "address")


@query(f"WITH {CARDS}, {GEO} SELECT filename, name, strftime(d, '%Y-%m-%d') AS birth_date, address FROM geo JOIN o USING (filename)")
def two_engine_fields(t):
    """Name and address from the first engine, the date from both engines' blocks together."""
    merged = B.merge_engines(B.report_blocks(reports(t)), B.report_blocks(reports(t, "second", (3,), 1.0)))
    merged = merged.withColumns({"p_name": F.lit(0.0), "p_address": F.lit(0.0), "p_birth_date": (extract_date("text", YEAR) != "").cast("double"), "height": F.lit(400)})
    cards = reports(t).select(F.lit("merged").alias("engine"), "split", "filename")
    return rules.predict_multi_engine(_geo(t), rules.predict_geometric(merged, cards, as_of_year=YEAR)).select("filename", "name", "birth_date", "address")


METRICS = f"""l AS (SELECT e.split, e.filename, unnest(['name', 'birth_date', 'address']) AS field, unnest([e.name, e.birth_date, e.address]) AS expected, unnest([geo.name, geo.birth_date, geo.address]) AS predicted FROM e JOIN geo ON e.filename = geo.filename),
s AS (SELECT *, {norm('expected')} AS en, {norm('predicted')} AS pn, {compact('expected')} AS ec, {compact('predicted')} AS pc, {words('expected')} AS e, {words('predicted')} AS p FROM l), {WORDS}"""
_RATE = lambda a, b: f"CASE WHEN length({a}) = 0 THEN CASE WHEN length({b}) > 0 THEN 1.0 ELSE 0.0 END ELSE levenshtein({a}, {b}) / length({a})::DOUBLE END"


@query(f"""WITH {CARDS}, {GEO}, {METRICS} SELECT split, field, count(*) AS n, round(avg((en = pn)::INTEGER), 6) AS exact_accuracy, round(count_if(en = pn AND expected <> '') / greatest(count_if(expected <> ''), 1)::DOUBLE, 6) AS nonempty_expected_exact_accuracy,
round(count_if(en = pn AND expected = '') / greatest(count_if(expected = ''), 1)::DOUBLE, 6) AS empty_expected_exact_accuracy, count_if(expected <> '')::BIGINT AS n_nonempty_expected, round(avg({_RATE('ec', 'pc')}), 6) AS mean_normalized_edit_distance, round(avg({_RATE('en', 'pn')}), 6) AS character_error_rate, round(avg({WORD_RATE}), 6) AS word_error_rate FROM z GROUP BY split, field""")
def evaluation(t):
    """Predictions joined to what was expected, and all eight metrics of each field."""
    got = _geo(t).select("filename", F.struct("name", "birth_date", "address").alias("predicted"))
    rows = score.long_form(reports(t).select("split", "filename", "expected").join(got, "filename"), ["split", "filename"])
    out = score.field_metrics(rows, ["split"])
    return out.select("split", "field", "n", "n_nonempty_expected", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("split", "field", "n", "n_nonempty_expected")])


@query(f"""WITH {CARDS}, {GEO}, {METRICS}, a AS (SELECT split, filename, bool_and(en = pn) AS ok FROM s GROUP BY 1, 2), f AS (SELECT split, field, avg((en = pn)::INTEGER) AS exact_accuracy FROM s GROUP BY 1, 2)
SELECT g.split, g.n, round(g.whole, 6) AS all_fields_exact_accuracy, f.field, round_even(f.exact_accuracy * 100, 1) AS exact_percent FROM (SELECT split, count(*) AS n, count_if(ok) / count(*)::DOUBLE AS whole FROM a GROUP BY split) g JOIN f ON g.split = f.split""")
def evaluation_report(t):
    """Metrics as one struct per split, taken apart again as the experiment log does, in per cent."""
    got = _geo(t).select("filename", F.struct("name", "birth_date", "address").alias("predicted"))
    metrics = score.score_predictions(reports(t).select("split", "filename", "expected").join(got, "filename"), ["split"])
    rows = score.explode_metrics(metrics.withColumns({"all": F.round("metrics.all_fields_exact_accuracy", 6), "cards": F.col("metrics.n")}))
    return rows.select("split", F.col("cards").alias("n"), F.col("all").alias("all_fields_exact_accuracy"), "field", score.percent("exact_accuracy").alias("exact_percent"))


HEUR = f"""nl AS (SELECT filename, block_idx, {norm('text')} AS line FROM b), hn AS (SELECT filename, line, row_number() OVER (PARTITION BY filename ORDER BY length(line) DESC, block_idx) AS r FROM nl WHERE line <> '' AND NOT regexp_matches(line, '[0-9]') AND line NOT IN ({STOP})),
ha AS (SELECT filename, line, row_number() OVER (PARTITION BY filename ORDER BY length(line) DESC, block_idx) AS r FROM nl WHERE regexp_matches(line, '{"|".join(ADDRESS_KEYWORDS)}') OR regexp_matches(line, '(^|[^A-Z0-9_])[0-9]{{4,5}}($|[^A-Z0-9_])')),
parsed AS (SELECT o.filename, coalesce(hn.line, '') AS name, {DATE} AS birth_date, coalesce(ha.line, '') AS address FROM o LEFT JOIN hn ON hn.filename = o.filename AND hn.r = 1 LEFT JOIN ha ON ha.filename = o.filename AND ha.r = 1)"""


@query(f"WITH {CARDS}, {HEUR} SELECT * FROM parsed")
def parsed_fields(t):
    """Text rules alone over a card's whole text."""
    return reports(t).select("filename", parse_fields("raw.full", YEAR).alias("f")).select("filename", "f.*")


@query(f"""WITH {CARDS}, {HEUR}, l AS (SELECT unnest(['name', 'birth_date', 'address']) AS field, unnest([e.name, e.birth_date, e.address]) AS expected, unnest([p.name, p.birth_date, p.address]) AS predicted FROM e JOIN parsed p ON e.filename = p.filename)
SELECT field, count(*) AS n, round(avg(({norm('expected')} = {norm('predicted')})::INTEGER), 6) AS exact_accuracy FROM l GROUP BY field""")
def rescored(t):
    """Metrics from saved text, no image being read."""
    metrics = pipelines.rescore(reports(t), YEAR)
    return score.explode_metrics(metrics).select("field", "n", F.round("exact_accuracy", 6).alias("exact_accuracy"))


@query(f"""WITH {CARDS} SELECT filename, block_idx, regexp_matches(list_extract(string_split(trim(upper(text)), ' '), -1), '({_PARTICLES})$') AS ends, len(list_intersect(string_split(trim(upper(text)), ' '), {list(NAME_PARTICLES)})) > 0 AS particle, regexp_matches(string_split(trim(upper(text)), ' ')[1], '^({_PARTICLES})') AS starts, regexp_matches({compact('text')}, '^[0-9]{{6,}}$') AS digits,
{norm('text')} = {norm('name')} AS is_name, array_to_string(list_transform(string_split(text, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM (SELECT b.*, e.name FROM b JOIN e ON b.filename = e.filename WHERE block_idx IN (1, 2, 6)) z""")
def block_predicates(t):
    """Particles at either end, runs of digits, equality as normalised, title case."""
    b = B.report_blocks(reports(t)).filter("block_idx in (1, 2, 6)").join(reports(t).select("filename", F.col("expected.name").alias("name")), "filename")
    return b.select("filename", F.col("block_idx").cast("long").alias("block_idx"), ends_with_name_particle("text").alias("ends"), has_name_particle("text").alias("particle"), starts_with_name_particle("text").alias("starts"), is_id_fragment("text").alias("digits"), normalized_equal("text", "name").alias("is_name"), title_case("text").alias("title"))


MONTH = "upper(strftime(o_orderdate, '%b'))"
_ISO = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""SELECT o_orderkey, {_ISO} AS after_bad_id, '' AS bad_id_alone, CASE WHEN day(o_orderdate) > 12 THEN {_ISO} ELSE strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') END AS month_first, {_ISO} AS after_bad_iso, {_ISO} AS after_bad_word,
strftime(make_date(2000 + (o_orderkey % 32)::BIGINT, month(o_orderdate), 5), '%Y-%m-%d') AS short_year, '00' || (o_orderkey % 60 + 40)::VARCHAR || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '-05' AS ancient_year, strftime(make_date(1900 + (o_orderkey % 40 + 60)::BIGINT, month(o_orderdate), 5), '%Y-%m-%d') AS mended_year, '' AS no_date, '' AS no_such_day,
{_ISO} AS id_first, '2001-02-03' AS id_not_used, {_ISO} AS second_number FROM (SELECT * REPLACE (o_orderdate::DATE AS o_orderdate) FROM orders)""")
def date_fall_throughs(t):
    """Each way a reading can fail and the next one is tried: an ID or date that doesn't exist, month before day, two-digit years, none at all."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    as_text = lambda p: F.date_format(d, p)
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    read = lambda c, **how: extract_date(c, YEAR, **how)
    forms = {
        "after_bad_id": read(cat("991399-10-1234 ", as_text("yyyy-MM-dd"))),
        "bad_id_alone": read(cat("991399-10-", F.lpad((k % 10000).cast("string"), 4, "0"))),
        "month_first": read(cat("on ", as_text("MM/dd/yyyy"))),
        "after_bad_iso": read(cat("2001-13-45, ", as_text("dd.MM.yyyy"))),
        "after_bad_word": read(cat("31 FEB 2001 ", as_text("dd-MM-yyyy"))),
        "short_year": read(cat("05.", as_text("MM"), ".", two(k % 32))),
        "ancient_year": read(cat("05.", as_text("MM"), ".", two(k % 60 + 40))),
        "mended_year": read(cat("05.", as_text("MM"), ".", two(k % 40 + 60)), fix_two_digit_year=True),
        "no_date": read(cat("NO ", k.cast("string"))),
        "no_such_day": read(F.lit("32.01.2000 and 30.02.2000")),
        "id_first": read(cat("2001-02-03 ", as_text("yyMMdd"), "-10-1234")),
        "id_not_used": read(cat("2001-02-03 ", as_text("yyMMdd"), "-10-1234"), use_id=False),
        "second_number": read(cat("45.45.4545 then ", as_text("dd/MM/yyyy"))),
    }
    return t("orders").select("o_orderkey", *[c.alias(n) for n, c in forms.items()])
