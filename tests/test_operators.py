"""Geometry, rules, corpus statistics, splits, scores, logs: cases and plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import blocks as B
from fieldloom.operators import corpus, features, model, rules, score, split, stagelog

BLOCK = "engine string, split string, filename string, block_idx int, text string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, height int, p_name double, p_birth_date double, p_address double"


def block(f, i, box, text="T", name=0.0, date=0.0, address=0.0, height=300):
    x0, y0, x1, y1 = map(float, box)
    return ("e", "s", f, i, text, x0, y0, x1, y1, (x0 + x1) / 2, (y0 + y1) / 2, height, name, date, address)


def test_outlier(spark):
    boxes = [(10, 10, 20, 20), (12, 30, 22, 40), (11, 50, 21, 60), (13, 70, 23, 80), (10, 90, 20, 100), (900, 900, 950, 950)]
    df = spark.createDataFrame([block("a", i, b) for i, b in enumerate(boxes)], BLOCK)
    assert [r[0] for r in features.inliers(df).orderBy("block_idx").select("inlier").collect()] == [True] * 5 + [False]


def greedy(rows, seed, gap, least):
    inside = {seed}
    while True:
        lo, hi = min(rows[i][0] for i in inside), max(rows[i][1] for i in inside)
        near = [(max(0, y0 - hi, lo - y1), i) for i, (y0, y1, s) in enumerate(rows) if i not in inside and s >= least and max(0, y0 - hi, lo - y1) <= gap]
        if not near:
            return sorted(inside)
        inside.add(min(near)[1])


def test_islands_equal_greedy_growth(spark):
    rng = random.Random(3)
    cards = {}
    for c in range(120):
        rows = []
        for _ in range(rng.randrange(1, 12)):
            y0 = rng.randrange(0, 200)
            rows.append((y0, y0 + rng.randrange(0, 25), rng.random()))
        cards[str(c)] = rows
    data = [block(c, i, (0, r[0], 5, r[1]), address=r[2]) for c, rows in cards.items() for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, BLOCK).withColumn("seed", rules.argmax_flag(F.col("p_address")))
    out = rules.seed_island(df, "seed", "p_address", F.lit(12.0), 0.3).filter("in_island").groupBy("filename").agg(F.sort_array(F.collect_list("block_idx")).alias("i"))
    got = {r["filename"]: r["i"] for r in out.collect()}
    for c, rows in cards.items():
        seed = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
        assert got[c] == greedy(rows, seed, 12.0, 0.3)


def test_island_case(spark):
    boxes, scores = [(0, 0, 50, 10), (0, 12, 50, 22), (0, 24, 50, 34), (0, 200, 50, 210)], [0.9, 0.8, 0.7, 0.9]
    df = spark.createDataFrame([block("a", i, b, address=s) for i, (b, s) in enumerate(zip(boxes, scores, strict=True))], BLOCK)
    df = df.withColumn("seed", F.col("block_idx") == 0)
    assert [r[0] for r in rules.seed_island(df, "seed", "p_address", F.lit(15.0)).filter("in_island").orderBy("block_idx").select("block_idx").collect()] == [0, 1, 2]


def test_continuation(spark):
    boxes = [(0, 0, 100, 10), (0, 12, 100, 22), (0, 24, 100, 34), (0, 200, 100, 210)]
    rows = [block("a", i, b, t) for i, (b, t) in enumerate(zip(boxes, ["ALI BIN", "AHMAD", "NO 1", "X"], strict=True))]
    rows += [block("b", 0, boxes[0], "ALI BIN"), block("b", 1, boxes[1], "A B C D")]
    rows += [block("c", 0, (0, 50, 9, 60), "ALI BIN"), block("c", 1, (0, 40, 9, 48), "ONE"), block("c", 2, (0, 62, 9, 70), "TWO")]
    df = spark.createDataFrame(rows, BLOCK).withColumn("seed", F.col("block_idx") == 0)
    got = rules.name_continuation(df, "seed", F.lit(15.0)).filter("continues").orderBy("filename").select("filename", "block_idx").collect()
    assert [tuple(r) for r in got] == [("a", 1), ("c", 2)]


def test_rule_layer(spark):
    y = lambda i: (0, 20 * i, 100, 20 * i + 10)
    rows = [
        block("a", 0, y(0), "KAD PENGENALAN", name=0.9), block("a", 1, y(1), "650211-11-5049", date=0.9), block("a", 2, y(2), "MOHD ALI BIN", name=0.8, address=0.5),
        block("a", 3, y(3), "AHMAD", name=0.2, address=0.4), block("a", 4, y(4), "12 JALAN X", address=0.9), block("a", 5, y(5), "WARGANEGARA", address=0.8),
        block("a", 6, y(6), "20400 TOWN", address=0.3), block("a", 7, y(7), "1234567", address=0.8),
    ]
    df = spark.createDataFrame(rows, BLOCK).withColumn("height", F.lit(700))
    cards = spark.createDataFrame([("e", "s", "a"), ("e", "s", "empty")], "engine string, split string, filename string")
    got = {r["filename"]: r for r in rules.predict_geometric(df, cards, as_of_year=2026).collect()}
    assert (got["a"]["name"], got["a"]["birth_date"], got["a"]["address"]) == ("MOHD ALI BIN AHMAD", "1965-02-11", "12 JALAN X 20400 TOWN")
    assert (got["empty"]["name"], got["empty"]["birth_date"], got["empty"]["address"]) == ("", "", "")
    freq = spark.createDataFrame([("20400TOWN", 0.5)], "text_key string, freq double")
    assert {r["filename"]: r["address"] for r in rules.predict_geometric(df, cards, freq, as_of_year=2026).collect()}["a"] == "12 JALAN X"
    plain = {r["filename"]: r for r in rules.predict_plain(df, cards, as_of_year=2026).collect()}
    assert plain["a"]["name"] == "KAD PENGENALAN" and plain["a"]["address"] == "MOHD ALI BIN 12 JALAN X WARGANEGARA 1234567"


def test_reports_and_boilerplate(spark):
    pt = lambda: [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]
    card = lambda f, who, texts: (f, {"name": who, "birth_date": "", "address": ""}, {"full": "", "blocks": [{"text": t, "bbox": pt(), "confidence": 1.0} for t in texts]})
    rows = [card("1", "P", ["MALAYSIA", "SAME PERSON"]), card("2", "P", ["MALAYSIA", "SAME PERSON"]), card("3", "P", ["SAME PERSON"]), card("4", "Q", ["MALAYSIA"])]
    schema = "filename string, expected struct<name: string, birth_date: string, address: string>, raw struct<full: string, blocks: array<struct<text: string, bbox: array<array<double>>, confidence: double>>>"
    reports = spark.createDataFrame(rows, schema).withColumns({"engine": F.lit("x"), "split": F.lit("train")})
    from fieldloom.plans import pipelines

    assert {r["text_key"]: r["freq"] for r in pipelines.boilerplate_of(reports).collect()} == {"MALAYSIA": 1.0, "SAMEPERSON": 0.5}
    b = B.report_blocks(reports).filter("filename = '1' AND block_idx = 0").first()
    assert (b["x0"], b["x1"], b["y1"], b["cx"], b["cy"]) == (0.0, 4.0, 2.0, 2.0, 1.0)
    assert B.merge_engines(B.report_blocks(reports), B.report_blocks(reports)).filter("filename = '1'").count() == 4


def test_ngram_model(spark):
    rows = [(n, "name") for n in ("SITI AMINAH", "AHMAD ALI", "MARIA LIM", "AMIR ALIM", "LINA AHMADI")] + [("WARGANEGARA", "other")] * 10
    m = corpus.ngram_model(spark.createDataFrame(rows, "text string, label string"))
    blocks = spark.createDataFrame([(0, "AMINA ALI"), (1, "WARGANEGARA"), (2, "")], "i int, text string")
    got = {r["i"]: r["ngram_score"] for r in corpus.ngram_score(blocks, m, ["i"]).collect()}
    assert got[0] > got[1] and got[2] == 0.0


def records(spark, groups):
    rows = [(f"{n}-{i}", n, "2000-01-01", a) for n, k, a in groups for i in range(k)]
    return spark.createDataFrame(rows, "filename string, name string, birth_date string, address string")


@pytest.mark.parametrize("shuffle", ["hash", "mt19937"])
def test_split(spark, shuffle):
    df = records(spark, [("BIG", 40, "")] + [(f"P{i}", 1 + i % 2, "X" if i % 3 else "") for i in range(60)])
    out = split.group_split(df, shuffle=shuffle).collect()
    where = {}
    for r in out:
        where.setdefault(r["name"], set()).add(r["split"])
    assert len(out) == df.count() and all(len(s) == 1 for s in where.values())
    assert where["BIG"] == {"train"} and {s for v in where.values() for s in v} == {"train", "val", "test"}
    assert len({r["name"] for r in out if r["split"] == "train" and r["address"]}) >= 15
    again = split.group_split(df.repartition(7), shuffle=shuffle).collect()
    assert {(r["filename"], r["split"]) for r in again} == {(r["filename"], r["split"]) for r in out}
    for bad in ({"ratios": (0.5, 0.1, 0.1)}, {"ratios": (0.9, 0.1, 0.0)}, {"max_rows_per_identity_in_eval": 0}):
        with pytest.raises(ValueError):
            split.group_split(df, **bad)
    with pytest.raises(ValueError):
        split.group_split(df.limit(0), shuffle=shuffle)


def test_fold_over_counts_equals_the_fold_over_identities():
    rng = random.Random(8)
    for _ in range(200):
        free = {n: rng.randrange(0, 60) for n in range(1, rng.randrange(2, 5))}
        held = rng.randrange(0, 80)
        total = held + sum(n * k for n, k in free.items())
        target = [r * total for r in (0.8, 0.1, 0.1)]
        got, want, counts = [held, 0, 0], [held, 0, 0], {n: [0, 0, 0] for n in free}
        made = split.fold_counts(free, got, target)
        for n in sorted(free, reverse=True):
            for _ in range(free[n]):
                best = min(range(3), key=lambda i: want[i] - target[i])
                want[best] += n
                counts[n][best] += 1
        assert got == want and made == counts
    many = split.fold_counts({1: 3_000_000}, got := [0, 0, 0], [2_400_000.0, 300_000.0, 300_000.0])
    assert sum(many[1]) == 3_000_000 and max(abs(g - t) for g, t in zip(got, (2_400_000, 300_000, 300_000), strict=True)) <= 2


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice([rng.random() * 1e9, 5.0, -1e-9, rng.gauss(0, 1)]), float(rng.randrange(3)), None if i % 3 else 1.5) for i in range(3001)]
    df = spark.createDataFrame([*rows, (float("nan"), None, None)], "a double, b double, c double").repartition(5)
    got = stagelog.quantiles(df, ["a", "b", "c"], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0))
    for i, c in enumerate("abc"):
        values = sorted(r[i] for r in rows if r[i] is not None)
        for p in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
            place = (len(values) - 1) * p
            low = int(place)
            high = min(low + 1, len(values) - 1)
            assert got[c, p] == pytest.approx(values[low] + (values[high] - values[low]) * (place - low), rel=1e-12)
    assert set(stagelog.quantiles(df.limit(0), ["a"], (0.5,)).values()) == {None}


@pytest.mark.parametrize("most", [100_000, 0])
def test_frequent_texts_join(spark, most):
    rows = spark.createDataFrame([(f"f{i}", i, "HOT" if i % 2 else f"T{i % 7}") for i in range(200)], "filename string, block_idx int, key string")
    table = spark.createDataFrame([("HOT", 0.9), ("T2", 0.001), ("T4", 0.5), ("NONE", 0.7)], "key string, freq double")
    got = {r["block_idx"]: r["freq"] for r in B.join_frequent(rows, table, "key", most=most).collect()}
    assert got == {i: 0.9 if i % 2 else {2: 0.001, 4: 0.5}.get(i % 7, 0.0) for i in range(200)}


def test_longer_grams_by_rows(spark):
    rows = spark.createDataFrame([("SITI AMINAH", "name"), ("AHMAD ALI", "name"), ("WARGANEGARA", "other"), ("AB", "other"), ("", "other")], "text string, label string")
    for n in (2, 3, 4):
        m = corpus.ngram_model(rows, n=n)
        plain = [(t[i : i + n], lab) for t, lab in (("SITIAMINAH", "name"), ("AHMADALI", "name"), ("WARGANEGARA", "other"), ("AB", "other")) for i in range(max(1, len(t) - n + 1))]
        assert {r["gram"] for r in m.collect()} == {g for g, _ in plain}
        scores = {r["i"]: r["ngram_score"] for r in corpus.ngram_score(spark.createDataFrame([(0, "AMINA ALI"), (1, "WARGA"), (2, "é")], "i int, text string"), m, ["i"], n=n).collect()}
        assert scores[0] > scores[1] and scores[2] == 0.0


def test_scores(spark):
    rows = [("a", ("JANE", "1990-01-01", ""), ("JANE", "1990-01-01", "")), ("b", ("JOHN", "", "12 X"), ("JON", "1990-01-01", "12 X"))]
    schema = "filename string, expected struct<name: string, birth_date: string, address: string>, predicted struct<name: string, birth_date: string, address: string>"
    m = score.score_predictions(spark.createDataFrame(rows, schema)).first()["metrics"]
    assert m["n"] == 2 and m["all_fields_exact_accuracy"] == 0.5
    assert m["fields"]["name"]["exact_accuracy"] == 0.5 and m["fields"]["name"]["character_error_rate"] == 0.125
    assert m["fields"]["birth_date"]["empty_expected_exact_accuracy"] == 0.0 and m["fields"]["birth_date"]["n_nonempty_expected"] == 1


def test_pivot_and_latest(spark):
    df = spark.createDataFrame([("m", "val", 1, 2.0), ("m", "test", 2, 3.0), ("k", "val", 3, 4.0)], "method string, split string, at int, v double")
    assert {r["method"]: r["val"] for r in score.pivot_table(df, ["method"], "split", ["v"], ["val", "test"]).collect()} == {"m": 2.0, "k": 4.0}
    with pytest.raises(Exception, match="duplicate"):
        score.pivot_table(df.unionAll(df), ["method"], "split", ["v"], ["val"]).collect()
    assert {r["method"]: r["v"] for r in score.latest(df, ["method"], "at").collect()} == {"m": 3.0, "k": 4.0}
    assert tuple(score.before_after(df, ["method"], "at", 2, "v").orderBy("method").collect()[1])[1:] == (2.0, 3.0)
    assert score.first_match([df.filter("method = 'k'"), df], "method", "m").first()["v"] in (2.0, 3.0)


def test_stage_logs(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "k int, v double")
    assert [r["bin"] for r in stagelog.halves(df, "v").orderBy("k").collect()] == ["small"] * 3 + ["large"] * 2
    size = df.select(stagelog.resized(F.lit(3600), F.lit(1), 1800).alias("s")).first()["s"]
    assert (size["width"], size["height"], size["downscaled"], size["very_low_res"]) == (1800, 1, True, False)
    assert {r["k"] for r in stagelog.sample(df, "k", 3).collect()} == {r["k"] for r in stagelog.sample(df.repartition(3), "k", 3).collect()}
    assert stagelog.spot_check(df, df.withColumn("v", F.when(F.col("k") == 2, 9.0).otherwise(F.col("v"))), "k", ["v"]).filter("not matches").count() == 1
    with pytest.raises(Exception, match="too large"):
        stagelog.hold(df, F.col("v") < 5, "too large").collect()
    empty = stagelog.histogram(df.limit(0), "v").collect()
    assert empty == []


def test_model_roundtrip(spark, tmp_path):
    from fieldloom.sources import sinks

    rng = random.Random(5)
    rows = [(float(k == "name") + rng.random() / 5, float(k == "other") + rng.random() / 5, k) for k in ("name", "other", "address") for _ in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    fitted = model.fit(df, features=("a", "b"), max_iter=100)
    out = model.score(fitted, df.drop("label"))
    assert out.filter("p_birth_date <> 0").count() == 0
    assert model.score(fitted, df).filter("predicted_label = label").count() >= 85
    assert model.top_coefficients(fitted, 1, ("a", "b"))["name"][0][0] == "a"
    sinks.save_model(fitted, spark.createDataFrame([("X", 0.5)], "text_key string, freq double"), str(tmp_path / "m"))
    again, freq = sinks.load_model(spark, str(tmp_path / "m"))
    assert model.classes(again) == ["address", "name", "other"] and freq.count() == 1
    with pytest.raises(ValueError):
        model.fit(df, "catboost", ("a", "b"))
