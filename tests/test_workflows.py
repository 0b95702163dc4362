"""Features against a plain model, and whole workflows over small reports."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import blocks as B
from fieldloom.operators import features, model, rules
from fieldloom.plans import pipelines
from fieldloom.sources import ingest, sinks

NAMES = ["JANE ANN DOE", "MARK LEE POE", "LINA RAY MOE", "OMAR ALI ROE"]


def cards(n=16, engine="one"):
    rng = random.Random(7)
    preds = []
    for i in range(n):
        name, date, address = NAMES[i % 4] + f" {'ABCDEFGHIJKLMNOP'[i]}X", f"19{50 + i}-03-1{i % 10}", f"NO {i} JALAN RAYA, 2040{i % 10} TOWN"
        texts = ["KAD PENGENALAN", date, name, address.split(",")[0], address.split(", ")[1], "WARGANEGARA"]
        blocks = []
        for k, t in enumerate(texts):
            y, x = 20.0 * k + rng.randrange(3), float(rng.randrange(5))
            blocks.append({"text": t, "bbox": [[x, y], [x + 6 * len(t), y], [x + 6 * len(t), y + 10], [x, y + 10]], "confidence": 0.9})
        preds.append({"filename": f"{i}.jpg", "expected": {"name": name, "birth_date": date, "address": address}, "predicted": {"name": "", "birth_date": "", "address": ""}, "raw": {"full": "\n".join(texts), "blocks": blocks}})
    preds.append({"filename": "empty.jpg", "expected": {"name": "NO ONE", "birth_date": "", "address": ""}, "raw": {"full": ""}})
    return {"engine": engine, "predictions": preds}


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("reports") / "r.json"
    path.write_text(json.dumps(cards()))
    return ingest.read_reports(spark, str(path)).withColumn("split", F.lit("train"))


@pytest.fixture(scope="module")
def sizes(spark):
    rows = [(f"{i}.jpg", 300, 140, 250.0, 70.0) for i in range(16)] + [("empty.jpg", 300, 140, None, None)]
    return spark.createDataFrame(rows, "filename string, width int, height int, face_x double, face_y double")


def test_features_against_plain_model(reports, sizes):
    got = {(r["filename"], r["block_idx"]): r for r in features.block_features(B.report_blocks(reports), sizes, use_face=True, as_of_year=2026).collect()}
    assert len(got) == 16 * 6
    for p in cards()["predictions"][:16]:
        blocks = p["raw"]["blocks"]
        lows = [b["bbox"][0][1] for b in blocks]
        order = sorted(range(6), key=lambda i: lows[i])
        by_length = sorted(range(6), key=lambda i: len(blocks[i]["text"]))
        anchor = order.index(1)
        for i, b in enumerate(blocks):
            r, t = got[p["filename"], i], b["text"]
            (x0, y0), (x1, y1) = b["bbox"][0], b["bbox"][2]
            assert r["y_frac"] == pytest.approx(y0 / 140) and r["width_frac"] == pytest.approx((x1 - x0) / 300)
            assert r["rank_from_top_frac"] == pytest.approx(order.index(i) / 5) and r["length_rank_on_card"] == pytest.approx(by_length.index(i) / 5)
            assert r["date_anchor_rank_dist"] == pytest.approx(abs(order.index(i) - anchor) / 5)
            assert r["digit_ratio"] == pytest.approx(sum(map(str.isdigit, t)) / len(t)) and r["upper_ratio"] == (1.0 if any(map(str.isalpha, t)) else 0.0)
            assert r["has_date_regex"] == float(i == 1) and r["has_address_keyword"] == float("JALAN" in t) and r["has_header_stopword"] == float(i in (0, 5))
            assert r["has_postcode_pattern"] == float(i in (1, 4)) and r["token_count"] == len(t.split())
            assert r["dist_to_face_frac"] == pytest.approx(math.hypot((x0 + x1) / 2 - 250, (y0 + y1) / 2 - 70) / math.hypot(300, 140))


def test_fit_predict_evaluate(spark, reports, sizes, tmp_path):
    table = pipelines.build_table(reports, sizes, as_of_year=2026)
    counts = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    assert counts["birth_date"] == 16 and counts["name"] == 16 and counts["address"] >= 16
    boilerplate, ngrams = pipelines.boilerplate_of(reports).cache(), pipelines.ngrams_of(reports, sizes, 2026).cache()
    assert {r["text_key"] for r in boilerplate.filter("freq > 0.9").collect()} == {"KADPENGENALAN", "WARGANEGARA"}
    assert ngrams.count() > 10
    fitted = pipelines.fit(reports, sizes, max_iter=60, as_of_year=2026)
    predicted = pipelines.predict(reports, sizes, fitted, "geo", boilerplate, 2026).cache()
    rows = {r["filename"]: r for r in predicted.collect()}
    assert len(rows) == 17 and rows["empty.jpg"]["name"] == ""
    metrics = pipelines.evaluate(reports, predicted).first()["metrics"]
    assert metrics["n"] == 17 and metrics["fields"]["name"]["nonempty_expected_exact_accuracy"] > 0.9 and metrics["fields"]["birth_date"]["exact_accuracy"] > 0.9
    assert pipelines.predict(reports, sizes, fitted, "plain", as_of_year=2026).count() == 17
    two = pipelines.predict_two_engines(reports, reports, sizes, fitted, boilerplate, 2026)
    assert two.count() == 17 and {r["name"] for r in two.collect()} == {r["name"] for r in rows.values()}
    # the feature's frequencies and those that bar blocks are two tables, and both passes have all statistics
    common = {"frequency": boilerplate, "ngrams": ngrams, "use_face": True}
    with_all = pipelines.fit(reports, sizes, max_iter=60, as_of_year=2026, boilerplate=boilerplate, ngrams=ngrams, use_face=True)
    feats = {"boilerplate": boilerplate, "ngrams": ngrams, "use_face": True}
    scored = model.score(with_all, features.block_features(B.report_blocks(reports), sizes, as_of_year=2026, **feats))
    want = {r["filename"]: tuple(r) for r in rules.predict_geometric(scored, pipelines.cards_of(reports), as_of_year=2026).select("filename", "name", "address").collect()}
    seen = []
    plain = features.block_features

    def spy(blocks, s, *a, **k):
        seen.append((a, k))
        return plain(blocks, s, *a, **k)

    pipelines.block_features = spy
    try:
        got = pipelines.predict(reports, sizes, with_all, as_of_year=2026, **common)
        assert {r["filename"]: tuple(r) for r in got.select("filename", "name", "address").collect()} == want
        pipelines.predict_two_engines(reports, reports, sizes, with_all, as_of_year=2026, **common)
    finally:
        pipelines.block_features = plain
    assert len(seen) == 3 and all(a[0] is boilerplate and a[1] is ngrams and a[2] is True for a, _ in seen)
    doc = sinks.report(reports.join(predicted.select("filename", F.struct("name", "birth_date", "address").alias("got")), "filename").withColumn("predicted", F.col("got")), "one", pipelines.evaluate(reports, predicted))
    sinks.write_json(doc, str(tmp_path / "r"))
    assert ingest.read_reports(spark, str(tmp_path / "r")).count() == 17
    with_ngrams = features.block_features(B.report_blocks(reports), sizes, boilerplate, ngrams, as_of_year=2026)
    assert with_ngrams.filter("boilerplate_freq > 0.9").count() == 32 and with_ngrams.filter("name_char_ngram_score <> 0").count() > 0


def test_other_classifiers(reports, sizes):
    table = pipelines.build_table(reports, sizes, as_of_year=2026).cache()
    forest = model.score(model.fit(table, "forest"), table)
    assert forest.filter("label = predicted_label").count() > 0.8 * table.count()


def test_rescore(reports):
    metrics = pipelines.rescore(reports, 2026).first()["metrics"]
    assert metrics["fields"]["birth_date"]["exact_accuracy"] == 1.0


def test_entities_and_votes(spark):
    cards_ = spark.createDataFrame([("e", "s", "a"), ("e", "s", "b")], "engine string, split string, filename string")
    found = spark.createDataFrame([("e", "s", "a", 1, "SURNAME", "Doe"), ("e", "s", "a", 0, "GIVENNAME", "Jane"), ("e", "s", "a", 2, "CITY", "Town")], "engine string, split string, filename string, at int, label string, text string")
    fallback = cards_.withColumn("birth_date", F.lit("1990-01-01"))
    got = {r["filename"]: r for r in rules.combine_entities(found, cards_, fallback).collect()}
    assert (got["a"]["name"], got["a"]["birth_date"], got["a"]["address"]) == ("JANE DOE", "1990-01-01", "TOWN") and got["b"]["name"] == ""
    votes = spark.createDataFrame([("f", "x"), ("f", "y"), ("f", "y"), ("g", "b"), ("g", "a")], "k string, v string")
    assert {r["k"]: r["v"] for r in rules.vote(votes, ["k"], "v").collect()} == {"f": "y", "g": "a"}
