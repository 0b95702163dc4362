"""Ingest and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import images
from fieldloom.sources import ingest, sinks
from fieldloom.streaming import reports as streaming


def test_ground_truth_repair(spark, tmp_path):
    rows = ["﻿filename,name,birth_date,address", '"image_001.jpg,JANE DOE,1965-02-11,""PT 1160, JALAN X"""', "image_002.jpg, PLAIN ROW ,1990-01-01,", "", 'image_003.jpg,"DOE, J",1990,"A ""B"" C"']
    path = tmp_path / "gt.csv"
    path.write_bytes("\r\n".join(rows).encode("utf-8"))
    got = {r["filename"]: tuple(r)[1:] for r in ingest.read_ground_truth(spark, str(path), {"image_003.jpg": "1991-01-01"}).collect()}
    assert got == {"image_001.jpg": ("JANE DOE", "1965-02-11", "PT 1160, JALAN X"), "image_002.jpg": ("PLAIN ROW", "1990-01-01", ""), "image_003.jpg": ("DOE, J", "1991-01-01", 'A "B" C')}
    path.write_text("filename,name,birth_date,address\na,b\n")
    assert [r["n_cells"] for r in ingest.failed_rows(spark, str(path)).collect()] == [2]
    with pytest.raises(Exception, match="too few"):
        ingest.read_ground_truth(spark, str(path)).collect()
    assert ingest.read_ground_truth(spark, str(path), strict=False).count() == 0
    path.write_text("a,b\n")
    with pytest.raises(ValueError):
        ingest.read_ground_truth(spark, str(path))
    path.write_text('filename,name,birth_date,address\nx,"two\nlines",1990,a\n"y,""more\nlines"",1991,b"\nfilename,name,birth_date,address\n')
    got = [tuple(r) for r in ingest.read_ground_truth(spark, str(path)).collect()]
    assert got == [("x", "two\nlines", "1990", "a"), ("y", "more\nlines", "1991", "b"), ("filename", "name", "birth_date", "address")]


def test_split_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", "N", "", 'x "y", z', "train"), ("a", "M", "1990", "", "val")], "filename string, name string, birth_date string, address string, split string")
    sinks.write_splits(df, str(tmp_path / "s"))
    back = ingest.read_split(spark, str(tmp_path / "s" / "split=train"))
    assert [tuple(r) for r in back.collect()] == [("b", "N", "", 'x "y", z')]
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert [r["filename"] for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()] == ["a", "b"]


def test_reports_log_and_stream(spark, tmp_path):
    doc = {"engine": "x", "predictions": [{"filename": "f", "expected": {"name": "A"}, "raw": {"full": "JANE DOE\n1990-01-02"}}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text(json.dumps(doc, indent=1))
    got = ingest.read_reports(spark, str(tmp_path / "in" / "r.json")).first()
    assert got["filename"] == "f" and got["expected"]["birth_date"] is None and got["raw"]["blocks"] is None
    metrics = spark.range(1).select(F.struct(F.lit(1).cast("long").alias("n"), F.lit(0.5).alias("all_fields_exact_accuracy")).alias("metrics"))
    for m in ("one", "two"):
        sinks.log_experiment(metrics, str(tmp_path / "log"), "x", "val", m)
    log = ingest.read_experiments(spark, str(tmp_path / "log"))
    assert log.filter("ts is not null").count() == 2 and {r["method"] for r in log.collect()} == {"one", "two"}
    rows = streaming.stream_predictions(streaming.stream_reports(spark, str(tmp_path / "in")), 2026)
    streaming.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("JANE DOE", "1990-01-02", "1990 01 02")]


def test_report_by_line(spark, tmp_path):
    """A report of any size: one JSON document in one file, predictions in order, read by lines in several parts."""
    path = str(tmp_path / "r")
    rows = [(f"{i:04d}.jpg" if i else None, {"name": 'A "B"\r\n]}', "birth_date": None, "address": ",\u2028{"}, None, {"full": f"{i}\n\"predictions\":[", "blocks": [("x", [[0.0, 1.5]], 0.5)] * (i % 3)}) for i in range(500)]
    preds = spark.createDataFrame(rows[::-1], ingest.PREDICTION).repartition(7)
    metrics = spark.range(1).select(F.struct(F.lit(500).cast("long").alias("n"), F.lit(0.5).alias("all_fields_exact_accuracy"), F.lit(None).cast("map<string,double>").alias("fields")).alias("metrics"))
    plain = lambda df: sorted(map(str, df.select("filename", "expected", "predicted", "raw").collect()))
    for df in (preds.limit(0), preds):  # the second replaces the first
        sinks.write_report(df, "one", metrics, path)
        files = [f for f in (tmp_path / "r").iterdir() if not f.name.startswith(".")]
        assert len(files) == 1 and [f.name for f in tmp_path.iterdir()] == ["r"]
        doc = json.loads(files[0].read_text())
        assert doc["engine"] == "one" and doc["metrics"]["n"] == 500 and [p.get("filename") for p in doc["predictions"]] == [r[0] for r in rows][: df.count()]
        assert plain(ingest.read_reports(spark, path)) == plain(df) == plain(ingest.read_reports(spark, str(files[0])))
    with pytest.raises(ValueError):
        sinks.write_report(preds, "one", metrics.limit(0), path)
    (tmp_path / "r" / "other.json").write_text(json.dumps({"engine": "two", "predictions": [{"filename": "f"}]}, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = ingest.read_reports(spark, path)
        assert got.rdd.getNumPartitions() > 5
        assert {r["engine"]: r["n"] for r in got.groupBy("engine").agg(F.count(F.lit(1)).alias("n")).collect()} == {"one": 500, "two": 1}
        import __spark_entry__

        assert __spark_entry__.queries()["report_round_trip"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_and_images(spark, tmp_path):
    for n in ("a.JPG", "b.txt", "c.png"):
        (tmp_path / n).write_bytes(b"no image")
    assert {r["filename"] for r in ingest.list_files(spark, str(tmp_path), images_only=True).collect()} == {"a.JPG", "c.png"}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r["status"] for r in images.load_images(files).collect()} == {"failed"}
    images.register_engine("fake", lambda device: lambda raw: ("T", [{"text": "T", "bbox": [[0.0, 0.0]], "confidence": 1.0}]))
    assert images.recognize(files, "fake").filter("status = 'ok' and raw.full = 'T'").count() == 3
    with pytest.raises(ValueError):
        images.build_engine("nothing")


def test_audit(spark):
    df = spark.createDataFrame([("a", "", "1990", "x"), ("a", "n", "1990-01-01", "")], "filename string, name string, birth_date string, address string")
    assert tuple(ingest.audit(df).first()) == (2, 1, 1, 0, 1, 1)


def test_pixel_stages(spark, tmp_path):
    import numpy as np

    from fieldloom.operators import pixels, stagelog

    rng = np.random.default_rng(1)
    image = (rng.random((40, 60, 3)) * 120 + 60).astype(np.uint8)
    (tmp_path / "a.ppm").write_bytes(pixels.encode(image))
    (tmp_path / "b.pgm").write_bytes(b"P5 3 2 255\n" + bytes(range(6)))
    (tmp_path / "c.jpg").write_bytes(b"broken")
    assert (pixels.decode(pixels.encode(image)) == image).all()
    files = spark.read.format("binaryFile").load(str(tmp_path))
    load, size, contrast = images.load_images(files), images.resize_images(files, cap=30), images.normalize_contrast(files)
    whole = {r["filename"]: r for r in stagelog.consolidate(load, size, contrast).collect()}
    assert {k: r["pipeline_status"] for k, r in whole.items()} == {"a.ppm": "ok", "b.pgm": "ok", "c.jpg": "failed"}
    assert (whole["a.ppm"]["final_width"], whole["a.ppm"]["final_height"], whole["a.ppm"]["downscaled"]) == (30, 20, True)
    assert whole["a.ppm"]["final_brightness_mean"] != whole["a.ppm"]["original_brightness_mean"] and stagelog.review(stagelog.consolidate(load, size, contrast)).first()["ok"] == 2
    for step in ("grayscale", "contrast", "equalize"):
        assert pixels.decode(images.PREPROCESSING[step](pixels.encode(image))).shape == image.shape


def test_geometry_of_pixels():
    import numpy as np

    from fieldloom.operators import pixels

    quad = np.array([[50, 10], [10, 12], [12, 52], [52, 50]])
    assert pixels.corners(quad).tolist() == [[10, 12], [50, 10], [52, 50], [12, 52]]
    assert np.allclose(pixels.crossing((3, 0.0), (5, np.pi / 2)), [3, 5]) and pixels.crossing((3, 0.1), (5, 0.15)) is None
    h = pixels.homography(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), quad)
    assert np.allclose((h @ [1, 1, 1])[:2] / (h @ [1, 1, 1])[2], [12, 52])
    image = np.zeros((64, 64, 3), np.uint8)
    image[20:44, 20:44] = 200
    flat = pixels.unwarp(image, np.array([[20, 20], [43, 20], [43, 43], [20, 43]]))
    assert flat.shape[0] == 23 and flat.min() == 200
    assert pixels.unwarp(image, np.array([[0, 0], [5, 0], [5, 5], [0, 5]])) is image
    assert pixels.largest_center([(0, 0, 2, 2), (10, 10, 4, 4)]) == (12, 12) and pixels.largest_center([]) is None
    light = pixels.lightness(np.array([[[0, 0, 0], [255, 255, 255]]], np.uint8))
    assert np.allclose(light, [[0, 255]])
