"""Text, date and field functions against cases and plain Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dates, fields, text


def column(spark, rows, expr, schema="t string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr).collect()]


DATES = {
    "DATE OF BIRTH\n1965-02-11\n": "1965-02-11",
    "04 LABEL\n22.06.1969": "1969-06-22",
    "BORN 22 JUN 1969": "1969-06-22",
    "born 22-june-1969": "1969-06-22",
    "991332": "",
    "NO DATE HERE": "",
    "001230-11-0470": "2000-12-30",
    "650211-11-5049": "1965-02-11",
    "31-12-69": "0069-12-31",
    "70.23.22.57": "",
    "02/13/1990": "1990-02-13",
    "31.02.1990 then 01.03.1991": "1991-03-01",
    "²1965-02-11": "",
    "": "",
}


def test_dates(spark):
    assert column(spark, list(DATES), dates.extract_date("t", 2026)) == list(DATES.values())
    assert column(spark, ["31-12-69", "31-12-19"], dates.extract_date("t", 2026, fix_two_digit_year=True)) == ["1969-12-31", "2019-12-31"]
    assert column(spark, ["001230-11-0470"], dates.extract_date("t", 2026, use_id=False)) == [""]
    assert column(spark, [None], dates.extract_date("t", 2026)) == [""]


def test_fields(spark):
    rows = ["MALAYSIA\nJANE ANN DOE\nISLAM", "JANE ANN DOE\nPT 1 P, JALAN X, 20400 TOWN", "JANE ANN DOE\nMALAYSIA", None, "ÄB CDE\r\n"]
    assert column(spark, rows, fields.extract_name("t")) == ["JANE ANN DOE", "JANE ANN DOE", "JANE ANN DOE", "", "CDE"]
    assert column(spark, rows, fields.extract_address("t")) == ["", "PT 1 P JALAN X 20400 TOWN", "", "", ""]


def test_particles_and_stopwords(spark):
    ends = {"AHMAD BIN": True, "SITI BINT": True, "RAMU A/L": True, "XXXBIN": True, "JANE DOE": False, "BINTIXXX": False, "": False}
    assert column(spark, list(ends), fields.ends_with_name_particle("t")) == list(ends.values())
    starts = {"BIN ALI": True, "BINTIXXX": True, "ALI BIN": False}
    assert column(spark, list(starts), fields.starts_with_name_particle("t")) == list(starts.values())
    stops = {"Malaysia": True, "MALAYSLA": True, "RM": True, "RN": False, "DATES": True, "JANE": False, "identity  card": True}
    assert column(spark, list(stops), fields.is_boilerplate_stopword("t")) == list(stops.values())
    assert column(spark, ["12-34 56", "12345", "A123456"], fields.is_id_fragment("t")) == [True, False, False]


def test_labels(spark):
    rows = [
        ("1965-02-11", "birth_date"), ("JANE ANN", "name"), ("JANE", "other"), ("12 JALAN X", "address"), ("  ", "other"), ("JANE X", "name"), ("FOO BAR BAZ", "other"),
    ]
    label = fields.label_block("t", F.lit("Jane Ann Doe X"), F.lit("1965-02-11"), F.lit("No 12, Jalan X, Jane"), as_of_year=2026)
    assert column(spark, [r[0] for r in rows], label) == [r[1] for r in rows]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def norm(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (s or "").upper())).strip()


def test_rates_against_plain_model(spark):
    rng = random.Random(7)
    words = ["NO", "12", "JALAN", "é", "x_y", "-", "RAYA", "ab", "AB"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(6))), " ".join(rng.choices(words, k=rng.randrange(6)))) for _ in range(150)]
    rows += [("", "OCR"), ("", ""), ("ABCD", "ABXD"), (None, "a"), ("Jane Ann Doe", "JANE ANN DOE")]
    df = spark.createDataFrame(rows, "e string, p string")
    got = df.select(text.character_error_rate("e", "p"), text.word_error_rate("e", "p"), text.normalize_text("e")).collect()
    for (e, p), (cer, wer, n) in zip(rows, got, strict=True):
        e, p = norm(e), norm(p)
        assert n == e
        rate = lambda a, b: (1.0 if b else 0.0) if not a else distance(a, b) / len(a)
        assert cer == pytest.approx(rate(e, p))
        assert wer == pytest.approx(rate(e.split(), p.split()))


def test_ngrams_and_nfkc(spark):
    assert column(spark, ["ab cd", "a", "", None, "é!"], text.char_ngrams("t")) == [["ABC", "BCD"], ["A"], [], [], []]
    assert column(spark, ["ﬁx ①"], text.compact_text("t", nfkc=True)) == ["FIX1"]
    assert column(spark, ["o'neil mcx"], text.title_case("t")) == ["O'Neil Mcx"]
    assert column(spark, ["a\n", "a\n\n", "a\r\nb", ""], text.lines("t")) == [["a"], ["a", ""], ["a", "b"], []]
