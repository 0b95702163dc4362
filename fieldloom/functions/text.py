"""Text normalisation, n-grams and edit-distance rates as Column expressions.

Null texts count as empty. Normalised text: upper case, every character but letters, numbers and underscore to a space, runs of
white space to one space, none at the ends. NFKC has no built-in; `nfkc=True` runs an Arrow function over rows that hold a non-ASCII character.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
#: Line ends as str.splitlines has them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def to_nfkc(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfkc(c)).otherwise(c)


def let(value: Column, f) -> Column:
    """f(value) with value computed once, though f, or a lambda in it, names it often."""
    return F.element_at(F.transform(F.array(value), f), 1)


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalize_text(c: Column | str, nfkc: bool = False) -> Column:
    c = to_nfkc(text(c)) if nfkc else text(c)
    return squeeze(F.regexp_replace(F.upper(c), NOT_WORD, " "))


def compact_text(c: Column | str, nfkc: bool = False) -> Column:
    """The normalised text's A-Z and 0-9 only."""
    c = to_nfkc(text(c)) if nfkc else text(c)
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def normalized_equal(a: Column | str, b: Column | str) -> Column:
    return normalize_text(a) == normalize_text(b)


def split_words(c: Column) -> Column:
    """Words between single spaces; none for the empty text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def tokens(c: Column | str) -> Column:
    """Distinct normalised words."""
    return F.array_distinct(split_words(normalize_text(c)))


def char_ngrams(c: Column | str, n: int = 3) -> Column:
    """N-grams of the compact text, repeats included; a shorter one is its own, the empty text has none."""

    def grams(s: Column) -> Column:
        size = F.length(s)
        found = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))
        return F.when(size == 0, F.array().cast("array<string>")).otherwise(found)

    return let(compact_text(c), grams)


def rate(distance: Column, reference: Column, other: Column) -> Column:
    """distance / length of the reference; without a reference 1.0 if there is anything else, else 0.0."""
    return F.when(reference == 0, F.when(other > 0, 1.0).otherwise(0.0)).otherwise(distance / F.greatest(reference, F.lit(1)))


def character_error_rate(expected: Column | str, predicted: Column | str) -> Column:
    both = F.struct(normalize_text(expected).alias("e"), normalize_text(predicted).alias("p"))
    return let(both, lambda s: rate(F.levenshtein(s["e"], s["p"]), F.length(s["e"]), F.length(s["p"])))


def normalized_edit_distance(expected: Column | str, predicted: Column | str) -> Column:
    """On compact texts."""
    both = F.struct(compact_text(expected).alias("e"), compact_text(predicted).alias("p"))
    return let(both, lambda s: rate(F.levenshtein(s["e"], s["p"]), F.length(s["e"]), F.length(s["p"])))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: one row of the table at a time, by nested aggregates."""
    m = F.size(b)
    first = F.when(m == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), m))

    def row(prev: Column, word: Column) -> Column:
        start = F.array(F.element_at(prev, 1) + 1)

        def cell(acc: Column, j: Column) -> Column:
            swap = F.element_at(prev, j) + F.when(F.element_at(b, j) == word, 0).otherwise(1)
            return F.concat(acc, F.array(F.least(F.element_at(prev, j + 1) + 1, F.element_at(acc, -1) + 1, swap)))

        return F.when(m == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), start, cell))

    return F.element_at(F.aggregate(a, first, row), -1)


def word_error_rate(expected: Column | str, predicted: Column | str) -> Column:
    both = F.struct(split_words(normalize_text(expected)).alias("e"), split_words(normalize_text(predicted)).alias("p"))
    return let(both, lambda s: rate(token_distance(s["e"], s["p"]), F.size(s["e"]), F.size(s["p"])))


def lines(c: Column | str) -> Column:
    """Lines as str.splitlines has them: no empty one after a last line end."""
    t = text(c)
    parts = F.split(t, LINE_END, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


@F.arrow_udf(T.StringType())
def title_case(texts: pa.Array) -> pa.Array:
    """str.title() of the first 1000 characters: the input casing of the entity model."""
    return pa.array([None if t is None else t.title()[:1000] for t in texts.to_pylist()], pa.string())
