"""Field heuristics over text and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import AFTER, BEFORE, extract_date
from .text import compact_text, let, lines, normalize_text, split_words, squeeze, text, tokens
from .vocabulary import ADDRESS_KEYWORDS, MIN_OVERLAP, NAME_PARTICLES, STOPWORDS

POSTCODE = BEFORE + r"\p{Nd}{4,5}" + AFTER
FUZZY = [c for c in ("".join(ch for ch in s if ch.isalnum()) for s in STOPWORDS) if len(c) >= 4]


def _longest(found: Column) -> Column:
    """The longest entry, the first of equals; '' for none."""
    ranked = F.transform(found, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("x")))
    return F.coalesce(F.array_max(ranked)["x"], F.lit(""))


def normalized_lines(c: Column | str) -> Column:
    return F.transform(lines(c), lambda x: normalize_text(x))


def name_of(norm: Column) -> Column:
    """The longest of normalised lines without a digit that is no stopword."""
    return _longest(F.filter(norm, lambda x: (x != "") & ~x.isin(*STOPWORDS) & ~x.rlike(r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}-\x{2089}]")))


def extract_name(c: Column | str) -> Column:
    """The longest line without a digit that is no stopword."""
    return name_of(normalized_lines(c))


def has_keyword(upper: Column) -> Column:
    return upper.rlike("|".join(ADDRESS_KEYWORDS))


def address_of(norm: Column) -> Column:
    """The longest of normalised lines with an address keyword or a run of four or five digits."""
    return _longest(F.filter(norm, lambda x: (x != "") & (has_keyword(x) | x.rlike(POSTCODE))))


def extract_address(c: Column | str) -> Column:
    """The longest line with an address keyword or a run of four or five digits."""
    return address_of(normalized_lines(c))


def parse_fields(c: Column | str, as_of_year: int | None = None) -> Column:
    """Lines are normalised once for name and address."""
    both = let(normalized_lines(c), lambda n: F.struct(name_of(n).alias("name"), address_of(n).alias("address")))
    return F.struct(both["name"].alias("name"), extract_date(c, as_of_year).alias("birth_date"), both["address"].alias("address"))


def is_stopword(c: Column | str) -> Column:
    return normalize_text(c).isin(*STOPWORDS)


def is_boilerplate_stopword(c: Column | str) -> Column:
    """A stopword, or one edit away from one where both have four compact characters or more."""
    return is_stopword(c) | let(compact_text(c), near_stopword)


def near_stopword(key: Column | str) -> Column:
    """Whether a compact text of four characters or more is at most one edit away from a compact stopword of as many.

    The few words are literals in the expression, so no join is planned; lengths are compared first, and the distance stops at two. key is
    named often: make it a column of its own before (with_compact does).
    """
    k = F.col(key) if isinstance(key, str) else key
    n = F.length(k)
    by_length: dict[int, list[str]] = {}
    for w in FUZZY:
        for size in range(max(4, len(w) - 1), len(w) + 2):
            by_length.setdefault(size, []).append(w)
    found = F.lit(False)
    for size, ws in sorted(by_length.items(), reverse=True):
        hit = F.lit(False)
        for w in ws:
            hit = hit | (F.levenshtein(k, F.lit(w), 1) >= 0)
        found = F.when(n == size, hit).otherwise(found)
    return F.when(n.between(4, max(by_length)), found).otherwise(False)


def with_compact(rows: DataFrame, c: str = "text", name: str = "__compact") -> DataFrame:
    return rows.withColumn(name, compact_text(c))


def _end_word(c: Column | str, at: int) -> Column:
    words = split_words(squeeze(F.upper(text(c))))
    return F.coalesce(F.try_element_at(words, F.lit(at)), F.lit(""))


def ends_with_name_particle(c: Column | str) -> Column:
    return _end_word(c, -1).rlike("(" + "|".join(NAME_PARTICLES) + ")$")


def starts_with_name_particle(c: Column | str) -> Column:
    return _end_word(c, 1).rlike("^(" + "|".join(NAME_PARTICLES) + ")")


def has_name_particle(c: Column | str) -> Column:
    """Whether a word of the text is a name particle: a feature by gazetteer, beside n-grams."""
    return F.arrays_overlap(split_words(squeeze(F.upper(text(c)))), F.array(*map(F.lit, NAME_PARTICLES)))


def is_id_fragment(c: Column | str) -> Column:
    return compact_text(c).rlike("^[0-9]{6,}$")


def label_block(c: Column | str, name: Column | str, birth_date: Column | str, address: Column | str, min_overlap: float = MIN_OVERLAP, as_of_year: int | None = None) -> Column:
    """birth_date, name, address or other: a block's weak label from the expected fields."""
    own = tokens(c)
    share = lambda e: F.size(F.array_intersect(own, tokens(e))) / F.greatest(F.size(own), F.lit(1))
    seen = F.struct(extract_date(c, as_of_year).alias("date"), F.size(own).alias("n"), share(name).alias("name"), share(address).alias("address"), text(birth_date).alias("want"), squeeze(text(c)).alias("text"))
    return let(
        seen,
        lambda s: F.when(s["text"] == "", "other")
        .when((s["date"] != "") & (s["date"] == s["want"]), "birth_date")
        .when(s["n"] < 2, "other")
        .when((s["name"] >= min_overlap) & (s["name"] >= s["address"]), "name")
        .when(s["address"] >= min_overlap, "address")
        .otherwise("other"),
    )
