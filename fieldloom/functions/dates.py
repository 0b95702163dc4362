"""The first plausible calendar date in a text, as ISO text or ''."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

#: Word boundaries by letters, numbers and underscore; Java's own \b treats some numerals otherwise.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ID = BEFORE + r"(\d{2})(\d{2})(\d{2})-\d{2}-\d{4}" + AFTER
ISO = BEFORE + r"(\d{4})[.\-/](\d{2})[.\-/](\d{2})" + AFTER
WORDED = BEFORE + r"(\d{1,2})[.\- ]+([A-Z]{3,9})\.?[.\- ]+(\d{4})" + AFTER
NUMERIC = BEFORE + r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}" + AFTER


def existing(c: Column) -> Column:
    """The ISO text of a date that exists, else null. Names its input once, so what it is made of is computed once."""
    return F.regexp_replace(c, "^0000", "").try_cast("date").cast("string")


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def extract_date(c: Column | str, as_of_year: int | None = None, fix_two_digit_year: bool = False, use_id: bool = True) -> Column:
    """ID number, then ISO, then day month-name year (the first match of each), then any numeric date, day first.

    as_of_year: the year from which an ID's two digits count back (this year). A numeric two-digit year of 32 or more stays as it is
    written unless fix_two_digit_year is set. Nulls give ''. A text without digits costs one look; each pattern is matched once and its
    parts are cut out of the short match.
    """
    short = (as_of_year or datetime.date.today().year) % 100
    u = F.upper(text(c))
    found = [by_iso(F.regexp_extract(u, ISO, 0)), by_word(F.regexp_extract(u, WORDED, 0)), by_number(u, fix_two_digit_year)]
    if use_id:
        found.insert(0, by_id(F.regexp_extract(u, ID, 0), short))
    return F.when(u.rlike("[0-9]"), F.coalesce(*found, F.lit(""))).otherwise("")


def by_id(m: Column, short: int) -> Column:
    """A match of ID: two digits each of year, month and day in front."""
    century = F.when(F.substring(m, 1, 2) <= f"{short:02d}", "20").otherwise("19")
    return existing(F.concat(century, F.regexp_replace(m, r"^(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3")))


def by_iso(m: Column) -> Column:
    return existing(F.translate(m, "./", "--"))


def by_word(m: Column) -> Column:
    """Months by their first three letters; names that are none give no date."""
    short = F.regexp_replace(m, r"^(\d{1,2})[.\- ]+([A-Z]{3})[A-Z]*\.?[.\- ]+(\d{4})$", "$3-$2-$1")
    return F.try_to_timestamp(short, F.lit("yyyy-MMM-d")).cast("date").cast("string")


def by_number(u: Column, fix_two_digit_year: bool) -> Column:
    """The first numeric date that exists, day before month if both orders do."""

    def one(found: Column) -> Column:
        a, b, y = (F.element_at(F.split(found, r"[.\-/]"), i) for i in (1, 2, 3))
        n = y.try_cast("int")
        if fix_two_digit_year:
            year = F.when(F.length(y) > 2, n).when(n < 50, n + 2000).otherwise(n + 1900)
        else:
            year = F.when(n > 31, n).otherwise(n + 2000)
        year = F.lpad(year.cast("string"), 4, "0")
        return F.coalesce(existing(F.concat_ws("-", year, _two(b), _two(a))), existing(F.concat_ws("-", year, _two(a), _two(b))))

    all_ = F.regexp_extract_all(u, F.lit(NUMERIC), F.lit(0))
    return F.try_element_at(F.filter(F.transform(all_, one), lambda x: x.isNotNull()), F.lit(1))
