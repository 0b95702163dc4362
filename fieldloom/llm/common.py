"""What the corpus operators share: intermediate tables, folds, bounded samples."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, shared_dir, stash

__all__ = ["ASCII_SPACE", "bounded_sample", "char_class", "discard", "fold", "shared_dir", "spread", "stash", "text_key"]

ASCII_SPACE = " \t\n\x0b\x0c\r"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text (0)."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % parts


def text_key(text: str | Column) -> list[Column]:
    """128 bits that stand for a text."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(whole).alias("__k1"), F.xxhash64(F.lit(1), whole).alias("__k2")]


def spread(*cols: Column) -> Column:
    """A value in [0, 1) that depends on cols only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, strata: Column, per_stratum: int, by: list[Column]) -> DataFrame:
    """About per_stratum rows of each stratum, chosen by a hash of `by`.

    One pass counts the strata (partial aggregates only), a second keeps rows under each stratum's threshold, so no
    stratum is gathered in one task. Strata beyond the 500 largest share the smallest of their rates.
    """
    counts = rows.groupBy(strata.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").limit(500).collect()
    if not counts:
        return rows.limit(0)
    rate = F.lit(min(1.0, per_stratum / counts[-1]["n"]) if len(counts) == 500 else 0.0)
    for r in counts:
        rate = F.when(strata.eqNullSafe(F.lit(r["s"])), F.lit(min(1.0, per_stratum / r["n"]))).otherwise(rate)
    return rows.filter(spread(*by) < rate)


def char_class(*categories: str) -> str:
    """The inside of a character class of `re` for Unicode categories, such as "L" for letters."""
    hits = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] in categories]
    cuts = [0, *(i for i in range(1, len(hits)) if hits[i] != hits[i - 1] + 1), len(hits)]
    return "".join(f"\\U{hits[a]:08x}-\\U{hits[b - 1]:08x}" for a, b in zip(cuts, cuts[1:], strict=False) if a < b)
