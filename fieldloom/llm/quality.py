"""Quality rules with thresholds that adapt to each language and source.

Base figures of each text come first. Each derived rate is an integer per mille; its log-linear bin (256 exact bins, then 128 bins to
every power of two, so a bin is at most 1/128 wide relative to its value) is counted per (lang, source) over the documents that pass the
base rule. Those counts are the quantile sketch: they merge by addition, are the same in any order of merging and any partitioning, and
have a few hundred bins at most. No cutoff is fixed: a group's limits for a rate are its quartiles and a number of interquartile ranges (RATES)
beyond them. A group in which a rate hardly varies (most have no repeated line at all) would have limits at its one value; there an
interquartile range counts as at least the rate's least one.

Small groups: one under `min_group` documents uses the merged sketch of its language, or of the whole corpus if that is smaller, too.

Nulls: a null text has no words and fails the base rule; null lang and null source are groups of their own. Texts
without words have rates of zero. Repeated rows are judged each by itself. An empty table gives an empty result. Very long texts are
counted whole. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import ASCII_SPACE, stash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MARKS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in b" \t\n\x0b\x0c\r")
BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_marks")])
ARROW = pa.struct([(f.name, pa.int64()) for f in BASE.fields])
#: Rates in per mille: interquartile ranges up to the upper limit, those down to the lower one (None: it has none), the least range.
RATES = {"mark_rate": (10, None, 1), "dup_line_rate": (4, None, 100), "repeat_rate": (4, None, 100), "shout_rate": (4, None, 20), "length_rate": (4, 4, 1)}


def base_figures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then lines with a word, upper-case words over three characters, ASCII marks and digits."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    shouted = sum(1 for w in WORD.findall(text) if len(w) > 3 and w.isupper())
    return n, chars, symbols, len(lines) - len(set(lines)), covered, len(lines), shouted, len(raw) - len(raw.translate(None, MARKS))


@F.arrow_udf(BASE)
def figures(texts: pa.Array) -> pa.Array:
    rows = [base_figures(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(BASE.fields))], fields=list(ARROW))


def with_rates(base: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return base.withColumns(
        {
            "base_failed": failed,
            "mark_rate": F.expr("1000 * n_marks div greatest(word_chars, 1)"),
            "dup_line_rate": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
            "repeat_rate": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
            "shout_rate": F.expr("1000 * n_shouted div greatest(n_words, 1)"),
            "length_rate": F.expr("1000 * word_chars div greatest(n_words, 1)"),
        }
    )


def bin_of(v: Column) -> Column:
    """Values below 256 have bins of their own; above, the value with all but its eight leading bits set to zero."""
    drop = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketch(rates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, bin, n: partial counts before the shuffle, so a hot group sends a few rows from each task."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bin_of(F.col(r)).alias("bin")) for r in RATES])).alias("p")
    return rates.select(*keys, pairs).groupBy(*keys, "p.rate", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of the union of groups: counts of equal bins add up."""
    return sketches.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, size, low, high. A window holds one group's bins only."""
    by = [*keys, "rate"]
    cum = sketches.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("size", F.sum("n").over(W.partitionBy(*by)))
    q = cum.groupBy(*by).agg(
        F.max("size").alias("size"),
        F.min(F.when(F.col("upto") * 4 >= F.col("size"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("size") * 3, F.col("bin"))).alias("q3"),
    )
    up, down, least = (F.create_map(*[F.lit(x).cast("long") if i else F.lit(x) for r, v in RATES.items() for i, x in enumerate((r, v[k]))])[F.col("rate")] for k in range(3))
    spread = F.greatest(F.col("q3") - F.col("q1"), least)
    return q.select(*by, "size", (F.col("q1") - down * spread).alias("low"), (F.col("q3") + up * spread).alias("high"))


def thresholds(rates: DataFrame, min_group: int = 100) -> DataFrame:
    """One row per (lang, source) with limits for each rate: `<rate>_low` and `<rate>_high`."""
    fine = stash(sketch(rates.filter(~F.col("base_failed")), ["lang", "source"]), "quality-sketch")
    lang = limits(merge(fine, ["lang"]), ["lang"])
    whole = limits(merge(fine, []), [])
    own = limits(fine, ["lang", "source"]).select("lang", "source", "rate", "size", F.struct("low", "high").alias("own"))
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"), F.col("size").alias("l_size"), F.struct("low", "high").alias("of_lang"))
    whole = whole.select(F.col("rate").alias("w_rate"), F.struct("low", "high").alias("of_all"))
    picked = own.join(lang, own.lang.eqNullSafe(F.col("l_lang")) & (own.rate == F.col("l_rate"))).join(whole, F.col("rate") == F.col("w_rate"))
    limit = F.when(F.col("size") >= min_group, F.col("own")).when(F.col("l_size") >= min_group, F.col("of_lang")).otherwise(F.col("of_all"))
    picked = picked.select("lang", "source", "rate", limit.alias("limit"))
    return picked.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, F.col(f"limit.{end}"))).alias(f"{r}_{end}") for r in RATES for end in ("low", "high")])


def quality(docs: DataFrame, min_group: int = 100) -> DataFrame:
    """One row per document: base figures, rates, the group's limits, base_failed, kept."""
    base = docs.select("doc_id", "lang", "source", figures("text").alias("f")).select("doc_id", "lang", "source", "f.*")
    rates = stash(with_rates(base), "quality-rates")
    lim = thresholds(rates, min_group).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    out = rates.join(lim, rates.lang.eqNullSafe(lim.t_lang) & rates.source.eqNullSafe(lim.t_source), "left").drop("t_lang", "t_source")
    over = F.lit(False)
    for r in RATES:
        over = over | F.coalesce(F.col(r) > F.col(f"{r}_high"), F.lit(False)) | F.coalesce(F.col(r) < F.col(f"{r}_low"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~over)
