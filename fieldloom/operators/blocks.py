"""Block tables: from OCR reports, or from lines of any text, with geometry and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CARD = ("engine", "split", "filename")


def _corner(axis: int, pick) -> Column:
    return pick(F.transform("bbox", lambda p: F.element_at(p, axis + 1)))


def _mean(axis: int) -> Column:
    total = F.aggregate("bbox", F.lit(0.0), lambda s, p: s + F.element_at(p, axis + 1))
    return total / F.greatest(F.size("bbox"), F.lit(1))


def with_geometry(blocks: DataFrame) -> DataFrame:
    """Adds x0, x1, y0, y1 (extremes) and cx, cy (means of the polygon's points)."""
    return blocks.withColumns({"x0": _corner(0, F.array_min), "x1": _corner(0, F.array_max), "y0": _corner(1, F.array_min), "y1": _corner(1, F.array_max), "cx": _mean(0), "cy": _mean(1)})


def report_blocks(reports: DataFrame, split: str | None = None) -> DataFrame:
    """engine, split, filename, block_idx, text, bbox, confidence and geometry, one row per block; reports without blocks give none."""
    rows = reports if "split" in reports.columns else reports.withColumn("split", F.lit(split))
    out = rows.select(*CARD, F.posexplode(F.coalesce("raw.blocks", F.expr("array()"))).alias("block_idx", "b"))
    return with_geometry(out.select(*CARD, "block_idx", F.coalesce("b.text", F.lit("")).alias("text"), "b.bbox", F.coalesce("b.confidence", F.lit(0.0)).alias("confidence")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Re-numbers block_idx by smallest y, then smallest x, then source and old number."""
    source = ["source_rank"] if "source_rank" in blocks.columns else []
    w = W.partitionBy(*CARD).orderBy("y0", "x0", *source, "block_idx")
    return blocks.withColumn("block_idx", F.row_number().over(w) - 1).drop(*source)


def merge_engines(primary: DataFrame, secondary: DataFrame, engine: str = "merged") -> DataFrame:
    """The blocks of both engines for the primary's cards, in reading order. Bag union: nothing is deduplicated."""
    cards = primary.select("split", "filename").distinct()
    both = primary.withColumn("source_rank", F.lit(0)).unionByName(secondary.join(cards, ["split", "filename"], "left_semi").withColumn("source_rank", F.lit(1)))
    return reading_order(both.withColumn("engine", F.lit(engine)))


def join_frequent(rows: DataFrame, table: DataFrame, key: str, freq: str = "freq", at: float = 0.01, most: int = 100_000) -> DataFrame:
    """rows with table's freq by key, 0 where it has none. Frequent texts are hot keys of blocks by their nature.

    Texts of a freq of `at` or more are counted; up to `most` of them go to every task. The others can stand in less than that share of
    the identities and are joined by a shuffle, in which rows that have their frequency go spread, by a key of their own.
    """
    hot = table.filter(F.col(freq) >= at).select(F.col(key).alias("__hot"), F.col(freq).alias("__f"))
    if hot.limit(most + 1).count() > most:
        return rows.join(table.select(key, freq), key, "left").na.fill(0.0, [freq])
    cold = table.filter(F.col(freq) < at).select(F.col(key).alias("__cold"), F.col(freq).alias("__g"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    aside = F.concat(F.lit("\0"), F.md5(F.to_json(F.struct(*[c for c in rows.columns if c in (*CARD, "block_idx", "doc_id")]))))
    out = out.withColumn("__key", F.when(F.col("__f").isNotNull(), aside).otherwise(F.col(key))).join(cold, F.col("__key") == F.col("__cold"), "left")
    return out.withColumn(freq, F.coalesce("__f", "__g", F.lit(0.0))).drop("__hot", "__f", "__key", "__cold", "__g")


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a text table as blocks: 12 points apart with a gap before every fifth, 6 points a character."""
    out = docs.select(key, *extra, F.posexplode(F.split(text, "\n")).alias("block_idx", "text"))
    y0 = (F.col("block_idx") * 12 + F.floor(F.col("block_idx") / 5) * 40).cast("double")
    return out.withColumns({"x0": F.lit(0.0), "x1": (F.length("text") * 6).cast("double"), "y0": y0, "y1": y0 + 10.0})


def best_runs(blocks: DataFrame, expected: Column, score, longest: int = 2, card: tuple[str, ...] = CARD) -> DataFrame:
    """The least score per card over runs of one to `longest` neighbouring blocks: what a perfect choice of blocks could reach."""
    w = W.partitionBy(*card).orderBy("block_idx")
    runs = [F.concat_ws(" ", "text", *[F.lead("text", k).over(w) for k in range(1, n)]) for n in range(1, longest + 1)]
    scored = blocks.withColumn("runs", F.array(*runs)).withColumn("score", F.array_min(F.transform("runs", lambda r: score(expected, r))))
    return scored.groupBy(*card).agg(F.min("score").alias("best"))


def coverage(blocks: DataFrame, tokens_of, expected: Column, card: tuple[str, ...] = CARD) -> DataFrame:
    """The share of the expected value's distinct words that stand in some block of the card."""
    have = blocks.groupBy(*card).agg(F.array_distinct(F.flatten(F.collect_list(tokens_of("text")))).alias("have"), F.first(expected).alias("want"))
    want = tokens_of("want")
    return have.select(*card, F.when(F.size(want) == 0, None).otherwise(F.size(F.array_intersect(want, "have")) / F.greatest(F.size(want), F.lit(1))).alias("covered"))
