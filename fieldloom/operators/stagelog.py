"""Analytics over the logs of image stages: merges, sizes, bins, samples, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consolidate(load: DataFrame, resize: DataFrame, contrast: DataFrame) -> DataFrame:
    """One row per file over all three logs, whichever has it; pipeline_status is failed if any stage did not say ok."""
    named = [df.withColumnsRenamed({"status": f"{s}_status", "reason": f"{s}_reason"}) for s, df in (("load", load), ("resize", resize), ("contrast", contrast))]
    out = named[0].join(named[1], "filename", "full_outer").join(named[2], "filename", "full_outer")
    ok = F.lit(True)
    for s in ("load", "resize", "contrast"):
        ok = ok & (F.coalesce(f"{s}_status", F.lit("missing")) == "ok")
    return out.withColumn("pipeline_status", F.when(ok, "ok").otherwise("failed"))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def resized(width: Column, height: Column, cap: int = 1800, low: int = 300) -> Column:
    """struct(width, height, long_side, downscaled, very_low_res): the longer side at most cap, never larger than it was."""
    long_side = F.greatest(width, height)
    scale = F.least(F.lit(1.0), F.lit(float(cap)) / F.greatest(long_side, F.lit(1)))
    w, h = F.greatest(half_even(width * scale), F.lit(1)), F.greatest(half_even(height * scale), F.lit(1))
    return F.struct(w.alias("width"), h.alias("height"), F.greatest(w, h).alias("long_side"), (long_side > cap).alias("downscaled"), (long_side < low).alias("very_low_res"))


def order_statistics(rows: DataFrame, wanted: dict[str, list[int]], buckets: int = 4096) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of numeric columns, nulls and NaN left out, exactly.

    Each round counts, in one aggregate without a shuffle of values, equal-width buckets between the ends that enclose each rank, and keeps the
    bucket that holds it. What comes back is `buckets` rows a bracket at most, whatever the size or shape of the table.
    """
    clean = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in wanted])
    ends = clean.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(wanted) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    open_ = {(c, r): (ends[f"lo_{i}"], ends[f"hi_{i}"], 0) for i, (c, ranks) in enumerate(wanted.items()) for r in ranks}
    out: dict[tuple[str, int], float] = {}
    while open_:
        out |= {k: lo for k, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {k: v for k, v in open_.items() if k not in out}
        brackets = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        if not brackets:
            break
        cells = [
            F.when(F.col(c).between(lo, hi), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col(c) - lo) / ((hi - lo) / buckets)), F.lit(buckets - 1)).alias("b"), F.col(c).alias("v")))
            for i, (c, lo, hi) in enumerate(brackets)
        ]
        counts = clean.select(F.explode(F.array(*cells)).alias("s")).filter("s is not null").groupBy("s.i", "s.b").agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("lo"), F.max("s.v").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["i"], r["b"])):
            by.setdefault(r["i"], []).append(r)
        for (c, rank), (lo, hi, below) in open_.items():
            for r in by[brackets.index((c, lo, hi))]:
                if rank < below + r["n"]:
                    open_[c, rank] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
    return out


def quantiles(rows: DataFrame, columns: list[str], probs: tuple[float, ...]) -> dict[tuple[str, float], float | None]:
    """Exact quantiles with linear interpolation between neighbouring values; None for a column without values."""
    present = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    n = rows.agg(*[present(c).alias(c) for c in columns]).first()
    wanted = {c: sorted({r for p in probs for r in (math.floor((n[c] - 1) * p), math.ceil((n[c] - 1) * p))}) for c in columns if n[c]}
    at = order_statistics(rows, wanted) if wanted else {}
    out: dict[tuple[str, float], float | None] = {}
    for c in columns:
        for p in probs:
            place = (n[c] - 1) * p
            low, high = math.floor(place), math.ceil(place)
            out[c, p] = at[c, low] + (at[c, high] - at[c, low]) * (place - low) if n[c] else None
    return out


def halves(rows: DataFrame, by: str, small: str = "small", large: str = "large", label: str = "bin") -> DataFrame:
    """Two quantile bins, closed on the right, so equal values never part."""
    cut = quantiles(rows, [by], (0.5,))[by, 0.5]
    return rows.withColumn(label, F.when(F.col(by) <= F.lit(cut).cast("double"), small).otherwise(large))


def histogram(rows: DataFrame, by: str, bins: int = 30) -> DataFrame:
    """bin (1-based), lo, hi, n over equal widths; the last bin is closed."""
    ends = rows.agg(F.min(by).alias("__lo"), F.max(by).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(F.col("__hi") == F.col("__lo"), 1).otherwise(F.least(F.floor((F.col(by) - F.col("__lo")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins)))
    out = rows.filter(F.col(by).isNotNull()).crossJoin(F.broadcast(ends)).select(at.cast("int").alias("bin"), "__lo", width.alias("__w"))
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("__lo") + (F.col("bin") - 1) * F.col("__w")).alias("lo"), F.first(F.col("__lo") + F.col("bin") * F.col("__w")).alias("hi"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, quartiles, max; quartiles are exact. One row a column, made on the driver from bounded counts."""
    q = quantiles(rows, columns, (0.25, 0.5, 0.75))
    stats = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            *[F.lit(q[c, p]).cast("double").alias(f"q{p * 100:.0f}") for p in (0.25, 0.5, 0.75)], F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of the key: the same rows on any cluster."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keys in the order of their first appearance, with its place as first_at."""
    return rows.groupBy(key).agg(F.min(order).alias("first_at")).orderBy("first_at")


def means(rows: DataFrame, by: list[str], averages: dict[str, str], flags: dict[str, Column], distinct: dict[str, str]) -> DataFrame:
    """Per group: means of columns, numbers of rows where a flag holds (null: no), numbers of distinct values."""
    return rows.groupBy(*by).agg(
        *[F.avg(c).alias(n) for n, c in averages.items()], *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()], *[F.count_distinct(c).alias(n) for n, c in distinct.items()]
    )


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. A minimum per key, combined before the shuffle, so a key with a third of all rows is no hot task."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def spot_check(logged: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Whether each logged value is the actual one."""
    a = actual.select(key, *[F.col(c).alias(f"actual_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"actual_{c}"))
    return logged.join(a, key, "left").withColumn("matches", same)


def clip_risk(contrast: DataFrame, at: float = 0.10) -> DataFrame:
    return contrast.filter((F.col("final_l_clip_low_ratio") >= at) | (F.col("final_l_clip_high_ratio") >= at))


def review(consolidated: DataFrame) -> DataFrame:
    """One row of counts and means."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return consolidated.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("pipeline_status") == "ok").alias("ok"), flag("downscaled").alias("downscaled"), flag("very_low_res").alias("very_low_res"),
        F.avg("original_brightness_mean").alias("brightness_before"), F.avg("final_brightness_mean").alias("brightness_after"),
    )


def hold(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """rows, raising where a condition doesn't hold."""
    return rows.filter(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
