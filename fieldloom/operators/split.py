"""Identity-disjoint train/val/test split.

Identities go, the largest first, where most rows are missing; those over the cap and a few with an address stay in train. What each split
gets depends on how many identities there are of each size, not on who they are: so the driver folds over counts (one number for each size up
to the cap), and identities take their places by rank in a seeded order, found without sorting all of them in one task.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SPLITS = ("train", "val", "test")


def identity(name: str = "name", birth_date: str = "birth_date"):
    return F.concat_ws("\x1f", name, birth_date)


def identities(records: DataFrame, position: str) -> DataFrame:
    """identity, n, has_address, first_at: one row per identity."""
    rows = records.withColumn("identity", identity())
    return rows.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("address") != "").alias("has_address"), F.min(position).alias("first_at"))


def check(ratios: tuple[float, float, float], cap: int, reserve: int) -> None:
    if len(ratios) != 3 or min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-8 or cap < 1 or reserve < 0:
        raise ValueError("ratios are three positive shares of 1; the cap is positive, the reserve not negative")


def assign(groups: list[tuple[str, int, bool]], ratios: tuple[float, float, float], cap: int, reserve: int) -> dict[str, str]:
    """groups in shuffled order. The first `reserve` ones with an address stay in train, as do those over the cap; others go, the largest first, where most is missing."""
    reserved = {g[0] for g in [g for g in groups if g[2]][:reserve]}
    target = [r * sum(g[1] for g in groups) for r in ratios]
    got, out = [0, 0, 0], {}
    for key, n, _ in sorted(groups, key=lambda g: -g[1]):
        options = (0,) if key in reserved or n > cap else (0, 1, 2)
        best = min(options, key=lambda i: got[i] - target[i])
        got[best] += n
        out[key] = SPLITS[best]
    return out


def fold_counts(free: dict[int, int], got: list[int], target: list[float]) -> dict[int, list[int]]:
    """How many identities of each size go to each split, as if each went where most is missing, the largest first. got is brought up to date.

    Each step is one identity in `assign`; here as many as fit before the order of what is missing changes go at once.
    """
    out = {}
    for size in sorted(free, reverse=True):
        left, counts = free[size], [0, 0, 0]
        while left:
            lack = [g - t for g, t in zip(got, target, strict=True)]
            best = min(range(3), key=lambda i: lack[i])
            rival = min(lack[i] for i in range(3) if i != best)
            run = min(left, max(1, math.floor((rival - lack[best]) / size)))
            counts[best] += run
            got[best] += run * size
            left -= run
            if left > 100 and max(lack) - min(lack) <= size:  # level: the three take turns, which leaves who is next as it is
                turns = left // 3 - 3
                for i in range(3):
                    counts[i] += turns
                    got[i] += turns * size
                left -= 3 * turns
        out[size] = counts
    return out


BUCKETS = 4096


def group_split(records: DataFrame, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), max_rows_per_identity_in_eval: int = 2, min_train_address_identities: int = 15, shuffle: str = "hash", position: str = "filename") -> DataFrame:
    """records with a split column, sorted by nothing; write_splits sorts. An empty table raises.

    shuffle: 'hash', an order by md5 of identity and seed, on any cluster and at any size; or 'mt19937', Python's own shuffle over identities in
    order of position, which needs all of them on the driver: for sets of some thousand people whose published split is to be had again.
    """
    check(ratios, max_rows_per_identity_in_eval, min_train_address_identities)
    cap, reserve = max_rows_per_identity_in_eval, min_train_address_identities
    if records.isEmpty():
        raise ValueError("no records to split")
    ids = identities(records, position)
    if shuffle != "hash":
        rows = ids.orderBy("first_at", "identity").collect()
        random.Random(seed).shuffle(rows)
        made = assign([(r["identity"], r["n"], r["has_address"]) for r in rows], ratios, cap, reserve)
        table = records.sparkSession.createDataFrame(list(made.items()), T.StructType([T.StructField("identity", T.StringType()), T.StructField("split", T.StringType())]))
        return records.withColumn("identity", identity()).join(table, "identity").drop("identity")
    ids = ids.select("identity", "n", "has_address", F.md5(F.concat_ws("\x1f", "identity", F.lit(str(seed)))).alias("key"))
    reserved = [r["identity"] for r in ids.filter("has_address").orderBy("key", "identity").limit(reserve).select("identity").collect()]
    fixed = (F.col("n") > cap) | F.col("identity").isin(reserved)
    bucket = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    ids = ids.select("identity", "n", "key", fixed.alias("fixed"), F.when(~fixed, bucket).alias("bucket"))
    # one row for each size up to the cap and bucket, and one for all that stay in train
    counts = ids.groupBy("fixed", F.when(~F.col("fixed"), F.col("n")).alias("size"), "bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).collect()
    total = sum(r["rows"] for r in counts)
    got = [sum(r["rows"] for r in counts if r["fixed"]), 0, 0]
    free: dict[int, int] = {}
    for r in counts:
        if not r["fixed"]:
            free[r["size"]] = free.get(r["size"], 0) + r["k"]
    places = fold_counts(free, got, [r * total for r in ratios])
    offsets, seen = [], dict.fromkeys(free, 0)
    for r in sorted((r for r in counts if not r["fixed"]), key=lambda r: (r["size"], r["bucket"])):
        offsets.append((r["size"], r["bucket"], seen[r["size"]], *[sum(places[r["size"]][: i + 1]) for i in range(2)]))
        seen[r["size"]] += r["k"]
    table = records.sparkSession.createDataFrame(offsets, "size long, at int, before long, train long, val long")
    mine = F.broadcast(table)  # sizes up to the cap, times BUCKETS
    ranked = ids.join(mine, (ids["n"] == mine["size"]) & (ids["bucket"] == mine["at"]), "left")
    rank = F.col("before") + F.row_number().over(W.partitionBy("size", "bucket", "fixed").orderBy("key", "identity")) - 1
    rest = ranked.filter("not fixed").withColumn("rank", rank)
    chosen = rest.select("identity", F.when(F.col("rank") < F.col("train"), "train").when(F.col("rank") < F.col("val"), "val").otherwise("test").alias("split"))
    whole = chosen.unionByName(ids.filter("fixed").select("identity", F.lit("train").alias("split")))
    return records.withColumn("identity", identity()).join(whole, "identity").drop("identity")
