"""SimHash near-duplicates by multi-index hashing.

A text's ASCII letters are lower-cased; its words are runs free of ASCII white space; each run of `shingle` words (repeats
included; the whole sequence if shorter) is hashed by XXH64 with seed 42. A fingerprint bit is 1 if it is set in over
half of the hashes. Fingerprints at `radius` = 3 or fewer differing bits link, and links are followed to components.

Linking. The 64 bits form two 32-bit segments. If two fingerprints differ in at most three bits, one of the
segments differs in at most one, so each fingerprint looks up the Hamming ball of radius 1 of each segment in the
table of segments and verifies whole distances in the join's condition. Of two segments that differ in one bit, one has
a zero there: only zero bits are flipped, which halves the look-ups and loses no pair. Copies are one row of this table, however many
there are; values of a segment that very many fingerprints share are looked up with a byte of the other segment. Before any shuffle of links each task reduces its own to a spanning forest.

Nulls: null or wordless texts have fingerprint zero and link like any other. A null doc_id takes part in links but is no
component id; a component without any id has a null one. Repeated rows give equal rows. A bit set in exactly half of the hashes is 0. An
empty table gives an empty result. Very long texts are hashed whole. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stash

SEED = 42


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    return majority(hashes)


@F.arrow_udf(T.LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's links (a, b), as (b, root): as many rows as nodes at most, however many links there are."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    links = [(x, root(x)) for x in list(up) if up[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], names=["a", "b"])


def hamming_links(prints: DataFrame, radius: int = 3, crowd: int = 1000) -> DataFrame:
    """prints: distinct column fp. Pairs (a, b) whose fingerprints differ in at most radius bits, thinned to forests that connect the same.

    A segment's value that over `crowd` fingerprints share is looked up together with each byte of the other segment: that one differs in at
    most three bits, so one of its four bytes is equal. Such values number under 2 / crowd of the fingerprints; they are counted, and go to every
    task up to 100,000 of them, else by a join.
    """
    if radius > 3:
        raise ValueError("two segments with balls of radius 1 find pairs at 3 or fewer bits only")
    low = F.lit(0xFFFFFFFF)
    right, left = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32)
    segments = F.array(F.struct(F.lit(0).alias("seg"), right.alias("v"), left.alias("w")), F.struct(F.lit(1).alias("seg"), left.alias("v"), right.alias("w")))
    table = prints.select("fp", F.explode(segments).alias("s")).select("fp", "s.*")
    flips = F.array(*[F.lit(1 << i) for i in range(32)])
    ball = F.concat(F.array(F.lit(0)), F.filter(flips, lambda m: F.col("v").bitwiseAND(m) == 0))
    probes = table.select("fp", "seg", "w", F.explode(ball).alias("m"), "v").select("fp", "seg", "w", F.col("v").bitwiseXOR(F.col("m")).alias("v"))
    crowds = stash(table.groupBy("seg", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("seg", "v", F.lit(True).alias("crowded")), "crowds")
    if crowds.limit(100_001).count() <= 100_000:
        crowds = F.broadcast(crowds)
    bytes_ = F.array(*[F.shiftright("w", 8 * i).bitwiseAND(F.lit(255)) + 256 * i for i in range(4)])

    def placed(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.join(crowds, ["seg", "v"], "left")
        return rows.select(F.col("fp").alias(name), "seg", "v", F.explode(F.when(F.col("crowded"), bytes_).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"))

    # sizes after an explode are guessed too low: the hint keeps the table from being broadcast
    found = placed(probes, "a").join(placed(table, "b").hint("merge"), ["seg", "v", "part"]).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return found.select("a", "b").mapInArrow(forest, "a long, b long")


def _print(edges: DataFrame) -> tuple:
    """Count and two sums of hashes, which tell two sets of edges apart in one small aggregate."""
    wide = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    return tuple(edges.agg(F.count(F.lit(1)), *wide).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each written to the shared folder. A star step is
    a minimum per node, combined before its shuffle, and an equi-join whose hot keys adaptive execution splits.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    print_ = _print(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = stash(small.filter("u > v").distinct(), "links")
        print_, before = _print(after), print_
        discard(edges)
        edges = after
        if print_ == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id for every document."""
    prints = stash(docs.select("doc_id", fingerprint_of("text").alias("fp")), "fingerprints")
    reps = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    member = stash(components(hamming_links(reps.select("fp"), radius)), "components")
    smallest = member.join(reps, member.node == reps.fp).groupBy("component").agg(F.min("rep").alias("least"))
    linked = member.join(smallest, "component").select(F.col("node"), "least")
    found = F.when(F.col("node").isNotNull(), F.col("least")).otherwise(F.col("rep"))
    ids = stash(reps.join(linked, reps.fp == linked.node, "left").select("fp", "n", found.alias("component_id")), "fingerprint-components")
    hot = F.broadcast(ids.filter(F.col("n") > (ids.agg(F.sum("n")).first()[0] or 0) / 1000).select("fp", "component_id"))  # under 1,000 rows at any size
    rest = prints.join(hot, "fp", "left_anti").join(ids.select("fp", "component_id"), "fp")
    return prints.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def hex_of(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
