"""Removal of lines that many documents share, through sharded minimal perfect hashes.

A text is split at line feeds (null or empty: one empty line). A line's key is the line without ASCII white space at both ends,
A-Z lower-cased, and stands as its 128-bit XXH3. Keys of one or more code points found in at least `min_docs` documents
lose all their lines; the other lines stay as they are, joined by line feeds.

1. Each task lists the distinct keys of its documents; a partial aggregate counts documents per key.
2. The distinct keys are dealt to shards of about `shard_keys` keys. A shard becomes one row of three compact arrays: a minimal
   perfect hash (a cascade of bit arrays: a key takes the first level where no other key of the shard has its bit), the keys' 32-bit
   fingerprints, and their document counts.
3. Documents' keys probe the shard that owns them; only hits come back. A shard is probed by about `shard_rows` rows at any size of
   corpus: there are enough shards for that, and keys of many documents don't take this way. They are known to be lost: keys with over
   1/10,000 of all probes, or over `shard_rows`. They are counted, and go to every task if there are 200,000 (3 MB) or fewer, else
   by a join whose hot keys adaptive execution splits.
4. Each document meets the keys it loses, and drops its lines.

Documents are rows: two rows with one doc_id count twice. A null doc_id is handled like any other. Repeated rows give
repeated results. Ties: a key found in exactly min_docs documents is lost. An empty table gives an empty result. Very long texts are split
whole. All columns of docs are kept in a struct, so that their names may be any.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash

STRIP = b" \t\n\x0b\x0c\r"
U64 = np.uint64


def line_key(line: bytes) -> bytes | None:
    """The 16-byte key of a line, or None where nothing is left of it."""
    key = line.strip(STRIP).lower()
    return xxhash.xxh3_128_digest(key) if key else None


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A hash of each key (a, b) for a level of the cascade."""
    x = a + b * U64(2 * level + 1) + U64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class PerfectHash:
    """Distinct keys (a, b) to 0..n-1; about 3.7 bits a key. Keys outside the set give any slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(ones - 1 + base)
            base += int(ones[-1])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels, level = [], 0
        while len(a):
            size = max(64, 2 * len(a))
            at = (_mix(a, b, level) % U64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = ~bits[at]
            a, b, level = a[left], b[left], level + 1
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, bits in enumerate(self.levels):
            at = (_mix(a[open_], b[open_], level) % U64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, n, 8)
        at, levels = 8 * (n + 1), []
        for size in map(int, sizes):
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels)


SHARD = "shard long, hash binary, prints binary, counts binary"


def build_shard(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    made = PerfectHash.build(a, b)
    at = made.slots(a, b)
    prints, counts = np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
    prints[at], counts[at] = (b >> U64(32)).astype(np.uint32), n
    return made.dump(), prints.tobytes(), counts.tobytes()


def probe_shard(shard: tuple[bytes, bytes, bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The keys' document counts; 0 for keys that the shard doesn't have."""
    hash_, prints, counts = PerfectHash.load(shard[0]), np.frombuffer(shard[1], np.uint32), np.frombuffer(shard[2], np.int64)
    if not len(prints):
        return np.zeros(len(a), np.int64)
    at = hash_.slots(a, b)
    return np.where((at >= 0) & (prints[at] == (b >> U64(32)).astype(np.uint32)), counts[at], 0)


def _shard_of_group(key: tuple, table: pa.Table) -> pa.Table:
    a, b, n = (table[c].to_numpy() for c in ("a", "b", "n"))
    blobs = build_shard(a.view(U64), b.view(U64), n)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in zip(("hash", "prints", "counts"), blobs, strict=True)})


def _probe(min_docs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(probes: pa.Table, shards: pa.Table) -> pa.Table:
        if not len(probes) or not len(shards):
            return probes.select(["way", "a", "b"]).slice(0, 0)
        a, b = (probes[c].to_numpy().view(U64) for c in ("a", "b"))
        counts = probe_shard(tuple(shards[c][0].as_py() for c in ("hash", "prints", "counts")), a, b)
        return probes.select(["way", "a", "b"]).filter(pa.array(counts >= min_docs))

    return run


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """way, text -> way, a, b for each distinct key of each text."""
    for batch in batches:
        ways, digests = [], []
        for way, text in zip(batch.column("way").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = set(map(line_key, split_lines(text)))
            found.discard(None)
            ways += [way] * len(found)
            digests += found
        pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ways, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["way", "a", "b"])


def strip_lines(text: str | None, lost: set[bytes]) -> tuple[str, int, int]:
    """The text without lines whose keys are in lost, lines before, lines dropped."""
    lines = split_lines(text)
    kept = [x for x in lines if line_key(x) not in lost] if lost else lines
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("sha256", T.StringType())])


@F.arrow_udf(KEPT)
def without_lines(texts: pa.Array, lost: pa.Array) -> pa.Array:
    rows = []
    for text, gone in zip(texts.to_pylist(), lost.to_pylist(), strict=True):
        kept, n, dropped = strip_lines(text, {struct.pack("=qq", k["a"], k["b"]) for k in gone or ()})
        rows.append((kept, n, dropped, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.name for f in KEPT.fields])


def common_keys(keys: DataFrame, min_docs: int, shard_keys: int, shard_rows: int, most_sent: int = 200_000) -> DataFrame:
    """keys (way, a, b), a row for each document and key: those rows whose key has min_docs documents or more."""
    counts = stash(keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "line-counts")
    zero = F.lit(0).cast("long")
    hot = F.when(F.col("n") > max(shard_rows, min_docs), 1)
    total = counts.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), zero).alias("probes"), F.count(hot).alias("hot")).first()
    heavy_from = min(max(total["probes"] // 10_000, min_docs, 1), max(shard_rows, min_docs))
    heavy = counts.filter(F.col("n") > heavy_from).select("a", "b")
    if heavy_from < shard_rows or total["hot"] <= most_sent:  # 10,000 rows at most, or counted
        heavy = F.broadcast(heavy)
    shards = max(1, -(-total["keys"] // shard_keys), -(-total["probes"] // shard_rows))
    shard = F.pmod(F.xxhash64("a", "b"), F.lit(shards)).alias("shard")
    light = counts.filter(F.col("n") <= heavy_from)
    arrays = stash(light.select("a", "b", "n", shard).groupBy("shard").applyInArrow(_shard_of_group, SHARD), "line-shards")
    rest = keys.join(heavy, ["a", "b"], "left_anti").select("way", "a", "b", shard)
    hits = rest.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(_probe(min_docs), "way long, a long, b long")
    return hits.unionByName(keys.join(heavy, ["a", "b"], "left_semi").select("way", "a", "b"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, shard_keys: int = 8192, shard_rows: int = 250_000) -> DataFrame:
    """`row`: a struct of docs' columns as they are, and `kept`: struct(text, n_lines, n_dropped, sha256) of what stays.

    `way` only brings lost keys to their rows: rows that share one get the union, which is right, as a lost key is lost everywhere.
    """
    way = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    keys = stash(docs.select(way.alias("way"), "text").mapInArrow(_keys_of, "way long, a long, b long"), "line-keys")
    hits = common_keys(keys, min_docs, shard_keys, shard_rows)
    lost = hits.distinct().groupBy("way").agg(F.collect_set(F.struct("a", "b")).alias("lost"))
    whole = docs.select(way.alias("to"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(lost, whole["to"] == lost["way"], "left").select("row", without_lines("row.text", "lost").alias("kept"))

