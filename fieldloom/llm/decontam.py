"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased, ASCII punctuation counts as white space, tokens are what lies between white space. The fixed masks 11111 and 111011
select five of five or six consecutive tokens; the others may be anything. Together they hit every window of 13 tokens with two
substitutions, of 15 with three, of 20 with four and of 25 with five, wherever these stand (tests enumerate all of them); every longer
stretch with a fifth of substitutions has one of these inside. Hashes of all masked windows of the
test items form a sorted table, against which each document's windows are joined; each hit names an item and an offset. Around it the
item is laid along the document, and the best stretch is taken in which a match counts 1 - similarity and a substitution -similarity, so
that a sum of zero or more means a share of `similarity` or more.

A document is contaminated by an item if such a stretch of `min_tokens` or more tokens has at least `similarity` equal tokens. Items
shorter than min_tokens must be found whole and unchanged, however short; items without a token match nothing. Below a similarity
of 0.8 the masks still find most stretches, but not all.

A benchmark of at most `most_sent` characters (measured, not assumed) goes to every task as a sorted table, and documents are looked up where
they are. A larger one is joined: hashes of test windows are rows, documents' windows that pass a filter of fixed size (FILTER_BITS)
meet them by a shuffled join, and what meets is verified, a row for each text and item. Tokens stand as 64-bit hashes there. Both ways
give the same rows (tests hold them against each other).

Nulls: null texts match nothing; a null doc_id or item_id is passed on. Repeated items each give their own row, repeated
documents equal rows. Ties: of equally good stretches of an item the first in the document. An empty benchmark or document table gives an
empty result. Very long texts are read whole. Other columns, whatever their names, are kept by clean_of and play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, text_key

#: Fixed spaced seeds: offsets of the tokens that count.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
MULTIPLIERS = [(0x9E3779B97F4A7C15 * k * k + 2 * k + 1) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, 6)]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(TABLE).split()


def seed_hashes(ids: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """A hash of the selected tokens of each window; ids are uint64."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number, np.uint64)
    for k, at in zip(MULTIPLIERS, mask, strict=False):
        x = (ids[at : at + n] + np.uint64(1)) * np.uint64(k)
        out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def best_stretch(same: np.ndarray, least: int, similarity: float = 0.8) -> tuple[int, int, int] | None:
    """(begin, end, matches) of the stretch of at least `least` tokens with the highest sum of 1 - similarity for a match and -similarity else, if not negative."""
    if len(same) < least:
        return None
    lost = round(similarity * 10_000)  # whole numbers: sums are exact
    f = np.concatenate([[0], np.cumsum(np.where(same, 10_000 - lost, -lost))])
    low = np.minimum.accumulate(f[: len(f) - least])
    gain = f[least:] - low
    end = int(gain.argmax())
    if gain[end] < 0:
        return None
    begin = int(f[: end + 1].argmin())
    return begin, end + least, int(same[begin : end + least].sum())


class TestItems:
    """The hash table of the masked windows of some benchmark items."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], min_tokens: int, similarity: float):
        self.min_tokens, self.similarity = min_tokens, similarity
        self.names = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.items = [np.array([number(t, len(self.vocabulary) + 1) for t in tokens(x)], np.uint64) for _, x in items]
        self.tables = []
        for m, mask in enumerate(MASKS):
            hashes = [seed_hashes(x, mask, m) for x in self.items]
            flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            at = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)]).astype(np.int64)
            order = np.argsort(flat, kind="stable")
            self.tables.append((flat[order], owner[order], at[order]))
        tiny = sorted((len(x), i) for i, x in enumerate(self.items) if 0 < len(x) < len(MASKS[0]))
        self.tiny = {n: [i for _, i in some] for n, some in groupby(tiny, key=lambda v: v[0])}

    def overlaps(self, text: str | None) -> list[dict]:
        get = self.vocabulary.get
        ts = tokens(text)
        ids = np.fromiter((get(t, 0) for t in ts), np.uint64, len(ts))
        seen: set[tuple[int, int]] = set()
        marked: dict[int, np.ndarray] = {}
        for m, (mask, (table, owner, at)) in enumerate(zip(MASKS, self.tables, strict=True)):
            known = np.ones(max(0, len(ids) - mask[-1]), bool)
            for k in mask:
                known &= ids[k : k + len(known)] > 0
            where = np.flatnonzero(known)
            if not len(where) or not len(table):
                continue
            h = seed_hashes(ids, mask, m)[where]
            lo, hi = np.searchsorted(table, h), np.searchsorted(table, h, "right")
            hits = np.flatnonzero(hi > lo)
            if not len(hits):
                continue
            hits = hits[np.argsort(lo[hits], kind="stable")]
            for some in np.split(hits, np.flatnonzero(np.diff(lo[hits])) + 1):  # equal windows of the text together
                places, first, last = where[some], int(lo[some[0]]), int(hi[some[0]])
                if len(some) * (last - first) < 64:
                    seen.update((int(owner[j]), int(p - at[j])) for j in range(first, last) for p in places)
                    continue
                for j in range(first, last):
                    item = int(owner[j])
                    if item not in marked:
                        marked[item] = np.zeros(len(ids) + len(self.items[item]), bool)
                    marked[item][places - at[j] + len(self.items[item])] = True
        for item, marks in marked.items():
            seen.update((item, x) for x in (np.flatnonzero(marks) - len(self.items[item])).tolist())
        found: dict[int, dict] = {}
        for n, few in self.tiny.items():
            for item in few:
                words = self.items[item]
                same = np.ones(max(0, len(ids) - n + 1), bool)
                for k in range(n):
                    same &= ids[k : k + len(same)] == words[k]
                if same.any():
                    found[item] = overlap(ids, words, [int(same.argmax())], self.min_tokens, self.similarity)
        by: dict[int, list[int]] = {}
        for item, offset in seen:
            by.setdefault(item, []).append(offset)
        for item, offsets in by.items():
            if one := overlap(ids, self.items[item], offsets, self.min_tokens, self.similarity):
                found[item] = one
        return [found[k] | {"item": k} for k in sorted(found)]


def overlap(ids: np.ndarray, words: np.ndarray, offsets: list[int], min_tokens: int, similarity: float) -> dict | None:
    """The best stretch of an item laid along a text at some offsets, if any counts; the first in the text of equally good ones."""
    least, kept = min(min_tokens, len(words)), None
    for offset in offsets:
        first, last = max(0, -offset), min(len(words), len(ids) - offset)
        stretch = best_stretch(words[first:last] == ids[first + offset : last + offset], least, similarity)
        if stretch is None:
            continue
        begin, end, equal = stretch
        if least < min_tokens and equal < len(words):
            continue
        one = {"n_equal": equal, "n_tokens": end - begin, "item_tokens": len(words), "doc_begin": first + offset + begin, "item_begin": first + begin}
        if kept is None or (one["n_equal"], -one["doc_begin"]) > (kept["n_equal"], -kept["doc_begin"]):
            kept = one
    return kept


FIELDS = ("item", "n_equal", "n_tokens", "item_tokens", "doc_begin", "item_begin")
HITS = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in FIELDS]))
ARROW = pa.list_(pa.struct([(f, pa.int64()) for f in FIELDS]))


def _finder(items: TestItems) -> Callable[[Column], Column]:
    @F.arrow_udf(HITS)
    def overlaps(texts: pa.Array) -> pa.Array:
        return pa.array([items.overlaps(t) for t in texts.to_pylist()], ARROW)

    return overlaps


def collected(benchmark: DataFrame, min_tokens: int, similarity: float, most_sent: int) -> TestItems | None:
    """The items' table, if their texts have at most most_sent characters."""
    if (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) > most_sent:
        return None
    rows = benchmark.select("item_id", "text").collect()
    rows.sort(key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
    return TestItems([(r[0], r[1]) for r in rows], min_tokens, similarity)


FILTER_BITS, PROBES, CHUNK = 1 << 27, 4, 1 << 16
TOKENS_KEPT = 500_000
_HASHES: dict[bytes, int] = {}


def token_hashes(text: str | None) -> np.ndarray:
    ts = tokens(text)
    if len(_HASHES) > TOKENS_KEPT:
        _HASHES.clear()
    get = _HASHES.get
    for t in set(ts):
        if t not in _HASHES:
            _HASHES[t] = xxhash.xxh64_intdigest(t)
    return np.fromiter(map(get, ts), np.uint64, len(ts))


def windows(ids: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of all masked windows, and of all runs of the lengths in short."""
    masks = [*enumerate(MASKS), *((100 + n, tuple(range(n))) for n in short)]
    hashes = [seed_hashes(ids, mask, m) for m, mask in masks]
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])


def filter_places(h: np.ndarray) -> list[np.ndarray]:
    """PROBES bits of the filter for each hash."""
    return [((h >> np.uint64(9 * k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> np.uint64(37)).astype(np.int64) for k in range(PROBES)]


def window_filter(seeds: DataFrame) -> np.ndarray:
    """The filter's bytes: each task sends the chunks that it has bits in, one task a chunk merges them, the driver gets FILTER_BITS / 8 bytes."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in filter_places(batch.column(0).to_numpy().view(np.uint64)):
                bits[at] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, CHUNK)
        used = np.flatnonzero(packed.any(1))
        for k in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed[k].tobytes()], pa.binary())], names=["chunk", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, np.zeros(CHUNK, np.uint8)) | np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, x in seeds.select("hash").mapInArrow(marked, "chunk long, bits binary").repartition("chunk").mapInArrow(merged, "chunk long, bits binary").collect():
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(x, np.uint8)
    return out


def joined(docs: DataFrame, benchmark: DataFrame, min_tokens: int, similarity: float) -> DataFrame:
    """__k1, __k2 (a text's 128 bits), item_id and the fields of each overlap, for a benchmark of any size."""
    spark = docs.sparkSession
    items = stash(benchmark.select(F.monotonically_increasing_id().alias("ref"), "item_id", "text"), "items")

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_hashes(text)
                h, at = windows(ids, [len(ids)] if 0 < len(ids) < len(MASKS[0]) else [])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), ref, np.int64)), pa.array(at), pa.array(np.full(len(h), len(ids)))], names=["hash", "ref", "at", "n"])

    seeds = stash(items.select("ref", "text").mapInArrow(seeds_of, "hash long, ref long, at long, n long"), "seeds")
    short = [r["n"] for r in seeds.filter(F.col("n") < len(MASKS[0])).select("n").distinct().collect()]  # lengths under five
    known = spark.sparkContext.broadcast(window_filter(seeds))

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = token_hashes(text)
                h, at = windows(ids, short)
                ok = np.ones(len(h), bool)
                for place in filter_places(h):
                    ok &= (known.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                if ok.any():
                    rows.append((k1, k2, ids.tobytes(), h[ok].view(np.int64), at[ok]))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["__k1", "__k2", "ids", "hash", "places"])

    kind = "__k1 long, __k2 long, ids binary, hash array<long>, places array<long>"
    found = docs.select(*text_key("text"), "text").mapInArrow(hits_of, kind).groupBy("__k1", "__k2").agg(F.first(F.struct("ids", "hash", "places")).alias("f"))
    found = stash(found.select("__k1", "__k2", "f.*"), "window-hits")
    places = found.select("__k1", "__k2", F.explode(F.arrays_zip("hash", "places")).alias("z")).select("__k1", "__k2", "z.*")
    offsets = places.join(seeds, "hash").select("__k1", "__k2", "ref", (F.col("places") - F.col("at")).alias("offset")).distinct()
    offsets = offsets.groupBy("__k1", "__k2", "ref").agg(F.collect_list("offset").alias("offsets"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, item_ref, some, ids, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if one := overlap(np.frombuffer(ids, np.uint64), token_hashes(text), sorted(some), min_tokens, similarity):
                    rows.append((k1, k2, item_ref, *(one[f] for f in FIELDS[1:])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], names=["__k1", "__k2", "ref", *FIELDS[1:]])

    both = offsets.join(found.select("__k1", "__k2", "ids"), ["__k1", "__k2"]).join(items.select("ref", "text"), "ref")
    out = both.select("__k1", "__k2", "ref", "offsets", "ids", "text").mapInArrow(verified, "__k1 long, __k2 long, ref long, " + ", ".join(f"{f} long" for f in FIELDS[1:]))
    return out.join(items.select("ref", "item_id"), "ref").select("__k1", "__k2", "item_id", *FIELDS[1:])


def contamination(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13, similarity: float = 0.8, most_sent: int = 8_000_000) -> DataFrame:
    """A row for each document and the item that it holds: doc_id, item_id, the longest such stretch in tokens."""
    kind = benchmark.schema["item_id"].dataType
    if items := collected(benchmark, min_tokens, similarity, most_sent):
        hits = docs.select("doc_id", F.explode(_finder(items)("text")).alias("h"))
        names = docs.sparkSession.createDataFrame(list(enumerate(items.names)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        return hits.select("doc_id", "h.*").join(F.broadcast(names), "item").select("doc_id", "item_id", *FIELDS[1:])
    return docs.select("doc_id", *text_key("text")).join(joined(docs, benchmark, min_tokens, similarity), ["__k1", "__k2"]).select("doc_id", "item_id", *FIELDS[1:])


def clean_of(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13, similarity: float = 0.8, most_sent: int = 8_000_000) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    if items := collected(benchmark, min_tokens, similarity, most_sent):
        return docs.filter(F.size(_finder(items)("text")) == 0)
    held = joined(docs, benchmark, min_tokens, similarity).select("__k1", "__k2").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *text_key("text"))
    return rows.join(held, ["__k1", "__k2"], "left_anti").select("__row.*")
