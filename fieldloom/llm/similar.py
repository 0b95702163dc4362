"""SimHash near-duplicates completed to all pairs of similar texts, for near-dedup stages.

Two texts are similar if at least `similarity` of the five-word shingles of either stand in both (Jaccard). Every such pair is linked, and no
other. Equal texts (128 bits of hash) are one row of all this.

Fingerprints. Multi-index hashing as in simhash.py, over fingerprints of five-word shingles: small Hamming balls within each segment, table
matches, whole distances. Its links are verified on the texts' sets of shingles. At 0.8 two fingerprints of 64 bits differ in about ten
bits, so these links find texts that are nearly alike, cheaply and in groups of any size, but not all that count. The rest comes from an index
that is exact:

Prefixes. All shingles have one order: by how often they stand in the corpus (counted by hash in SLOTS counters, to an eighth of a
power of two), then by hash. Of a text with n shingles the first n - ceil(similarity * n) + 1 are its prefix. The first common shingle of
a similar pair is in both prefixes, so the pair meets in that shingle's bucket; a pair whose places there leave too few shingles for the
overlap it needs can't be similar, or has met before. Any order would do for this; rare shingles first keep buckets small, so that
texts made from one form meet only if they share what is rare in them.

Buckets. A first pass pairs each row with the one before it and the first one of its bucket; with the fingerprints' links these are
verified and followed to components. The second one takes all pairs of a bucket that are not in one component yet: large groups of copies
are joined by the first pass, and no pair is left out. Buckets over BLOCK rows are dealt out as pairs of blocks of about that size.

Two parity bitmaps differ in no more bits than their sets in shingles, which rules out most pairs that aren't similar, and none that is:
NARROW bits go with the rows of buckets, so that pairs are ruled out before they become rows, PARITY bits rule out more by a join.
The rest is verified on the complete sets of shingles. These are hashes of 32 bits; two texts of 1,000 words have one shingle in common by
chance with a probability of 0.0002.

Nulls: null and empty texts are copies of each other. Texts under five words are one shingle. One row of each group stays: the one with the
smallest doc_id, a null one only if there is no other; of repeated rows one stays. Columns are kept as they are, whatever their names. An
empty table gives an empty result. Very long texts are compared whole.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stash, text_key
from .simhash import components, forest, hamming_links, majority

BLOCK = 4096
SLOTS, CHUNK, PARITY, NARROW = 1 << 22, 1 << 16, 1024, 512
FEATURES = T.StructType([T.StructField("shingles", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])


def shingle_set(words: list[bytes], shingle: int = 5) -> tuple[np.ndarray, int]:
    """The distinct hashes of the shingles, ascending, and the fingerprint of all."""
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 7) for s in parts), np.uint64, max(1, len(words) - shingle + 1))
    return np.unique((h >> np.uint64(32)).astype(np.uint32)), majority(h)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit for each remainder modulo PARITY, set if an odd number of the shingles has it; as signed longs."""
    odd = np.bincount(shingles & np.uint32(PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@F.arrow_udf(FEATURES)
def features_of(texts: pa.Array) -> pa.Array:
    found = [shingle_set((text or "").encode("utf-8", "surrogatepass").lower().split()) for text in texts.to_pylist()]
    sets = [s for s, _ in found]
    columns = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s).tolist() for s in sets], pa.list_(pa.int64()))]
    prints = pa.array(np.array([fp for _, fp in found], np.uint64).view(np.int64), pa.int64())
    return pa.StructArray.from_arrays([*columns, prints], names=["shingles", "n", "parity", "fp"])


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) sorted by key -> pairs (a, b) of each row with the one before it and with the first one of its key."""
    key, before, first = None, 0, 0
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        heads = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        previous = np.concatenate([[before], ids[:-1]])
        owner = np.maximum.accumulate(np.where(heads, np.arange(len(ids)), -1))
        leader = np.where(owner >= 0, ids[owner], first)
        a = np.concatenate([ids[~heads], ids[~heads]])
        b = np.concatenate([previous[~heads], leader[~heads]])
        used = a != b
        key, before, first = keys[-1], ids[-1], leader[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[used]), pa.array(np.maximum(a, b)[used])], names=["a", "b"])


def _open_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, id, n, place, c, parities) sorted by key -> pairs (a, b) of a key that may be similar, c being different.

    A key's sides are 0 and 1 where two blocks of a larger bucket meet, of which only pairs across count; else 0.
    """
    ratio, differ = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The columns where x and y have different c, sizes and places that leave enough common shingles, and parities near enough."""
        total = x[3] + y[3]
        need = np.ceil(ratio * total - 1e-9)
        at = np.flatnonzero((x[5] != y[5]) & (np.minimum(x[3] - x[4], y[3] - y[4]) >= need) & (np.minimum(x[3], y[3]) >= need))
        bits = np.bitwise_count((x[6:, at if x.shape[1] > 1 else np.zeros(len(at), np.int64)] ^ y[6:, at]).view(np.uint64)).sum(0)
        return at[bits <= total[at] * differ + 1e-9]

    def pairs_of(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if (blocks := rows[1]).any():
            left, right = rows[:, blocks == 0], rows[:, blocks == 1]
            for i in range(left.shape[1]):
                hit = right[2, fits(left[:, i : i + 1], right)]
                yield np.full(len(hit), left[2, i]), hit
        else:
            for i in range(rows.shape[1] - 1):
                rest = rows[:, i + 1 :]
                hit = rest[2, fits(rows[:, i : i + 1], rest)]
                yield np.full(len(hit), rows[2, i]), hit

    def made(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        """whole: all rows of some keys."""
        if not whole.shape[1]:
            return
        edge = np.flatnonzero(np.concatenate([[True], whole[0, 1:] != whole[0, :-1], [True]]))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        two = two[(whole[1, two] != whole[1, two + 1]) | (whole[1, two] == 0)]
        x, y = whole[:, two], whole[:, two + 1]
        ok = fits(x, y)
        a, b, held = [x[2, ok]], [y[2, ok]], 0
        for k in np.flatnonzero(size > 2):
            for i, j in pairs_of(whole[:, edge[k] : edge[k + 1]]):
                a.append(i)
                b.append(j)
                held += len(i)
                if held > 200_000:
                    yield packed(a, b)
                    a, b, held = [], [], 0
        yield packed(a, b)

    def packed(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        """The pairs, each once."""
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    rest = np.zeros((6 + NARROW // 64, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], 1)
        cut = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
        yield from made(rows[:, :cut])
        rest = rows[:, cut:]
    yield from made(rest)


def frequencies(texts: DataFrame) -> np.ndarray:
    """How often the shingles of each of SLOTS slots stand in texts: id, shingles. A task sends one row a chunk of slots, however many shingles it reads."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n[np.frombuffer(x, np.uint32) >> np.uint32(10)] += np.uint32(1)
        used = [k for k in range(SLOTS // CHUNK) if n[k * CHUNK : (k + 1) * CHUNK].any()]
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n[k * CHUNK : (k + 1) * CHUNK].tobytes()], pa.binary())], names=["chunk", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks' sums, to an eighth of a power of two: a byte a slot, up to four thousand million."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, np.zeros(CHUNK, np.uint64)) + np.frombuffer(x, np.uint32)
        size = [np.minimum(8 * np.log2(1.0 + x), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(size, pa.binary())], names=["chunk", "n"])

    kind = "chunk long, n binary"
    out = np.zeros(SLOTS, np.uint8)
    for k, x in texts.select("shingles").mapInArrow(counted, kind).repartition("chunk").mapInArrow(added, kind).collect():
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(x, np.uint8)
    return out


def prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """key, id, place for each shingle of a text's prefix: place counts from 0 in their order."""
    often = texts.sparkSession.sparkContext.broadcast(frequencies(texts))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for x in batch.column(1).to_pylist():
                h = np.frombuffer(x, np.uint32)
                first = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
                keys.append(h[np.argsort(often.value[h >> np.uint32(10)], kind="stable")[:first]].view(np.int32))
                sizes.append(first)
            if not keys:
                continue
            columns = [pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))]
            whole = pa.RecordBatch.from_arrays(columns, names=["key", "id", "place"])
            for at in range(0, len(whole), 10_000):
                yield whole.slice(at, 10_000)

    return texts.select("id", "shingles").mapInArrow(made, "key int, id long, place int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> those whose key has further rows."""
    rest = None
    for batch in batches:
        batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
        if not batch:
            continue
        batch = batch[0]
        keys = batch.column(0).to_numpy()
        cut = np.searchsorted(keys, keys[-1])
        equal = keys[1:] == keys[:-1]
        several = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        yield batch.slice(0, cut).filter(pa.array(several[:cut]))
        rest = batch.slice(cut)
    if rest is not None and len(rest) > 1:
        yield rest


def release(df: DataFrame) -> None:
    """Shuffle files of what has been written go when the driver's objects go; this doesn't wait until these happen to."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def held_links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar by the complete sets, thinned to forests that connect the same."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, sets -> the links that hold, as a spanning forest of the task's own. One pass, so a task needs one Python worker."""

        def held() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = ((np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
                keep = [likeness(x, y) >= similarity for x, y in pairs]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return forest(held())

    small = texts.select("id", F.struct("n", "parity").alias("s"))
    both = pairs.join(small.withColumnsRenamed({"id": "a", "s": "p"}), "a").join(small.withColumnsRenamed({"id": "b", "s": "q"}), "b")
    bits = F.aggregate(F.zip_with("p.parity", "q.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = (F.least("p.n", "q.n") >= similarity * F.greatest("p.n", "q.n") - 1e-9) & (bits <= (F.col("p.n") + F.col("q.n")) * ((1 - similarity) / (1 + similarity)) + 1e-9)
    pairs = stash(both.filter(fits).select("a", "b"), "similar-pairs")
    release(texts)
    one = texts.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = texts.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    found = stash(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"), "similar-links")
    discard(pairs)
    release(texts)
    return found


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts by multi-index hashing of their fingerprints: those of one fingerprint with its first text, and the first texts of linked ones."""
    first = texts.groupBy("fp").agg(F.min("id").alias("first"))
    equal = texts.select("id", "fp").join(first, "fp").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = hamming_links(first.select("fp")).withColumnsRenamed({"a": "p", "b": "q"})
    near = near.join(first.select(F.col("fp").alias("p"), F.col("first").alias("x")), "p").join(first.select(F.col("fp").alias("q"), F.col("first").alias("y")), "q")
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def open_pairs(rows: DataFrame, texts: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of prefixes' rows that share a key and may be similar, but those in one component of groups (node, component)."""
    rows = rows.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "place", F.coalesce("component", "id").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count(F.lit(1)).alias("size")).filter("least <> most")
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = rows.join(mixed.select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    folded = [F.col("parity")[k] for k in range(NARROW // 64)]
    for k in range(NARROW // 64, PARITY // 64):
        folded[k % (NARROW // 64)] = folded[k % (NARROW // 64)].bitwiseXOR(F.col("parity")[k])
    narrow = [f.alias(f"p{k}") for k, f in enumerate(folded)]
    rows = rows.join(texts.select("id", "n", *narrow), "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    block = F.when(F.col("parts") == 1, F.col("key").cast("long")).otherwise(F.xxhash64("key", low, high))
    rows = rows.select(block.alias("key"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "n", "place", "c", *[f"p{k}" for k in range(len(narrow))])
    return rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(lambda batches: _open_pairs(batches, similarity), "a long, b long").distinct()


def similar_links(texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """texts: distinct id, shingles, n, parity, fp. Pairs (a, b) of similar texts, thinned to forests that connect the same."""
    rows = prefixes(texts, similarity).repartition("key").sortWithinPartitions("key", F.xxhash64("id"))
    rows = stash(rows.mapInArrow(_shared, rows.schema), "similar-prefixes")
    release(texts)
    spread = rows.select("key", "id").repartition("key").sortWithinPartitions("key", F.xxhash64("id"))
    near = spread.mapInArrow(_bucket_pairs, "a long, b long").unionByName(fingerprint_pairs(texts)).distinct()
    first = held_links(near, texts, similarity)
    groups = stash(components(first), "similar-joined")
    rest = held_links(open_pairs(rows, texts, groups, similarity), texts, similarity)
    discard(rows, groups)
    return first.unionByName(rest)


def similar_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(__k1, __k2, group) for each distinct text; texts of one group are linked."""
    texts = docs.select(*text_key("text"), features_of("text").alias("f")).groupBy("__k1", "__k2").agg(F.first("f").alias("f"))
    texts = stash(texts.select(F.monotonically_increasing_id().alias("id"), "__k1", "__k2", "f.*"), "similar-texts")  # ids are fixed once these rows are written
    release(texts)
    links = similar_links(texts, similarity=similarity)
    found = components(links).withColumnRenamed("node", "id")
    out = stash(texts.select("id", "__k1", "__k2").join(found, "id", "left").select("__k1", "__k2", F.coalesce("component", "id").alias("group")), "similar-groups")
    discard(texts)
    return out


def first_of_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows that stay, with all columns of docs."""
    groups = similar_groups(docs, similarity)
    ids = docs.select(F.col("doc_id").alias("__doc"), *text_key("text")).groupBy("__k1", "__k2", "__doc").agg(F.count(F.lit(1)).alias("__copies"))
    order = [F.col("__doc").isNull(), "__doc", "__k1", "__k2"]
    one = F.struct("__k1", "__k2", "__doc", "__copies")
    per_text = ids.groupBy("__k1", "__k2").agg(F.min_by(F.struct("__doc", "__copies"), F.struct(*order[:2])).alias("s")).select("__k1", "__k2", "s.*")
    first = per_text.join(groups, ["__k1", "__k2"]).groupBy("group").agg(F.min_by(one, F.struct(*order)).alias("s"))
    stays = stash(first.select("s.*").withColumnsRenamed({"__k1": "__s1", "__k2": "__s2", "__doc": "__sdoc"}), "similar-stays")
    discard(groups)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *text_key("text"), F.col("doc_id").alias("__doc"))
    kept = rows.join(stays, (F.col("__k1") == F.col("__s1")) & (F.col("__k2") == F.col("__s2")) & F.col("__doc").eqNullSafe(F.col("__sdoc")))
    single = kept.filter("__copies = 1").select("__row.*")
    several = kept.filter("__copies > 1").groupBy("__s1", "__s2", "__sdoc").agg(F.first("__row").alias("__row")).select("__row.*")
    return single.unionByName(several)
