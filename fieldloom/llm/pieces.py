"""SentencePiece encoding by N-best search over the piece lattice, and decoding.

The text with spaces as U+2581 and one in front is a lattice: nodes are places between characters, edges are pieces of the model that stand there;
a character that is no piece has one edge of byte pieces. An edge costs log(PRIOR + rank) micro-nats, the Zipf-Mandelbrot law over the model's
own ranks (its scores); byte pieces cost BYTE each. Costs are whole numbers, so sums are exact in any order. A forward Viterbi
pass gives each node the least cost from the start; these are exact estimates for an A-star search from the end backwards,
which so yields whole segmentations from best to worst and visits little else. Ties go to the segmentation that the search
completes first: nodes nearer to the start, then those reached earlier.

No piece holds a U+2581 after another character, nor a line feed (both are checked when the model is loaded), so the places before each run of
U+2581 and around each line feed cut the lattice in independent units. A worker's new units take their Viterbi passes together, and a bounded table
keeps their best pieces and the loss of their second best. A document's N best can only differ from the best in the N-1 units with the smallest losses: these
are searched, and their lists merged.

The installed model is a BPE model: it encodes by merges, and its scores are merge ranks, no likelihoods. So the best path need not be
its own encoding. With own=True n_own is the number of pieces of the latter and n_agree counts the units that are cut alike, at about a
sixth more of work; own_encoder gives it whole.

Decoding joins pieces and bytes, turns U+2581 to spaces and drops the one in front. It gives the text back, but for U+2581 in
the text itself, which becomes a space, as in the public library.

Nulls: a null text gives no pieces and a null decoded text; empty texts give none and decode to the empty text. Ties: see above, the
same in every run. Repeated rows give equal rows. An empty table gives an empty result. Very long texts are encoded whole. Other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import heapq
import math
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIOR, BYTE, MARK = 100, 12_000_000, "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
NONE = (1 << 31) - 1
TYPES_KEPT = 300_000
AT_ONCE = 6_000
HASH = 0x9E3779B97F4A7C15


def default_model() -> str:
    return os.environ.get("FIELDLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


class PieceModel:
    def __init__(self, raw: bytes, n_best: int, compare: bool = False):
        """compare: count the own encoding's pieces and the units that it cuts alike, too."""
        from sentencepiece import SentencePieceProcessor

        sp = self.own = SentencePieceProcessor(model_proto=raw)
        self.n_best, self.compare = n_best, compare
        self.edges: dict[str, tuple[int, int] | tuple[()]] = {}
        self.byte_ids: list[int] = [0] * 256
        self.text: list[str | None] = []
        self.byte_of: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(None)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
                if self.byte_of[i] < 128:  # a character by itself, such as a line feed
                    self.text[i] = chr(self.byte_of[i])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.edges[piece] = (i, round(1e6 * math.log(PRIOR - sp.get_score(i))))
                self.text[i] = piece
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses a unit's end")
        self.plain = np.array([t is not None for t in self.text])
        self.longest = max(map(len, self.edges))
        if self.longest > 32:
            raise ValueError("pieces of over 32 characters don't fit the packed ranks of the Viterbi pass")
        for piece in list(self.edges):  # beginnings of pieces, so that a search stops where no piece goes on
            for k in range(1, len(piece)):
                self.edges.setdefault(piece[:k], ())
        self.price = np.zeros(sp.get_piece_size(), np.int64)
        for found in self.edges.values():
            if found:
                self.price[found[0]] = found[1]
        self.tables = self._tables()
        self.searched: dict[str, list[tuple[int, list[int]]]] = {}
        self.forget()

    def search(self, unit: str, n_best: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
        """The unit's n_best segmentations as (cost, ids), best first."""
        n, get, longest = len(unit), self.edges.get, self.longest
        least = [0] + [1 << 62] * n
        into: list[list[tuple[int, int, int | tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for s in range(n):
            base = least[s]
            for e in range(s + 1, min(n, s + longest) + 1):
                found = get(unit[s:e])
                if found is None:
                    break
                if found:
                    i, cost = found
                    into[e].append((s, cost, i))
                    if base + cost < least[e]:
                        least[e] = base + cost
            if not get(unit[s]):
                raw = unit[s].encode("utf-8", "surrogatepass")
                cost = BYTE * len(raw)
                into[s + 1].append((s, cost, tuple(self.byte_ids[b] for b in raw)))
                least[s + 1] = min(least[s + 1], base + cost)
        out: list[tuple[int, tuple[int, ...]]] = []
        heap: list[tuple[int, int, int, int, tuple | None]] = [(least[n], n, 0, 0, None)]
        seq, want = 1, n_best or self.n_best
        push, pop = heapq.heappush, heapq.heappop
        while heap and len(out) < want:
            f, at, _, g, path = pop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    i, path = path
                    if isinstance(i, tuple):
                        ids += i
                    else:
                        ids.append(i)
                out.append((f, tuple(ids)))
                continue
            for s, cost, i in into[at]:
                push(heap, (g + cost + least[s], s, seq, g + cost, (i, path)))
                seq += 1
        return out

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length the sorted hashes of pieces and beginnings of pieces, with their ids (-1: a beginning only)."""
        by: dict[int, list[tuple[int, int]]] = {}
        for piece, found in self.edges.items():
            h = 0
            for c in piece:
                h = (h * HASH + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            by.setdefault(len(piece), []).append((h, found[0] if found else -1))
        out = []
        for k in range(1, self.longest + 1):
            rows = sorted(by[k])
            out.append((np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)))
        return out

    def learn(self, units: list[str]) -> None:
        """Best pieces and the loss of the second best of many new units at once: the Viterbi passes of all of them in step.

        An edge off the best path belongs to the second best where the least costs up to its begin and from its end add to the least.
        """
        lens = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(units)), lens)
        first = np.cumsum(lens) - lens
        local = np.arange(len(codes)) - first[owner]
        left = lens[owner] - local
        alive, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        begins, sizes, ids = [], [], []
        for k, (keys, values) in enumerate(self.tables, 1):
            alive = alive[left[alive] >= k]
            h = hashes[alive] * np.uint64(HASH) + codes[alive + (k - 1)] + np.uint64(1)
            hashes[alive] = h
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[at] == h
            alive, at = alive[ok], at[ok]
            real = values[at] >= 0
            begins.append(alive[real])
            sizes.append(np.full(int(real.sum()), k))
            ids.append(values[at[real]])
        single = np.zeros(len(codes), bool)
        single[begins[0]] = True
        odd = np.unique(owner[~single])  # units with characters that are no piece
        begin, size, piece = np.concatenate(begins), np.concatenate(sizes), np.concatenate(ids)
        u = owner[begin]
        source, price = begin + u, self.price[piece]
        target, to = source + size, local[begin] + size
        order = np.lexsort((source, target, to))
        source, target, piece, price, to, u = (x[order] for x in (source, target, piece, price, to, u))
        n_nodes, far = len(codes) + len(units), np.int64(1) << np.int64(50)
        alpha, best = np.full(n_nodes, far), np.full(n_nodes, -1)
        zero, end = first + np.arange(len(units)), first + lens + np.arange(len(units))
        alpha[zero] = 0
        cuts = np.searchsorted(to, np.arange(1, int(lens.max(initial=0)) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            t = target[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            rank = np.arange(hi - lo) - np.repeat(heads, np.diff(np.append(heads, hi - lo)))
            least = np.minimum.reduceat((alpha[source[lo:hi]] + price[lo:hi]) * 32 + rank, heads)
            alpha[t[heads]] = least >> 5
            best[t[heads]] = lo + heads + (least & 31)
        beta = np.full(n_nodes, far)
        beta[end] = 0
        start_at = local[np.minimum(source - u, len(codes) - 1)]
        back = np.lexsort((source, start_at))
        s_sorted, at_sorted = source[back], start_at[back]
        cuts = np.searchsorted(at_sorted, np.arange(int(lens.max(initial=0)) + 1))
        for lo, hi in zip(cuts[:-1][::-1], cuts[1:][::-1], strict=True):
            if lo == hi:
                continue
            e = back[lo:hi]
            s = s_sorted[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            beta[s[heads]] = np.minimum.reduceat(price[e] + beta[target[e]], heads)
        on_best = np.zeros(len(source), bool)
        node, who = end.copy(), np.arange(len(units))
        path_unit, path_piece = [], []
        while len(who):
            e = best[node]
            who, node, e = who[e >= 0], node[e >= 0], e[e >= 0]
            on_best[e] = True
            path_unit.append(who)
            path_piece.append(piece[e])
            node = source[e]
            more = node != zero[who]
            who, node = who[more], node[more]
        second = np.full(len(units), far)
        off = ~on_best
        np.minimum.at(second, u[off], (alpha[source] + price + beta[target])[off])
        loss = np.minimum(second - alpha[end], NONE)
        loss[second >= far] = NONE
        flat_u, flat_p = np.concatenate([*path_unit, np.zeros(0, np.int64)]), np.concatenate([*path_piece, np.zeros(0, np.int64)])
        depth = np.repeat(np.arange(len(path_unit)), [len(x) for x in path_unit])
        order = np.lexsort((-depth, flat_u))
        counts = np.bincount(flat_u.astype(np.int64), minlength=len(units))
        lists = flat_p[order].astype(np.int32)
        if len(odd):
            parts = np.split(lists, np.cumsum(counts)[:-1])
            for i in map(int, odd):
                found = self.search(units[i], 2)
                parts[i] = np.array(found[0][1], np.int32)
                counts[i] = len(parts[i])
                loss[i] = min(found[1][0] - found[0][0], NONE - 1) if len(found) > 1 else NONE
            lists = np.concatenate(parts)
        own = self.compared(units, lists, counts) if self.compare else 0
        base, used = len(self.types), self.used
        if base + len(units) > len(self.loss):
            room = 2 * (base + len(units)) - len(self.loss)
            self.loss, self.count, self.offset, self.n_own = (np.concatenate([x, np.zeros(room, x.dtype)]) for x in (self.loss, self.count, self.offset, self.n_own))
        if used + len(lists) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(2 * (used + len(lists)) - len(self.flat), np.int32)])
        self.flat[used : used + len(lists)] = lists
        span = slice(base, base + len(units))
        self.loss[span], self.count[span], self.offset[span], self.n_own[span] = loss, counts, used + np.cumsum(counts) - counts, own
        self.used = used + len(lists)
        self.types.update(zip(units, range(base, base + len(units)), strict=True))

    def own_of(self, units: list[str]) -> list[list[int]]:
        """The units in the model's own encoding, which never joins two units. Where no mark or nothing but one is there, a line feed (two ids) takes its place."""
        marked = [u[0] == MARK and u != MARK for u in units]
        found = self.own.encode([u[1:].replace(MARK, " ") if m else "\n" + u.replace(MARK, " ") for u, m in zip(units, marked, strict=True)], num_threads=1)
        return [ids if m else ids[2:] for ids, m in zip(found, marked, strict=True)]

    def compared(self, units: list[str], lists: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Twice the number of each unit's pieces in the own encoding, and one if they are those of lists."""
        own = self.own_of(units)
        n_own = np.fromiter(map(len, own), np.int64, len(own))
        equal = n_own == counts
        differs = lists[np.repeat(equal, counts)] != np.fromiter(chain.from_iterable(own), np.int32, int(n_own.sum()))[np.repeat(equal, n_own)]
        return 2 * n_own + (equal & (np.bincount(np.repeat(np.flatnonzero(equal), counts[equal]), differs, len(units)) == 0))

    def forget(self) -> None:
        """An empty table of units."""
        self.types: dict[str, int] = {}
        self.n_own = np.zeros(1024, np.int64)  # twice the own encoding's pieces, and one if it is the best path
        self.loss, self.count, self.offset, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def lists(self, unit: str) -> list[tuple[int, list[int]]]:
        """The unit's segmentations as (loss against the best, ids), best first."""
        if (found := self.searched.get(unit)) is None:
            paths = self.search(unit)
            found = [(cost - paths[0][0], list(ids)) for cost, ids in paths]
            if len(self.searched) >= TYPES_KEPT // 10:
                self.searched.clear()
            if len(unit) <= 64:
                self.searched[unit] = found
        return found

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, tuple[int, int, int], list]]:
        """For each text its best ids, (number of units, pieces of the own encoding, units cut alike), alternatives as (loss, [(unit, its ids)])."""
        split = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        places = [list(map(self.types.get, units)) for units in split]
        open_ = [(d, [i for i, at in enumerate(some) if at is None]) for d, some in enumerate(places) if None in some]
        new = {split[d][i] for d, some in open_ for i in some}
        if len(self.types) + len(new) > TYPES_KEPT:
            self.forget()
            open_ = [(d, range(len(units))) for d, units in enumerate(split)]
            new = {x for units in split for x in units}
        new = sorted(new)
        for at in range(0, len(new), AT_ONCE):  # a slice's edges take some 30 MB
            self.learn(new[at : at + AT_ONCE])
        for d, some in open_:
            for i in some:
                places[d][i] = self.types[split[d][i]]
        return [self._document(units, np.array(some, np.int64)) for units, some in zip(split, places, strict=True)]

    def encode(self, text: str) -> tuple[np.ndarray, tuple[int, int, int], list]:
        return self.encode_batch([text])[0]

    def _document(self, units: list[str], at: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int], list]:
        """at: the units' places in the table."""
        if not units:
            return np.zeros(0, np.int32), (0, 0, 0), []
        count = self.count[at]
        ids = self.flat[np.arange(int(count.sum())) + np.repeat(self.offset[at] - (np.cumsum(count) - count), count)]
        loss, k = self.loss[at], self.n_best - 1
        own = self.n_own[at]
        sizes = (len(units), int((own >> 1).sum()), int((own & 1).sum()))
        if not k:
            return ids, sizes, []
        if len(loss) > k:
            least = np.partition(loss, k - 1)[k - 1]
            near = np.concatenate([np.flatnonzero(loss < least), np.flatnonzero(loss == least)[:k]])
            order = near[np.lexsort((near, loss[near]))][:k]
        else:
            order = np.lexsort((np.arange(len(loss)), loss))
        choices = [(x, self.lists(units[x])) for x in map(int, order) if loss[x] < NONE]
        return ids, sizes, merge(choices, k)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        out, pending, text = [], bytearray(), self.text
        if isinstance(ids, np.ndarray):
            if self.plain[ids].all():
                return "".join(map(text.__getitem__, ids.tolist())).replace(MARK, " ")[1:]
            ids = ids.tolist()
        for i in ids:
            t = text[i]
            if t is None:
                if i in self.byte_of:
                    pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(t)
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")[1:]


def merge(choices: list[tuple[int, list[tuple[int, list[int]]]]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """The k least sums over one choice per unit, the all-best one (zero) left out."""
    heap: list[tuple[int, tuple[int, ...], int]] = [(0, (0,) * len(choices), 0)]
    out: list = []
    while heap and len(out) <= k:
        total, picked, at = heapq.heappop(heap)
        out.append((total, sorted((choices[c][0], choices[c][1][p][1]) for c, p in enumerate(picked) if p)))
        for c in range(at, len(choices)):
            if picked[c] + 1 < len(choices[c][1]):
                step = choices[c][1][picked[c] + 1][0] - choices[c][1][picked[c]][0]
                heapq.heappush(heap, (total + step, (*picked[:c], picked[c] + 1, *picked[c + 1 :]), c))
    return out[1:]


def groups(texts: list[str], chars: int = 600_000) -> Iterator[list[str]]:
    """Runs of whole texts of about `chars` characters."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


_LOADED: dict[tuple, PieceModel] = {}


def load(raw: bytes, n_best: int, compare: bool = False) -> PieceModel:
    """One model a worker process, with its table of units."""
    key = (hash(raw), n_best, compare)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(raw, n_best, compare)
    return _LOADED[key]


INTS = T.ArrayType(T.IntegerType())
CHANGE = T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("ids", INTS)])
OTHER = T.StructType([T.StructField("loss", T.LongType()), T.StructField("changes", T.ArrayType(CHANGE))])
SIZES = ("n_units", "n_own", "n_agree")


def encoded(own: bool) -> T.StructType:
    sizes = [T.StructField(n, T.LongType()) for n in SIZES[: 3 if own else 1]]
    return T.StructType([T.StructField("ids", INTS), T.StructField("n_pieces", T.LongType()), *sizes, T.StructField("alternatives", T.ArrayType(OTHER)), T.StructField("round_trip", T.BooleanType())])


OTHER_ARROW = pa.list_(pa.struct([("loss", pa.int64()), ("changes", pa.list_(pa.struct([("unit", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encoder(model_file: str | None = None, n_best: int = 3, own: bool = False):
    """A column function: text to struct(ids, n_pieces, n_units, alternatives, round_trip), with own n_own and n_agree, too. The model's bytes go with the plan."""
    with open(model_file or default_model(), "rb") as f:
        raw = f.read()
    kind = encoded(own)

    @F.arrow_udf(kind)
    def encode(texts: pa.Array) -> pa.Array:
        model = load(raw, n_best, own)
        ids, sizes, others, same = [], [], [], []
        whole = [t or "" for t in texts.to_pylist()]
        for some in groups(whole):
            for text, (found, n, alternatives) in zip(some, model.encode_batch(some), strict=True):
                ids.append(found)
                sizes.append(n)
                others.append([{"loss": loss, "changes": [{"unit": u, "ids": x} for u, x in changes]} for loss, changes in alternatives])
                same.append(model.decode(found) == text.replace(MARK, " "))
        lengths = np.array([0, *map(len, ids)], np.int64)
        flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), flat)
        counts = [pa.array([n[k] for n in sizes], pa.int64()) for k in range(3 if own else 1)]
        return pa.StructArray.from_arrays([lists, pa.array(lengths[1:]), *counts, pa.array(others, OTHER_ARROW), pa.array(same, pa.bool_())], names=[f.name for f in kind.fields])

    return encode


def decoder(model_file: str | None = None):
    """A column function: ids to text; null ids to null."""
    with open(model_file or default_model(), "rb") as f:
        raw = f.read()

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        model = load(raw, 1)
        return pa.array([None if x is None else model.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def own_encoder(model_file: str | None = None):
    """A column function: text to the ids of the model's own encoding; null texts to none."""
    with open(model_file or default_model(), "rb") as f:
        raw = f.read()

    @F.arrow_udf(INTS)
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(load(raw, 1).own.encode([t or "" for t in texts.to_pylist()], num_threads=1), pa.list_(pa.int32()))

    return encode


def encode_documents(docs: DataFrame, model_file: str | None = None, n_best: int = 3, text: str | Column = "text", own: bool = False) -> DataFrame:
    """doc_id and the fields of encoder."""
    return docs.select("doc_id", encoder(model_file, n_best, own)(text).alias("e")).select("doc_id", "e.*")
