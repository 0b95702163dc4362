"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The lengths of its tokens in bytes add up to their spans; sections are spans of the same
text, and a token goes to the section that holds it. Both are sorted, so the interval join is two binary searches a token.
A token that crosses a boundary is allotted by rule: `majority` (the section with most of its bytes, the earlier
of equals), `start` (the section of its first byte) or `share` (each section in proportion to bytes). Bytes outside all sections
count as unattributed. By default sections are lines, each with its line feed, so they cover the text.

Nulls: null and empty texts have no tokens; null sections are the lines, null bounds count as 0. Empty sections hold nothing.
Where sections overlap or nest, a byte belongs to the one that begins last among those that hold it, of equal ones to the last in the
list; so an inner field has its own tokens and the outer section what is left. Repeated rows give equal rows. An empty table gives an
empty result. Very long texts are encoded whole. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    return os.environ.get("FIELDLOOM_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, raw: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("fieldloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """Ends of the tokens in bytes, with a zero in front."""
        ids = np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int64)
        return np.concatenate([[0], np.cumsum(self.widths[ids])])


def line_sections(text: bytes) -> np.ndarray:
    """Byte spans of the lines, line feeds included."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    cuts = np.concatenate([[0], ends, [len(text)]]) if not len(ends) or ends[-1] != len(text) else np.concatenate([[0], ends])
    return np.stack([cuts[:-1], cuts[1:]], 1) if len(text) else np.zeros((0, 2), np.int64)


def owners(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, owner from each place to the next), the first place being 0; -1 where no section is."""
    full = np.flatnonzero(sections[:, 0] < sections[:, 1])
    order = full[np.argsort(sections[full, 0], kind="stable")]
    begins, ends = sections[order, 0], sections[order, 1]
    if not len(order):
        return np.zeros(1, np.int64), np.full(1, -1)
    if (ends[:-1] <= begins[1:]).all():  # side by side, such as lines
        places = np.stack([begins, ends], 1).ravel()
        who = np.stack([order, np.full(len(order), -1)], 1).ravel()
        used = np.append(places[1:] > places[:-1], True)
        places, who = places[used], who[used]
    else:
        places = np.unique(np.concatenate([begins, ends]))
        who, at, open_ = np.full(len(places), -1), 0, []
        for k, place in enumerate(places.tolist()):
            while at < len(order) and begins[at] <= place:
                heapq.heappush(open_, (-int(begins[at]), -int(order[at]), int(ends[at])))
                at += 1
            while open_ and open_[0][2] <= place:
                heapq.heappop(open_)
            who[k] = -open_[0][1] if open_ else -1
    places, who = np.concatenate([[0], places]), np.concatenate([[-1], who])
    keep = np.concatenate([[True], (who[1:] != who[:-1])])
    return places[keep], who[keep]


def attribute(bounds: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, float, int]:
    """Tokens per section, tokens in none, and how many crossed a boundary. bounds: token ends with 0 in front; sections: (begin, end)."""
    n = len(bounds) - 1
    if not n or not len(sections):
        return np.zeros(len(sections)), float(n), 0
    places, who = owners(sections)
    first, last = (np.searchsorted(places, x, "right") - 1 for x in (bounds[:-1], bounds[1:] - 1))
    crossing = np.flatnonzero(first != last)
    whole = np.ones(n, bool) if rule == "start" else first == last
    got = np.bincount(who[first[whole]] + 1, minlength=len(sections) + 1).astype(float)
    if rule != "start":
        for t in crossing:
            held = who[np.searchsorted(places, np.arange(bounds[t], bounds[t + 1]), "right") - 1]
            who_, where, size = np.unique(held, return_index=True, return_counts=True)
            if rule == "share":
                got[who_ + 1] += size / size.sum()
            else:
                got[who_[np.lexsort((where, -size))[0]] + 1] += 1
    return got[1:], float(got[0]), len(crossing)


_LOADED: dict[int, Encoder] = {}


def load(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(raw)
    return _LOADED[key]


SECTION = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_sections", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("unattributed", T.DoubleType()), T.StructField("section_tokens", T.ArrayType(T.DoubleType()))])


def counter(vocabulary: str | None = None, rule: str = "majority"):
    """A column function of a text and its sections (array of struct(begin, end) in code points; null: lines)."""
    if rule not in ("majority", "start", "share"):
        raise ValueError(rule)
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = f.read()

    @F.arrow_udf(RESULT)
    def count(texts: pa.Array, sections: pa.Array) -> pa.Array:
        encoder, rows = load(raw), []
        for text, spans in zip(texts.to_pylist(), sections.to_pylist(), strict=True):
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            if spans is None:
                cuts = line_sections(data)
            else:
                starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                at = np.concatenate([starts, [len(data)]])
                cuts = at[np.clip(np.array([[s["begin"] or 0, s["end"] or 0] if s else [0, 0] for s in spans], np.int64).reshape(-1, 2), 0, len(starts))]
            bounds = encoder.spans(text)
            counts, rest, crossing = attribute(bounds, cuts, rule)
            rows.append((len(bounds) - 1, len(cuts), crossing, rest, counts))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.name for f in RESULT.fields])

    return count


def count_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, unattributed, section_tokens (in the sections' order)."""
    spans = F.col(sections).cast(SECTION) if sections else F.lit(None).cast(SECTION)
    return docs.select("doc_id", counter(vocabulary, rule)("text", spans).alias("r")).select("doc_id", "r.*")
