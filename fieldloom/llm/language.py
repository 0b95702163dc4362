"""Language of every word by a linear-chain conditional random field, and of the text from its words.

A line's words (runs of letters, lower-cased) are a chain; its labels are the languages seen in training. Emission features: beginnings and ends
of up to four letters, inner two- and three-letter groups, and the word itself where the lexicon (frequent words of the training texts) has
it. Transitions and emissions are learned together by gradient ascent on the conditional likelihood. Training texts name one language
each though some switch within; so after half of the rounds each word takes the label that the field itself finds where it is sure.

Forward-backward gives each word's probabilities; a text's language has the largest sum over its words (the first by name among
equals), its score is that sum's share. All lines of a batch advance together, the longest first, so a batch costs as many steps as its
longest line has words.

Code-switched text: `runs` gives the words' labels, each the most probable of its word: language, first word, number of words.

Training takes about `per_language` texts of each language at most, of those under `long_text` characters (documented bounds; chosen by a
hash of doc_id); a language that has longer ones only is learnt from the shortest of them. Letters are Unicode's; marks belong to
the letter before them, so words of scripts with vowel signs stay whole. Nulls: null texts and texts without a letter are `und` with
score 0 and no runs; rows with null lang aren't learnt from. Ties: the first language by name. Repeated rows give equal rows. An empty
table gives an empty result; without training rows every text is `und`. Very long texts are read whole. Other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, char_class, fold

FOLDS, HELD_OUT = 4, 2
LETTER = char_class("L")
WORD = re.compile(f"[{LETTER}][{LETTER}{char_class('M')}]*")
#: The same for texts of the first 256 characters, which have no marks: a class that is matched twice as fast.
LATIN_WORD = re.compile("[" + "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == "L") + "]+")
TYPES_KEPT = 250_000


def word_features(w: str) -> list[str]:
    n = len(w)
    out = ["=" + w]
    out += ["^" + w[:k] for k in range(1, min(4, n) + 1)]
    out += [w[-k:] + "$" for k in range(1, min(4, n) + 1)]
    out += [w[i : i + 2] for i in range(n - 1)]
    out += [w[i : i + 3] for i in range(n - 2)]
    return out


def chains(text: str | None) -> list[list[str]]:
    """The words of each line that has any."""
    text = (text or "").lower()
    try:
        text.encode("latin-1")
        found = LATIN_WORD.findall
    except UnicodeEncodeError:
        found = WORD.findall
    return [ws for line in text.split("\n") if (ws := found(line))]


class Steps:
    """The order in which chains of the given lengths advance together."""

    def __init__(self, lengths: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.first = self.first[order]
        sorted_ = lengths[order]
        self.longest = int(sorted_[0]) if len(sorted_) else 0
        self.active = np.searchsorted(-sorted_, -np.arange(self.longest), "left")


def forward_backward(scores: np.ndarray, steps: Steps, transition: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Marginals of each word, expected transitions, expected starts, log partition."""
    n, k = scores.shape
    top = scores.max(1, keepdims=True)
    e = np.exp(scores - top)
    psi, alpha, beta = np.exp(transition), np.empty((n, k)), np.empty((n, k))
    log_z = float(top.sum())
    a = np.zeros((0, k))
    for t in range(steps.longest):
        at = steps.first[: steps.active[t]] + t
        a = (np.exp(start) if t == 0 else a[: len(at)] @ psi) * e[at]
        norm = a.sum(1, keepdims=True)
        a = a / norm
        alpha[at] = a
        if pairs:
            log_z += float(np.log(norm).sum())
    b = np.zeros((0, k))
    expected = np.zeros((k, k))
    for t in range(steps.longest - 1, -1, -1):
        at = steps.first[: steps.active[t]] + t
        new = np.ones((len(at), k))
        if len(b):
            eb = e[at[: len(b)] + 1] * b
            if pairs:
                before = alpha[at[: len(b)]]
                z = np.einsum("ni,ij,nj->n", before, psi, eb)
                expected += psi * (before.T @ (eb / z[:, None]))
            m = eb @ psi.T
            new[: len(b)] = m / m.sum(1, keepdims=True)
        b = new
        beta[at] = b
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return gamma, expected, gamma[steps.first].sum(0), log_z


class WordField:
    def __init__(self, languages: list[str], vocabulary: dict[str, int], emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.languages, self.vocabulary, self.emission, self.transition, self.start = languages, vocabulary, emission, transition, start
        self.types: dict[str, int] = {}
        self.scores = np.zeros((1024, max(1, len(languages))), np.float64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("types", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.types, self.scores = {}, np.zeros((1024, max(1, len(self.languages))), np.float64)

    def learn_types(self, words: list[str]) -> None:
        """Emission scores of words not met before; the table starts anew when it is full."""
        if len(self.types) + len(words) > TYPES_KEPT:
            self.types = {}
        get = self.vocabulary.get
        ids, sizes = [], []
        for w in words:
            found = [i for f in word_features(w) if (i := get(f)) is not None]
            ids += found
            sizes.append(len(found))
        base = len(self.types)
        if base + len(words) > len(self.scores):
            grown = np.zeros((2 * (base + len(words)), self.scores.shape[1]))
            grown[:base] = self.scores[:base]
            self.scores = grown
        owner = np.repeat(np.arange(len(words)), sizes)
        rows = self.emission[np.array(ids, np.int64)]
        for c in range(rows.shape[1]):
            self.scores[base : base + len(words), c] = np.bincount(owner, rows[:, c], len(words))
        self.types.update(zip(words, range(base, base + len(words)), strict=True))

    def word_scores(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.types)
        if new:
            if len(self.types) + len(new) > TYPES_KEPT:
                self.types, new = {}, set(words)
            self.learn_types(sorted(new))
        return self.scores[np.fromiter(map(self.types.__getitem__, words), np.int64, len(words))]

    def word_marginals(self, text: str | None) -> list[tuple[str, dict[str, float]]]:
        """Each word with its languages' probabilities."""
        lines = chains(text)
        words = [w for line in lines for w in line]
        if not words:
            return []
        gamma = forward_backward(self.word_scores(words), Steps(np.array([len(x) for x in lines])), self.transition, self.start)[0]
        return [(w, dict(zip(self.languages, map(float, g), strict=True))) for w, g in zip(words, gamma, strict=True)]

    def predict(self, texts: list[str | None], chunk: int = 2_000_000) -> tuple[list[str], list[float], list[list[tuple[str, int, int]]]]:
        """Languages, scores and runs; texts go in groups of about `chunk` characters, each text whole."""
        names, shares, runs, at = [], [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= chunk):
                size += len(texts[end] or "")
                end += 1
            words, lengths, owner = [], [], []
            for d in range(at, end):
                for line in chains(texts[d]):
                    words += line
                    lengths.append(len(line))
                    owner.append(d - at)
            if words and self.languages:
                lens = np.array(lengths)
                gamma = forward_backward(self.word_scores(words), Steps(lens), self.transition, self.start)[0]
                doc = np.repeat(np.array(owner), lens)
                mass = np.stack([np.bincount(doc, gamma[:, c], end - at) for c in range(gamma.shape[1])], 1)
                total = mass.sum(1)
                best = mass.argmax(1)
                names += [self.languages[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
                shares += [float(mass[i, b] / total[i]) if total[i] > 0 else 0.0 for i, b in enumerate(best)]
                labels, begin = gamma.argmax(1), np.searchsorted(doc, np.arange(end - at))
                heads = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]))
                sizes = np.diff(np.append(heads, len(labels)))
                found: list[list[tuple[str, int, int]]] = [[] for _ in range(end - at)]
                for d, label, first, n in zip(doc[heads].tolist(), labels[heads].tolist(), (heads - begin[doc[heads]]).tolist(), sizes.tolist(), strict=True):
                    found[d].append((self.languages[label], first, n))
                runs += found
            else:
                names += ["und"] * (end - at)
                shares += [0.0] * (end - at)
                runs += [[] for _ in range(end - at)]
            at = end
        return names, shares, runs


def fit(rows: list[tuple[str | None, str]], rounds: int = 24, rate: float = 0.25, ridge: float = 1e-6) -> WordField:
    """rows: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    words, lengths, labels = [], [], []
    for text, lang in rows:
        for line in chains(text):
            words += line
            lengths.append(len(line))
            labels += [languages.index(lang)] * len(line)
    k = len(languages)
    if not words:
        return WordField([], {}, np.zeros((0, 1)), np.zeros((1, 1)), np.zeros(1))
    types = {w: i for i, w in enumerate(dict.fromkeys(words))}
    token = np.fromiter(map(types.__getitem__, words), np.int64, len(words))
    feats = [word_features(w) for w in types]
    support = Counter(f for fs in feats for f in set(fs))
    often = np.bincount(token, minlength=len(types))
    lexicon = {"=" + w for w, i in types.items() if often[i] >= 3}
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in support.items() if (f in lexicon if f[0] == "=" and len(f) > 1 else n >= 3)))}
    flat = [(i, vocabulary[f]) for i, fs in enumerate(feats) for f in fs if f in vocabulary]
    owner, feature = np.array(flat, np.int64).reshape(-1, 2).T
    truth = np.array(labels)
    steps = Steps(np.array(lengths))
    follows = np.ones(len(words), bool)
    follows[steps.first] = False
    emission, transition, start = np.zeros((len(vocabulary), k)), np.zeros((k, k)), np.zeros(k)
    params = [emission, transition, start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    n = len(words)
    for r in range(1, rounds + 1):
        by_type = np.stack([np.bincount(owner, emission[feature, c], len(types)) for c in range(k)], 1)
        gamma, expected, starts, _ = forward_backward(by_type[token], steps, transition, start, pairs=True)
        if r == rounds // 2:
            sure = gamma.max(1) > 0.9
            truth = np.where(sure, gamma.argmax(1), truth)
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[np.flatnonzero(follows) - 1], truth[follows]), 1)
        diff = -gamma
        diff[np.arange(n), truth] += 1
        per_type = np.stack([np.bincount(token, diff[:, c], len(types)) for c in range(k)], 1)
        slope = [np.stack([np.bincount(feature, per_type[owner, c], len(vocabulary)) for c in range(k)], 1), seen - expected, np.bincount(truth[steps.first], minlength=k) - starts]
        for p, g, (m, v) in zip(params, slope, moments, strict=True):
            g = g / n - ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return WordField(languages, vocabulary, emission, transition, start)


def train(docs: DataFrame, per_language: int = 150, long_text: int = 50_000) -> WordField:
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    got = bounded_sample(rows.filter(F.length("text") < long_text), F.col("lang"), per_language, [F.col("doc_id")]).collect()
    missing = rows.groupBy("lang").agg(F.min(F.length("text")).alias("n")).filter(F.col("n") >= long_text)  # a row a language
    rest = rows.withColumn("n", F.length("text")).join(F.broadcast(missing), ["lang", "n"]).groupBy("lang").agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("text")).alias("r")).select("r.*", "lang")
    got += rest.collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    return fit([(r["text"], r["lang"]) for r in got])


RUN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])
FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("runs", T.ArrayType(RUN))])
RUNS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))


def predictor(field: WordField):
    @F.arrow_udf(FOUND)
    def predict(texts: pa.Array) -> pa.Array:
        names, shares, runs = field.predict(texts.to_pylist())
        rows = [[{"lang": a, "first": b, "n": c} for a, b, c in some] for some in runs]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(rows, RUNS)], names=["lang_pred", "score", "runs"])

    return predict


def languages(docs: DataFrame, per_language: int = 150) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runs."""
    field = train(docs, per_language)
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), predictor(field)("text").alias("r"))
    return out.select("doc_id", "held_out", "r.*")
