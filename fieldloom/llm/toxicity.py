"""Toxicity by weak supervision.

Voters. Fixed insult words and learned terms (whole words and beginnings of words that mark toxic rows among the labelled ones) form many
lexicon voters; counts of hits, shouting and address form pattern voters. A voter says toxic (1), clean (-1) or nothing (0).

Label model. Each row's true label is hidden; given it, every voter, the human label among them, has its own table of
probabilities (accuracy and coverage), estimated by expectation maximisation; the human label is only the first guess. Voters that go together
within a class are correlated: a voter counts with 1 / (1 + the sum of its correlations over CORRELATED), so a family of like terms speaks as about
one. This holds for the human label, too: its accuracy and weight are estimated, not set, and the posterior can be had without it.

Classifier. Logistic regression on term and pattern indicators is trained on the posterior labels. Scores see the text only.

Training takes about `per_class` rows of each label at most (a documented bound; chosen by a hash of doc_id and weighted back
to the class shares), from rows outside the held-out fold. Scoring covers every whole text, however long.

Nulls: null texts score as empty ones; rows with null labels or unknown documents aren't learnt from; several labels
for one doc_id count as toxic if any is, of several texts the one with the least hash is learnt from. Without labelled rows the fixed
words alone decide. Repeated rows give equal rows. An empty table gives an empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fold

FOLDS, HELD_OUT = 5, 0
WORD = re.compile(r"[^\W\d_]+")
#: Common insults of four languages in alphabetical order.
SEED = (
    "bastard", "clown", "clowns", "coward", "creep", "disgusting", "dumb", "filth", "filthy", "fool", "freak", "garbage", "idiot", "idiotic", "idiots", "imbecile", "jerk",
    "loser", "losers", "moron", "morons", "nasty", "pathetic", "rubbish", "scum", "shameful", "stupid", "trash", "ugly", "useless", "vermin", "worthless",
    "abschaum", "depp", "dummkopf", "dumm", "ekelhaft", "erbärmlich", "idioten", "trottel", "versager", "wertlos", "widerlich",
    "abruti", "crétin", "débile", "dégoûtant", "idiote", "imbécile", "minable", "ordure", "pitoyable", "stupide",
    "asqueroso", "basura", "cobarde", "escoria", "estúpido", "estúpida", "idiota", "imbécil", "inútil", "patético",
)
SEEDS = frozenset(SEED)
PREFIXES = (4, 5, 6, 7)
#: The least share of upper-case words, among all words of a text, that is shouting.
SHOUTED = 0.3
#: Correlations that count; lower ones, of hundreds of voters, are mostly chance.
CORRELATED = 0.25
PATTERNS = ("seed>=1", "seed>=2", "seed>=3", "learned>=1", "learned>=2", "learned>=3", "none", "shouting", "address")


def terms_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def distinct_words(text: str | None) -> list[str]:
    return sorted(set(WORD.findall((text or "").lower())))


class Lexicon:
    def __init__(self, learned: list[str], extra: list[str]):
        """learned: terms that each mark toxicity; extra: further terms for the classifier only."""
        self.learned = frozenset(learned)
        self.terms = {t: i for i, t in enumerate(dict.fromkeys([*SEED, *learned, *extra]))}
        self.heads = frozenset(t.rstrip("*")[:4] for t in self.terms)
        self.size = len(self.terms) + len(PATTERNS)

    def features(self, text: str | None) -> list[int]:
        """The indices of the features that hold: terms first, then patterns."""
        text = text or ""
        ws = WORD.findall(text.lower())
        heads, get = self.heads, self.terms.get
        found: set[int] = set()
        seed = learned = 0
        for w in [w for w in ws if w[:4] in heads]:
            ts = [t for t in terms_of(w) if t in self.terms]
            found.update(map(get, ts))
            seed += w in SEEDS
            learned += any(t in self.learned for t in ts)
        spoken = text.split()
        shouting = bool(spoken) and sum(map(str.isupper, spoken)) >= SHOUTED * len(spoken)
        flags = (seed > 0, seed > 1, seed > 2, learned > 0, learned > 1, learned > 2, not (seed or learned), shouting, seed > 0 and ("you" in ws or "your" in ws))
        return sorted(found) + [len(self.terms) + i for i, f in enumerate(flags) if f]


def learn_terms(rows: list[tuple[list[str], bool, float]], most: int = 400) -> tuple[list[str], list[str]]:
    """From (distinct words, toxic, weight): terms that mark toxic rows, and other frequent terms of either kind."""
    total = {True: 0.0, False: 0.0}
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    raw: Counter = Counter()
    kinds: set[tuple[str, bool]] = set()  # a group of near copies is one witness
    shared = Counter(w for ws, _, _ in rows for w in ws if len(w) >= 7)
    rare = max(3, len(rows) // 50)
    for ws, toxic, weight in rows:
        kind = min((w for w in ws if len(w) >= 7 and shared[w] <= rare), key=lambda w: zlib.crc32(w.encode()), default=" ".join(ws))
        if (kind, toxic) in kinds:
            continue
        kinds.add((kind, toxic))
        ts = {t for w in ws if len(w) >= 4 for t in terms_of(w)}
        total[toxic] += weight
        for t in ts:
            seen[toxic][t] += weight
        if toxic:
            raw.update(ts)
    n = sum(toxic for _, toxic in kinds)
    least = max(3, n.bit_length() - 3, n // 80)
    shift = 0.5
    score = {}
    for t, support in raw.items():
        if support < least:
            continue
        rate1, rate0 = (seen[True][t] + shift) / (total[True] + 1), (seen[False][t] + shift) / (total[False] + 1)
        if rate1 > 4 * rate0:
            score[t] = (np.log(rate1 / rate0) * np.sqrt(support), support, rate0)
    order = sorted(score, key=lambda t: (-score[t][0], t))
    strong = [t for t in order if seen[False][t] * 19 <= seen[True][t]]
    marks = strong[:most]
    return marks, [t for t in order if t not in set(marks)][:most]


def votes(found: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Rows x voters in {1, 0, -1}: a voter for each seed word and learned term, and the patterns."""
    n_terms = len(lexicon.terms)
    marks = [i for t, i in lexicon.terms.items() if t in lexicon.learned or t in SEEDS]
    lexical = found[:, marks].astype(np.int8)
    p = found[:, n_terms:].astype(np.int8)
    patterns = np.stack([p[:, 1], p[:, 2], p[:, 4], p[:, 5], -p[:, 6], p[:, 8], np.where(p[:, 0] | p[:, 3], 0, -p[:, 7])], 1)
    return np.concatenate([lexical, patterns.astype(np.int8)], 1)


class LabelModel:
    """Voters' accuracies and correlations, without looking at the truth: expectation maximisation over votes."""

    def fit(self, v: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
        """v: rows x voters in {1, 0, -1}, the last of which gives the first guess. The posterior probability that each row is toxic."""
        says = np.stack([v == 1, v == 0, v == -1]).astype(float)
        p = 0.5 + 0.45 * v[:, -1]
        for n in range(rounds):
            self.learn(v, says, weight, p)
            if not n:  # a guess leaves every good voter tied to the others; ties count once the classes are the voters' own
                self.share[:] = 1.0
            before, p = p, self.posterior(v)
            if n and np.abs(p - before).max() < 1e-4:
                break
        return p

    def learn(self, v: np.ndarray, says: np.ndarray, weight: np.ndarray, p: np.ndarray) -> None:
        """Prior, tables [class, vote, voter], correlations within the classes and shares."""
        on, off = weight * p, weight * (1 - p)
        self.prior = np.clip(on.sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.table = np.stack([(np.einsum("i,lij->lj", m, says) + 0.1) / (m.sum() + 0.3) for m in (off, on)])
        self.correlation = np.zeros((v.shape[1], v.shape[1]))
        for m in (off, on):
            mean = (m @ v) / max(m.sum(), 1e-9)
            x = (v - mean) * np.sqrt(m)[:, None]
            cov = x.T @ x
            scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
            self.correlation += np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 1e-9) * (m.sum() / weight.sum())
        tied = self.correlation - np.diag(np.diag(self.correlation))
        self.share = 1 / (1 + np.where(tied > CORRELATED, tied, 0).sum(1))

    def posterior(self, v: np.ndarray, without: tuple[int, ...] = ()) -> np.ndarray:
        """The probability that each row is toxic by all voters but those of `without`."""
        share = self.share.copy()
        share[list(without)] = 0.0
        odds = np.log(self.table[1]) - np.log(self.table[0])
        said = np.where(v == 1, odds[0], np.where(v == -1, odds[2], odds[1]))
        logit = np.log(self.prior / (1 - self.prior)) + said @ share
        return np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1e-4, 1 - 1e-4)


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, centre: np.ndarray, ridge: float = 0.5, steps: int = 25) -> np.ndarray:
    """Weights and, last, the intercept: Newton steps with a ridge towards centre on all but the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    w = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + penalty * (w - centre)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w -= step * min(1.0, 4 / max(size, 1e-9))
        if size < 1e-5:
            break
    return w


class Toxicity:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + self.weights[self.lexicon.features(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def prior_weights(lexicon: Lexicon) -> np.ndarray:
    """What holds where labelled rows say nothing: two fixed words make a text toxic."""
    w = np.zeros(lexicon.size + 1)
    w[-1], w[len(lexicon.terms)], w[len(lexicon.terms) + 1] = -4.0, 2.0, 4.0
    return w


def prior_only() -> Toxicity:
    lexicon = Lexicon([], [])
    return Toxicity(lexicon, prior_weights(lexicon))


def fit(rows: list[tuple[str | None, bool, float]]) -> Toxicity:
    """rows: (text, toxic, weight)."""
    if len({t for _, t, _ in rows}) < 2:
        return prior_only()
    marks, extra = learn_terms([(distinct_words(t), y, w) for t, y, w in rows])
    lexicon = Lexicon(marks, extra)
    x = np.zeros((len(rows), lexicon.size), np.float32)
    for i, (text, _, _) in enumerate(rows):
        x[i, lexicon.features(text)] = 1
    human, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    said = np.concatenate([votes(x > 0, lexicon), np.where(human, 1, -1).astype(np.int8)[:, None]], 1)
    posterior = LabelModel().fit(said, weight)
    centre = prior_weights(lexicon)
    centre[-1] = 0.0
    return Toxicity(lexicon, logistic(x, posterior, weight, centre))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Toxicity:
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    sample = bounded_sample(rows, F.col("toxic"), per_class, [F.col("doc_id")])
    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # a row for each id of the sample, however often it stands in docs
    got = got.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic").collect()
    got.sort(key=lambda r: (r[0], r[1] or ""))
    have = Counter(bool(r[2]) for r in got)
    unit = {bool(k): n / max(1, have[bool(k)]) for k, n in size.items()}
    least = min(unit.values(), default=1.0)
    return fit([(r[1], bool(r[2]), unit[bool(r[2])] / least) for r in got])


def scorer(model: Toxicity):
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    model = train(docs, labels, per_class)
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), scorer(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
