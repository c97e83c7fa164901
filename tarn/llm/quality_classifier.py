"""Quality classifier from a weak-label model.

Overlapping heuristic labellers vote on each whole text; every kind of bad text that they know is known to two of
them at least, so that their agreement tells their accuracies. Expectation-maximisation over the counts of vote
patterns of all documents estimates these; the posterior labels of a bounded sample of labelled rows (whose own
labels are not read) train a linear scorer over hashed features: the text's words and its statistics in bins.

Null and empty texts have no words: the length labeller votes against them and the scorer sees the bins alone;
rows that repeat each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, labelled_sample, written
from .quality_rules import ratios, statistics

LABELLERS = ("symbols", "marks", "capitals", "exclaims", "repeats", "one_word", "distinct", "lines", "length", "word_length")
FEATURES = 1 << 16
#: Labelled rows whose posterior labels train the scorer.
FIT_ROWS = 3000
#: Scores under this are rejected.
KEEP = 0.5
#: Accuracies to start from: a labeller seldom accuses a good text, and each knows few of the ways to be bad.
START = (0.95, 0.3)
#: What is known beforehand counts as so many votes, however many texts there are.
PRIOR_VOTES = 30
#: Edges of the bins of each ratio.
BINS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 2.0, 4.0, 6.0, 9.0])
_MARKS = b'!"#$%&*+/:;<=>?@[]^_{|}~\\'


def measures(text: str | None) -> tuple:
    """statistics() and the shares of distinct words, of the commonest word and of marks among the bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = Counter(raw.lower().split())
    n = max(1, words.total())
    return *statistics(text), len(words) / n, max(words.values(), default=0) / n, (len(raw) - len(raw.translate(None, _MARKS))) / max(1, len(raw))


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 none: a column for each labeller."""
    s = np.asarray(stats, float).reshape(-1, 11)
    n, lines, distinct, top, marks = s[:, 0], s[:, 7], s[:, 8], s[:, 9], s[:, 10]
    sym, dup, rep, upper, bang, length = ratios(s[:, :8]).T
    three = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    return np.stack([
        three(sym >= 0.3, sym < 0.1), three(marks >= 0.04, marks < 0.01), three(upper >= 0.4, upper < 0.15), three(bang >= 0.3, bang < 0.05), three(rep > 0.3, rep <= 0.05),
        three((n >= 20) & (top > 0.3), top <= 0.15), three((n >= 20) & (n < 2000) & (distinct < 0.25), distinct >= 0.35),
        three((dup >= 0.3) & (lines >= 4), dup == 0), three(n < 3, n >= 50), three((length < 2.5) | (length > 11), (length >= 3) & (length <= 9)),
    ], axis=1)


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 100, start: tuple[float, float] = START, prior: float = PRIOR_VOTES) -> tuple[dict, list]:
    """Posterior of good for each vote pattern, and each labeller's accuracy on good and on bad texts."""
    if not counts:
        return {}, []
    patterns, n = np.array(list(counts)), np.array(list(counts.values()), float)
    right, share, post = np.tile(np.array(start), (patterns.shape[1], 1)), 0.85, np.zeros(len(n))
    yes, no = patterns > 0, patterns < 0
    for _ in range(rounds):
        g, b = right.T
        odds = math.log(share / (1 - share)) + yes @ np.log(g / (1 - b)) + no @ np.log((1 - g) / b)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for y, mass, told in ((0, n * post, yes), (1, n * (1 - post), no)):
            right[:, y] = np.clip((mass @ told + prior * start[y]) / (mass @ (yes | no) + prior), 0.001, 0.9999)
        share = float(np.clip(n @ post / n.sum(), 0.02, 0.98))
    return dict(zip(counts, post.tolist())), right.tolist()


class _Places(dict):
    """Hashed feature of each word, emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        place = self[word] = zlib.crc32(word) & (FEATURES - 1)
        return place


_PLACES = _Places()


def word_places(text: str | None) -> np.ndarray:
    words = byte_words(text)
    return np.fromiter(map(_PLACES.__getitem__, words), np.int64, len(words))


def bins(stats) -> np.ndarray:
    """Hashed features of the statistics."""
    r = ratios(np.array(stats)[:8])[0]
    found = [f"bin {i} {int(np.searchsorted(BINS, x, side='right'))}" for i, x in enumerate([*r, *stats[8:]])]
    return np.array([_PLACES[x.encode()] for x in [*found, f"length {min(8, int(math.log2(stats[0] + 1)))}"]], np.int64)


def features(text: str | None, stats) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and values: words count by their share of the text, bins of statistics fully."""
    idx, n = np.unique(word_places(text), return_counts=True)
    of_stats = bins(stats)
    return np.r_[idx, of_stats], np.r_[n / max(1, n.sum()), np.ones(len(of_stats))]


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 6, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic scorer by adaptive gradient steps on soft labels, the two classes balanced; the last is the bias."""
    w, g = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-2)
    good = sum(y for _, _, y in rows)
    weight = lambda y: y * 0.5 * len(rows) / max(good, 1) + (1 - y) * 0.5 * len(rows) / max(len(rows) - good, 1)
    for _ in range(epochs):
        for idx, x, y in rows:
            z = float(w[idx] @ x + w[-1])
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * min(5.0, weight(y))
            step = d * x
            np.add.at(g, idx, step**2)
            np.add.at(w, idx, -rate * step / np.sqrt(g[idx]))
            g[-1] += d * d
            w[-1] -= rate * d / math.sqrt(g[-1])
    return w


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """doc_id, votes, posterior (of the votes), score (of the linear scorer), kept of each row of docs."""

    @F.pandas_udf("votes string, s array<double>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        s = np.array([measures(t) for t in texts], float).reshape(-1, 11)
        return pd.DataFrame({"votes": [" ".join(map(str, x)) for x in votes(s).tolist()], "s": s.tolist()})

    # measured once, and written with the texts for the scorer to read
    seen = written(docs.select("doc_id", "text", measured("text").alias("_m")).select("doc_id", "text", "_m.*"))
    found = seen.groupBy("votes").count().collect()  # at most 3 ** labellers rows, whatever the input
    post, _ = estimate({tuple(map(int, r["votes"].split())): r["count"] for r in sorted(found)})

    sample = labelled_sample(docs, labels, "quality", rows).collect()
    sample.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    fitted = []
    for r in sample:
        s = measures(r["text"])
        fitted.append((*features(r["text"], s), post.get(tuple(votes(np.array(s))[0].tolist()), 0.5)))
    shared = docs.sparkSession.sparkContext.broadcast(fit_scorer(fitted))

    @F.pandas_udf("posterior double, score double")
    def scored(texts: pd.Series, patterns: pd.Series, stats: pd.Series) -> pd.DataFrame:
        w, z = shared.value, []
        for t, s in zip(texts, stats):
            places = word_places(t)
            z.append(w[places].sum() / max(1, len(places)) + w[bins(s)].sum() + w[-1])
        told = {p: post.get(tuple(map(int, p.split())), 0.5) for p in patterns.unique()}
        return pd.DataFrame({"posterior": patterns.map(told).astype(float), "score": 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))})

    return seen.select("doc_id", "votes", scored("text", "votes", "s").alias("_r")).select("doc_id", "votes", "_r.*").withColumn("kept", F.col("score") >= keep)
