"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (hashed), so misspellings never seen share vectors with their
originals. A window is the average of its words, each counted once (fewer than half a window count as half);
windows overlap by half. A document is what its most toxic window says, of all its windows in fit, calibration
and scoring alike; the windows that make a toxic document toxic are found by training in rounds. Both layers get
their gradients together.

Null and empty texts have one empty window and get its score; rows that repeat each give a row; without usable
labels all scores are 0.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

BUCKETS, DIM, WINDOW, STEP, GRAMS = 1 << 16, 8, 8, 4, (3, 4, 5, 6)
#: Bounds of the fit: labelled rows of each class, and words of them all; a row is taken whole or not at all.
FIT_ROWS, FIT_WORDS = 1200, 1_500_000
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII bytes to bytes: letters in lower case, a space for the rest.
_LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 for b in range(256))


def grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for n in GRAMS for i in range(len(w) - n + 1)] + [zlib.crc32(b"=" + w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)]


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    if text and text.isascii():
        return text.encode().translate(_LETTERS).decode().split()
    return _WORD.findall((text or "").lower())


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each window, and which of them are the first of their word in the window."""
    n = len(ids)
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)[:, None]
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    place = starts + np.arange(WINDOW)
    inside = place < n
    place = np.minimum(place, n - 1)
    return place, inside & (before[place] < starts)


class Bags:
    """Windows as word numbers, and words as lists of n-grams, numbered in the order of their buckets."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[str, int] = {}
        words, sizes, owners = [], [], []
        for d, t in enumerate(texts):
            ids = [self.number.setdefault(w, len(self.number)) for w in words_of(t)] or [self.number.setdefault("", len(self.number))]
            ids = np.array(ids)
            place, first = windows(ids)
            words.append(ids[place[first]])
            sizes.append(first.sum(axis=1))
            owners.append(np.full(len(place), d))
        self.owner, self.size, self.words = map(np.concatenate, (owners, sizes, words))
        lists = [grams(w) for w in self.number]
        self.g_size = np.array([len(g) for g in lists])
        self.g_at = np.r_[0, np.cumsum(self.g_size)[:-1]]
        self.buckets, self.g = np.unique(np.concatenate([np.array(g) for g in lists]), return_inverse=True)
        self.at = np.r_[0, np.cumsum(self.size)[:-1]]


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges at ... at + size."""
    return np.repeat(at - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _used(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers under `most`, and the place of each id among them."""
    seen = np.zeros(most, bool)
    seen[ids] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(most, np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[ids]


def _forward(b: Bags, e: np.ndarray, rows: np.ndarray):
    words = b.words[_spans(b.at[rows], b.size[rows])]
    uniq, inv = _used(words, len(b.g_size))
    gram = b.g[_spans(b.g_at[uniq], b.g_size[uniq])]
    vec = np.add.reduceat(e[gram], np.r_[0, np.cumsum(b.g_size[uniq])[:-1]], axis=0) / b.g_size[uniq][:, None]
    avg = np.add.reduceat(vec[inv], np.r_[0, np.cumsum(b.size[rows])[:-1]], axis=0) / divisor(b.size[rows])[:, None]
    return avg, uniq, inv, gram


def divisor(size: np.ndarray) -> np.ndarray:
    """What the sum over a window's words is divided by: their number, half a window at least."""
    return np.maximum(size, WINDOW // 2)


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 4, epochs: int = 3, batch: int = 2000, rate: float = 0.5, seed: int = 3) -> dict | None:
    """Embeddings folded with the softmax into a score for each n-gram bucket, and a calibration; None without both labels."""
    toxic = np.asarray(toxic)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    rng, b = np.random.default_rng(seed), Bags(texts)
    e, w, c = rng.normal(0, 0.1, (BUCKETS, DIM))[b.buckets], rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    ge, gw = np.full((len(b.buckets), 1), 1e-6), np.full(w.shape, 1e-6)
    y, weight = toxic[b.owner].astype(int), np.ones(len(b.owner))
    for turn in range(rounds):
        pos = weight[y == 1].sum()
        balance = weight * np.where(y == 1, 0.5 * len(y) / max(pos, 1), 0.5 * len(y) / max(weight[y == 0].sum(), 1))
        for _ in range(epochs):
            order = rng.permutation(np.flatnonzero(balance > 0))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                avg, uniq, inv, gram = _forward(b, e, rows)
                z = avg @ w + c
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                d = p * (balance[rows] / balance[rows].sum())[:, None] * 50
                d_avg = (d @ w.T) / divisor(b.size[rows])[:, None]
                d_word = np.zeros((len(uniq), DIM))
                per = np.repeat(d_avg, b.size[rows], axis=0)
                for j in range(DIM):
                    d_word[:, j] = np.bincount(inv, per[:, j], len(uniq))
                per = np.repeat(d_word / b.g_size[uniq][:, None], b.g_size[uniq], axis=0)
                hot, where = _used(gram, len(b.buckets))
                d_e = np.stack([np.bincount(where, per[:, j], len(hot)) for j in range(DIM)], axis=1)
                d_w = avg.T @ d
                ge[hot] += (d_e**2).mean(axis=1, keepdims=True)
                gw += d_w**2
                e[hot] -= rate * d_e / np.sqrt(ge[hot])
                w -= 0.2 * rate * d_w / np.sqrt(gw)
                c -= 0.02 * d.sum(axis=0)
        gram_score = e @ (w[:, 1] - w[:, 0])
        s = window_scores(b, gram_score) + (c[1] - c[0])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, b.owner, s)
        # from here on only windows near the best of their toxic document stand for it
        weight = np.where((y == 0) | (s >= best[b.owner] - 0.25 * np.abs(best[b.owner])), 1.0, 0.0)
    a, m = calibrate(best, toxic)
    all_grams = np.zeros(BUCKETS, np.float32)
    all_grams[b.buckets] = gram_score
    return {"grams": all_grams, "shift": float(c[1] - c[0]), "slope": a, "middle": m}


def window_scores(b: Bags, gram_score: np.ndarray) -> np.ndarray:
    word = np.add.reduceat(gram_score[b.g], b.g_at) / b.g_size
    return np.add.reduceat(word[b.words], b.at) / divisor(b.size)


def calibrate(best: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve: the cut of fewest errors of the balanced classes gets a score of 0.7."""
    pos, neg = np.sort(best[toxic == 1]), np.sort(best[toxic == 0])
    cut = np.unique(np.r_[pos, neg])
    mids = (cut[1:] + cut[:-1]) / 2 if len(cut) > 1 else cut
    errors = np.searchsorted(pos, mids) / len(pos) + 3 * (1 - np.searchsorted(neg, mids) / len(neg))
    flat = np.flatnonzero(errors <= errors.min() + 1e-12)
    at = float(mids[flat[len(flat) // 2]])
    slope = 4 / max(float(np.median(pos) - np.median(neg)), 1e-6)
    return slope, at - float(np.log(0.7 / 0.3)) / slope


class Scorer:
    """Scores of many texts at once; the value of each word is remembered."""

    #: Words scored together, about, and words remembered.
    TOGETHER, MOST = 400_000, 300_000

    def __init__(self, model: dict):
        self.model, self.number, self.values = model, {}, np.zeros(0)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Places of the words in values; new words get theirs."""
        known = self.number
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.values = np.r_[self.values, [float(self.model["grams"][grams(w)].mean()) for w in fresh]]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def scores(self, texts) -> np.ndarray:
        out, group, n = [], [], 0
        for t in texts:
            group.append(words_of(t) or [""])
            n += len(group[-1])
            if n >= self.TOGETHER:
                out.append(self.best(group))
                group, n = [], 0
        if group:
            out.append(self.best(group))
        best = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.model["slope"] * (best - self.model["middle"]), -30, 30)))

    def best(self, group: list[list[str]]) -> np.ndarray:
        """The highest window of each text."""
        if len(self.number) > self.MOST:
            self.number, self.values = {}, np.zeros(0)
        size = np.array([len(x) for x in group])
        ids = self.numbers([w for x in group for w in x])
        value, total = self.values[ids], len(ids)
        # words back to the same word, as far as a window reaches
        back = np.full(total, WINDOW, np.int8)
        for k in range(WINDOW - 1, 0, -1):
            back[k:][ids[k:] == ids[:-k]] = k
        count = -(-np.maximum(1, size - WINDOW + STEP) // STEP)
        begin = np.cumsum(size) - size
        first = np.cumsum(count) - count
        start = (np.arange(count.sum()) - np.repeat(first, count)) * STEP + np.repeat(begin, count)
        end = np.repeat(begin + size, count)
        sums, words = np.zeros(len(start)), np.zeros(len(start), np.int64)
        for j in range(WINDOW):
            at = np.minimum(start + j, total - 1)
            counts = (start + j < end) & (back[at] > j)
            sums += value[at] * counts
            words += counts
        return np.maximum.reduceat(sums / divisor(words), first) + self.model["shift"]

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def within(rows: list, most: int) -> list:
    """The first rows of at most so many words together, the first one in any case."""
    words = np.cumsum([len(words_of(r["text"])) for r in rows])
    return rows[: max(1, int(np.searchsorted(words, most, side="right")))]


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """A model from at most `rows` labelled rows of each class that are not held out; their texts alone reach the driver."""
    # of several labels of a document the largest counts, so that none is in both classes
    told = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = []
    for y in (0, 1):
        of_class = labelled_sample(docs, told, "toxic", rows, F.col("toxic") == y).collect()
        got += within(sorted(of_class, key=lambda r: (zlib.crc32(f"fit {r['doc_id']}".encode()), r["doc_id"], r["text"] or "")), FIT_WORDS // 2)
    got.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] for r in got], np.array([r["_label"] for r in got], dtype=int))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; a null doc_id is not held out."""
    model = train(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.zeros(len(texts)))
        key = id(shared.value)
        if _SCORERS.get("key") != key:
            _SCORERS.update(key=key, scorer=Scorer(shared.value))
        return pd.Series(_SCORERS["scorer"].scores(texts), dtype=float)

    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_SCORERS: dict = {}
