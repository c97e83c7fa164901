"""Quality rules with an isolation forest on rule statistics.

Rule statistics come from one pass over each whole text. Trees of random splits are grown over ratios of these
statistics for labelled good rows; rows that few splits isolate are anomalous. The threshold comes from labelled
rows too. Null and empty texts have no words and fail the base rule; rows that repeat each get the same verdict;
without labels nothing but the base rule rejects.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: A word is listed as repeated if a window of this many words that holds it stands twice in the text.
WINDOW = 8
#: Bounds of the fit: labelled rows read, trees, rows of a tree.
FIT_ROWS, TREES, TREE_ROWS = 6000, 100, 256
#: How much a rejected good row weighs against a kept bad one.
STRICT = 12


def repeated_words(words: list) -> int:
    """Words that stand in WINDOW-word windows found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    # windows of one hash are compared in full
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    hot = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    _, inverse, counts = np.unique(windows[hot], axis=0, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words) + 1, np.int64)
    for i in hot[counts[inverse.ravel()] > 1]:
        hit[i] += 1
        hit[i + WINDOW if i + WINDOW <= len(words) else len(words)] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The columns of STATS, then what only the forest reads: upper-case share, exclamation marks and lines."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at ASCII white space alone
    chars = sum((1 for c in text if c not in " \t\n\x0b\x0c\r")) if len(text) < 64 else len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    upper = len(re.findall(r"[A-Z]", text))
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), upper, text.count("!"), len(lines)


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: none grows with the text's length."""
    n, chars, sym, dup, rep, upper, bang, lines = np.asarray(stats, float).reshape(-1, 8).T
    n1, c1 = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([sym / n1, dup / np.maximum(lines, 1), rep / n1, upper / c1, bang / n1, np.clip(chars / n1, 0, 12)], axis=1)


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list:
    """A tree as nested lists: [feature, split, left, right], or [size] at a leaf.

    Splits fall up to a margin beyond the rows' range, so values unlike any seen are cut off early too.
    """
    if depth == 0 or len(rows) <= 1:
        return [len(rows)]
    f = int(rng.integers(rows.shape[1]))
    lo, hi = rows[:, f].min(), rows[:, f].max()
    pad = 0.25 * (hi - lo) + 0.02
    at = float(rng.uniform(lo - pad, hi + pad))
    left = rows[:, f] < at
    return [f, at, grow(rows[left], rng, depth - 1), grow(rows[~left], rng, depth - 1)]


def expected(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def path(tree: list, rows: np.ndarray, where: np.ndarray, depth: int, out: np.ndarray) -> None:
    if not len(where):
        return
    if len(tree) == 1:
        out[where] += depth + expected(tree[0])
        return
    left = rows[where, tree[0]] < tree[1]
    path(tree[2], rows, where[left], depth + 1, out)
    path(tree[3], rows, where[~left], depth + 1, out)


def anomaly(forest: list, rows: np.ndarray, size: int) -> np.ndarray:
    """0 to 1, higher: fewer splits isolate the row."""
    out = np.zeros(len(rows))
    for tree in forest:
        path(tree, rows, np.arange(len(rows)), 0, out)
    return 2.0 ** (-out / max(1, len(forest)) / max(float(expected(size)), 1.0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 7) -> dict:
    """Forest and threshold from at most `rows` labelled rows.

    Rows that the base rule fails are left out. The threshold is the one with the least sum of the share of good
    rows it rejects, counted STRICT times, and the share of bad rows it keeps, in the middle of the gap it falls in.
    """

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in statistics(t)] for t in texts])

    got = labelled_sample(docs, labels, "quality", rows).select("doc_id", "_label", measured("text").alias("s")).collect()
    got = sorted((r["doc_id"], r["_label"], list(r["s"])) for r in got if not base_fails(r["s"][0], r["s"][4]))
    good = ratios(np.array([s for _, y, s in got if y == 1])) if any(y == 1 for _, y, _ in got) else np.zeros((0, 6))
    bad = ratios(np.array([s for _, y, s in got if y != 1])) if any(y != 1 for _, y, _ in got) else np.zeros((0, 6))
    if len(good) < 8:
        return {"forest": [], "threshold": 2.0, "size": 1}
    rng, size = np.random.default_rng(seed), min(TREE_ROWS, len(good))
    forest = [grow(good[rng.choice(len(good), size, replace=False)], rng, int(np.ceil(np.log2(size)))) for _ in range(TREES)]
    return {"forest": forest, "threshold": cut_between(anomaly(forest, good, size), anomaly(forest, bad, size)), "size": size}


def cut_between(good: np.ndarray, bad: np.ndarray) -> float:
    """The calibrated threshold on scores of good and bad rows; without bad rows nothing is rejected."""
    if not len(bad):
        return 2.0
    at = np.unique(np.r_[good, bad, 2.0])
    cost = STRICT * (1 - np.searchsorted(np.sort(good), at, side="right") / len(good)) + np.searchsorted(np.sort(bad), at, side="right") / len(bad)
    k = len(cost) - 1 - int(np.argmin(cost[::-1]))
    return float((at[k] + at[min(k + 1, len(at) - 1)]) / 2)


def base_fails(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def quality_udf(model: dict):
    @F.pandas_udf(f"{STATS}, anomaly double, base_failed boolean, kept boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        s = np.array([statistics(t) for t in texts], dtype=np.int64).reshape(-1, 8)
        out = pd.DataFrame(s[:, :5], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
        out["anomaly"] = anomaly(model["forest"], ratios(s), model["size"]) if model["forest"] else 0.0
        out["base_failed"] = base_fails(s[:, 0], s[:, 4])
        out["kept"] = ~out["base_failed"] & (out["anomaly"] <= model["threshold"])
        return out

    return judged


def judge(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, the rule statistics, base_failed, anomaly and kept of each row."""
    udf = quality_udf(fit(docs, labels, rows))
    return docs.select("doc_id", udf("text").alias("_r")).select(
        "doc_id", "_r.n_words", "_r.word_chars", "_r.n_symbols", "_r.n_dup_lines", "_r.n_repeat_words", "_r.base_failed", "_r.kept", "_r.anomaly"
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    udf = quality_udf(fit(docs, labels, rows))
    return docs.withColumn("_tarn_rules", udf("text")).where("_tarn_rules.kept").drop("_tarn_rules")
