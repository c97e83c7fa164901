"""Periodic runs of words by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q (words q apart are the same), of max(least, exponent * q) words or more,
that no neighbouring word extends keeping the period. Texts of a task are laid one after another, each behind a word of its
own, so that no extension leaves its text.

Extensions: of the suffixes only those at places whose remainder by V is in COVER are sorted, by doubling over ranks of
V-word blocks. For any two places some shift under V brings both onto the cover; fewer than V words are compared on the
way there, the rest is a minimum over the common prefixes of sorted neighbours, from a sparse table.

Enumeration: a run of period q holds max(least, exponent * q) - q places at least whose word returns q words later, so a grid of
that step meets it. Over all periods these grids have a harmonic number of places, O(n log n). Where the words at a
place and q later are the same, extensions to both sides give the stretch; the least period of a stretch is its own,
since any other that fits three times is a multiple of it and gives the same stretch.

Null and empty texts have no words and no runs; rows that repeat each give a row; null doc_ids stay; an empty table gives
no rows; other columns are not read. A text is worked on by one task, in memory linear in its words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A difference cover modulo V, every remainder is a difference of two of its members.
V = 31
COVER = (1, 5, 11, 24, 25, 27)
#: What lies between words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Words of the texts that are laid together, and places of the grids held at once.
BATCH_WORDS, GRID_PLACES = 150_000, 1_000_000


def shifts() -> np.ndarray:
    """shifts()[a, b]: the least d for which a + d and b + d are both on the cover."""
    on = np.zeros(V, bool)
    on[list(COVER)] = True
    d = np.arange(V)
    both = on[(d[:, None, None] + d[None, :, None]) % V] & on[(d[:, None, None] + d[None, None, :]) % V]
    return both.argmax(axis=0)


class Extensions:
    """Longest common extensions to the right of any two places of a sequence of positive numbers whose last occurs nowhere else."""

    SHIFT = shifts()

    def __init__(self, s: np.ndarray):
        n = len(s)
        self.s = np.concatenate([s, np.zeros(2 * V, s.dtype)]).astype(np.uint32)
        per = n // V + 2  # places of each member of the cover; those past the end are blocks of zeros
        self.slot = np.full(V, -1)
        self.slot[list(COVER)] = np.arange(len(COVER)) * per
        place = (np.array(COVER)[:, None] + V * np.arange(per)[None, :]).ravel()
        windows = np.lib.stride_tricks.sliding_window_view(self.s, V)
        blocks = np.ascontiguousarray(windows[np.minimum(place, n)].astype(">u4")).view(f"S{4 * V}").ravel()
        levels = [np.unique(blocks, return_inverse=True)[1].astype(np.int64)]
        real = place < n
        step = 1
        while len(np.unique(levels[-1][real])) < real.sum():
            ahead = np.zeros_like(levels[-1]).reshape(len(COVER), per)
            ahead[:, : per - step] = levels[-1].reshape(len(COVER), per)[:, step:]
            levels.append(np.unique(levels[-1] * (len(place) + 1) + ahead.ravel(), return_inverse=True)[1].astype(np.int64))
            step *= 2
        order = np.flatnonzero(real)[np.argsort(levels[-1][real], kind="stable")]
        self.rank = np.zeros(len(place), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [self._neighbours(order, levels, place)]
        width = 1
        while 2 * width <= len(self.table[0]):
            t = self.table[-1]
            self.table.append(np.minimum(t[:-width], t[width:]))
            width *= 2

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """Common words of each two neighbours in sorted order: as many blocks as the ranks of each level allow, then words."""
        x, y, first = order[:-1].copy(), order[1:].copy(), place[order[:-1]]
        for k in range(len(levels) - 1, -1, -1):
            step = (levels[k][x] == levels[k][y]) << k
            x += step
            y += step
        return place[x] - first + self._compare(place[x], place[y], V)

    def _compare(self, a: np.ndarray, b: np.ndarray, most) -> np.ndarray:
        """Words that agree from a and b on, up to `most`, a number or one for each."""
        out, open_ = np.broadcast_to(np.asarray(most, np.int64), a.shape).copy(), np.arange(len(a))
        for k in range(V):
            open_ = open_[out[open_] > k]
            if not len(open_):
                break
            same = self.s[a[open_] + k] == self.s[b[open_] + k]
            out[open_[~same]] = k
            open_ = open_[same]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from a and b on; a and b differ at each index."""
        shift = self.SHIFT[a % V, b % V]
        out = self._compare(a, b, shift)
        far = np.flatnonzero(out == shift)
        x, y = a[far] + shift[far], b[far] + shift[far]
        # beyond the last word there is nothing to extend: the last word occurs once, so x and y stay inside
        x, y = self.rank[self.slot[x % V] + x // V], self.rank[self.slot[y % V] + y // V]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[far[at]] += np.minimum(t[low[at]], t[high[at] - (1 << int(k))])
        return out


def grids(sizes: np.ndarray, least: int, exponent: int):
    """Places to look at, in parts: (text, period, place) with the place counted inside its text."""
    periods = sizes // exponent
    periods[sizes < least] = 0
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least, exponent * q) - q
    count = np.maximum(sizes[text] - q - 1, 0) // step + 1
    part = (np.cumsum(count) - count) // GRID_PLACES
    for k in range(int(part[-1]) + 1 if len(part) else 0):
        lo, hi = np.searchsorted(part, [k, k + 1])
        c = count[lo:hi]
        i = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(text[lo:hi], c), np.repeat(q[lo:hi], c), i * np.repeat(step[lo:hi], c)


def runs_of(texts: list[list], least: int = 24, exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, in order of start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(sizes) or sizes.max() < least:
        return out
    ids, known = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    # a word of its own before each text, and one at the end
    at = np.cumsum(sizes + 1) - sizes
    s = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    own = np.append(at - 1, len(s) - 1)
    s[own] = len(known) + 1 + np.arange(len(own))
    words = np.ones(len(s), bool)
    words[own] = False
    s[words] = ids + 1
    found = []
    for text, q, i in grids(sizes, least, exponent):
        i = at[text] + i
        keep = np.flatnonzero(s[i] == s[i + q])
        found.append((text[keep], q[keep], i[keep]))
    text, q, i = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return out
    ahead = Extensions(s)(i, i + q)
    back = Extensions(s[::-1])(len(s) - 1 - i, len(s) - 1 - i - q) - 1
    start, length = i - back, back + q + ahead
    good = length >= np.maximum(least, exponent * q)
    rows = pd.DataFrame({"text": text[good], "start": (start - at[text])[good], "length": length[good], "q": q[good]})
    rows = rows.groupby(["text", "start", "length"], as_index=False)["q"].min().sort_values(["text", "start", "q"])
    for t, a, n, p in rows.itertuples(index=False):
        out[t].append((a, n, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def find_runs(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeated periods, of each row.

    Words are runs of characters that are no ASCII white space, numbered from 0. exponent is 3 or more.
    """
    if exponent < 3:
        raise ValueError("stretches that hold fewer than three periods have no single least one")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches):
        for batch in batches:
            held, ids, n = [], batch.column(0), 0
            first = 0
            for k, text in enumerate(batch.column(1)):
                held.append((text.as_py() or "").encode("utf-8", "surrogatepass").split())
                n += len(held[-1])
                if n >= BATCH_WORDS or k == batch.num_rows - 1:
                    runs = runs_of(held, least, exponent)
                    columns = [
                        ids[first : k + 1], pa.array([len(w) for w in held], pa.int64()), pa.array([[dict(zip(("start", "length", "period"), map(int, x))) for x in r] for r in runs], pa.list_(run)),
                        pa.array([collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(held, runs)], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
                    held, n, first = [], 0, k + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (ties: smallest start, then period) and hashes, from find_runs()."""
    # fractions compare by cross products of whole numbers, which hold for texts of up to 3 * 10 ** 9 words
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda s, x: F.when(more(x, s), x).otherwise(s))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period",
        F.expr("(1000 * _b.length) div _b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """docs with periods planted into every tenth text, as the query's contract has it.

    By h = crc32 of doc_id and g = floor(h / 10): from word a = g mod n on, word i is that at a + (i - a) mod (1 + (n - a) / (3 + g mod 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.array_remove(F.split("text", BLANKS), "")
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, w)).withColumn("_g", F.floor(h / 10)).withColumn("_n", F.size("_w"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    moved = F.transform("_w", lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return chosen.withColumn("text", F.when(F.col("_n") > 0, F.array_join(moved, " ")).otherwise(F.col("text"))).drop("_w", "_g", "_n", "_a", "_p")
