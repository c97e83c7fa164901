"""Periodic runs against a search through all periods, planted periods, edge rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def brute(w, least=24, exponent=3):
    """(start, length, period) of the runs, by a walk through the text for each period."""
    n, spans = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                spans.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in spans.items())


def made(rnd, sizes):
    n, letters, w = rnd.choice(sizes), rnd.choice([1, 2, 3, 8, 50]), []
    while len(w) < n:
        if rnd.random() < 0.3 and w:
            p = rnd.randint(1, min(len(w), 40))
            w += (w[-p:] * 8)[: rnd.randint(1, 8 * p)]
        else:
            w += [str(rnd.randrange(letters)) for _ in range(rnd.randint(1, 30))]
    return w[:n]


def test_cover_reaches_every_pair():
    assert {(a - b) % repeats.V for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.V))
    t = repeats.shifts()
    assert all((a + t[a, b]) % repeats.V in repeats.COVER and (b + t[a, b]) % repeats.V in repeats.COVER for a in range(repeats.V) for b in range(repeats.V))


def test_extensions():
    rnd = random.Random(1)
    s = np.array([rnd.randint(1, 2) for _ in range(300)] * 3 + [9])
    a, b = np.array([(x, y) for x in range(0, 900, 7) for y in range(x + 1, 901, 11)]).T
    want = [next(k for k in range(len(s)) if y + k >= len(s) or s[x + k] != s[y + k]) for x, y in zip(a, b)]
    assert repeats.Extensions(s)(a, b).tolist() == want


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 3), (9, 4)])
def test_runs(least, exponent):
    rnd = random.Random(least)
    for _ in range(20):
        texts = [made(rnd, [0, 1, 5, 23, 24, 25, 60, 200, 400]) for _ in range(10)]
        assert [[tuple(map(int, x)) for x in r] for r in repeats.runs_of(texts, least, exponent)] == [brute(w, least, exponent) for w in texts]


def test_grids_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "GRID_PLACES", 7)
    rnd = random.Random(4)
    texts = [made(rnd, [24, 90, 150]) for _ in range(6)]
    assert [[tuple(map(int, x)) for x in r] for r in repeats.runs_of(texts)] == [brute(w) for w in texts]


def contract(doc_id, text):
    w = (text or "").encode("utf-8", "surrogatepass").split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    dropped = {i for a, k, q in runs for i in range(a + q, a + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256("".join(f"{a},{k},{q}\n" for a, k, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


def ordered(rows):
    return sorted(map(repr, map(tuple, rows)))


EDGE = [
    (None, "a b " * 30, "a"), (40, None, "b"), (41, "", "b"), (42, " \t\n\x0b\x0c\r ", "b"), (43, "x " * 23, "b"), (44, "x " * 24, "b"), (44, "x " * 24, "b"), (45, "é　ü ß " * 12, "c"),
    (46, "a\x1cb c " * 20, "c"), (47, "one two three " * 40 + "one two", "c"), *[(i, " ".join(str(k % 13) for k in range(100)), "d") for i in range(30)],
]


def test_query_on_edges(spark, tmp_path):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, source string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(1)).withColumn("_w", F.lit(2)).withColumn("_n", F.lit(0))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert ordered(rows) == ordered(contract(d, t) for d, t, _ in EDGE)


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 6000)
    rows = repeats.digest(repeats.find_runs(repeats.planted(docs))).collect()
    assert ordered(rows) == ordered(contract(r.doc_id, r.text) for r in docs.collect())
    assert sum(r.n_runs > 0 for r in rows) > 10


def test_empty_table_and_refused_exponent(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert repeats.digest(repeats.find_runs(repeats.planted(none))).collect() == []
    with pytest.raises(ValueError):
        repeats.find_runs(none, exponent=2)


def test_operator_gives_texts_and_spans(spark):
    row = repeats.find_runs(spark.createDataFrame([("k", "start  " + "a b c " * 9 + "end")], "doc_id string, text string")).collect()[0]
    assert (row.doc_id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 29, [(1, 27, 3)], "start a b c end")


def test_a_long_text():
    rnd = random.Random(2)
    w = [str(rnd.randrange(5000)) for _ in range(300_000)]
    w[3000:90000] = (w[3000:3700] * 200)[:87000]
    w[89999], w[90000] = "left", "right"
    assert [tuple(map(int, x)) for x in repeats.runs_of([w])[0]] == [(3000, 86999, 700)]
