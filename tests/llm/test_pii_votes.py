"""The votes on personal data: reliabilities against planted ones, spans that the method adds against planted spans."""

import numpy as np
import pytest

from tarn.llm import pii

IBANS = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "ES9121000418450200051332", "NL91ABNA0417164300"]


def drawn(n, rates, share, seed=1):
    """(kind, votes, count): labelers right on their share of true and of false spans."""
    rng, out = np.random.default_rng(seed), {}
    for kind, part in share.items():
        for true in rng.random(n) < part:
            right = rng.random(len(rates)) < [r[0 if true else 1] for r in rates]
            v = tuple(np.where(right == true, 1, -1).tolist())
            out[kind, v] = out.get((kind, v), 0) + 1
    return [(k, v, c) for (k, v), c in out.items()]


def test_reliabilities_and_shares_are_recovered():
    rates = [(pii.START["check"][0], 0.9), (0.8, 0.7), (0.6, 0.9), (0.9, 0.8), (0.75, 0.75)]
    post, right, share = pii.estimate(drawn(40_000, rates, {"card": 0.7, "ssn": 0.3}), rounds=200)
    assert np.allclose([right[v] for v in pii.VOTES], rates, atol=0.05)
    assert share["card"] == pytest.approx(0.7, abs=0.05) and share["ssn"] == pytest.approx(0.3, abs=0.05)
    # posteriors are those of Bayes' rule at the reliabilities
    for (kind, votes), p in post.items():
        odds = share[kind] / (1 - share[kind])
        for v, x in zip(pii.VOTES, votes):
            t, f = right[v]
            odds *= t / (1 - f) if x > 0 else (1 - t) / f
        assert p == pytest.approx(odds / (1 + odds), abs=0.01)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows, want = [], {}
    for i in range(400):
        kind = i % 5
        if kind == 0:
            text, span = f"Bitte auf Konto IBAN {IBANS[i // 5 % 5]} zahlen, danke.", ("iban", IBANS[i // 5 % 5])
        elif kind == 1:
            s = hexes(40)
            text, span = f"the api token: {s} must not leak", ("secret", s)
        elif kind == 2:
            s = f"Dr. {pii.FIRST_NAMES[i % 90]} Weber"
            text, span = f"a letter by {s} came today", ("person", s)
        elif kind == 3:
            s = f"{100 + i}-{10 + i % 80}-{1000 + i}"
            text, span = f"her social security number (ssn) {s} was lost", ("ssn", s)
        else:
            # looks like it, but is none: a wrong checksum
            bad = IBANS[i // 5 % 5][:2] + "00" + IBANS[i // 5 % 5][4:]
            text, span = f"the part {bad} is out of stock in row {i}", None
        rows.append((i, text))
        want[i] = span and f"{span[0]}:{text.index(span[1])}:{text.index(span[1]) + len(span[1])}"
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_planted_spans_are_added_and_little_else(planted):
    df, want = planted
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    added = {i: set(filter(None, r.spans.split(","))) for i, r in got.items()}
    true = {i: s for i, s in want.items() if s}
    hit = sum(s in added[i] for i, s in true.items())
    assert hit >= 0.95 * len(true)
    assert sum(len(x) for x in added.values()) - hit <= 0.05 * hit
    assert all(r.n_added == len(added[i]) == r.n_spans and r.has_personal_data == bool(added[i]) for i, r in got.items())


def test_account_numbers_prove_themselves(spark):
    wrong = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in IBANS]
    df = spark.createDataFrame([(x,) for x in IBANS + wrong], "m string")
    assert [r[0] for r in df.select(pii._check("iban")).collect()] == [True] * 5 + [False] * 5
