"""Expectation-maximisation of the quality labellers: the data set the accuracies."""

import numpy as np
import pytest

from tarn.llm import quality_classifier as q


def drawn(n, good_rates, bad_rates, seed=4, share=0.85):
    """Counts of vote patterns of texts of which `share` are good, each labeller right on its share of both kinds."""
    rng, out = np.random.default_rng(seed), {}
    for good in rng.random(n) < share:
        right = rng.random(len(bad_rates)) < (good_rates if good else bad_rates)
        p = tuple(np.where(right == good, 1, -1).tolist())
        out[p] = out.get(p, 0) + 1
    return out


@pytest.mark.parametrize("share", [0.85, 0.5])
@pytest.mark.parametrize("start", [q.START, (0.8, 0.6)])
def test_planted_accuracies_are_recovered(share, start):
    rates = np.array([0.6, 0.75, 0.9, 0.9, 0.75, 0.6, 0.8, 0.7])
    counts = drawn(100_000, rates, rates, share=share)
    _, right = q.estimate(counts, rounds=300, start=start)
    assert np.allclose(right, np.stack([rates, rates], axis=1), atol=0.05)


def test_accuracy_on_bad_texts_follows_the_labeller():
    rates = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.001, 0.001])
    _, right = q.estimate(drawn(20_000, np.full(7, 0.999), rates))
    assert np.allclose([b for _, b in right], rates, atol=0.03) and min(g for g, _ in right) > 0.99


def test_more_data_weigh_more_than_the_prior():
    rates = np.array([0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.001])
    few, many = (q.estimate(drawn(n, np.full(7, 0.999), rates))[1][-1][1] for n in (200, 20_000))
    assert many < 0.01 < few < 0.3


def test_the_accuracy_of_a_labeller_that_accuses_all_falls():
    counts = drawn(20_000, np.full(7, 0.999), np.array([0.9] * 7))
    always = {}
    for p, n in counts.items():
        always[(*p[:-1], -1)] = always.get((*p[:-1], -1), 0) + n
    honest, bad = q.estimate(counts)[1][-1][0], q.estimate(always)[1][-1][0]
    assert bad < 0.02 < 0.99 < honest


def test_no_texts_give_no_estimate():
    assert q.estimate({}) == ({}, [])
