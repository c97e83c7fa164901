"""All windows of a row count, in the fit as in scoring."""

import numpy as np

from tarn.llm import toxicity as t


def plain(ids):
    return [set(ids[i : i + t.WINDOW].tolist()) for i in range(0, max(1, len(ids) - t.WINDOW + t.STEP), t.STEP)]


def test_windows_hold_each_word_once_and_cover_the_text():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 500]:
        ids = rng.integers(0, 6, n)
        place, first = t.windows(ids)
        assert [sorted(ids[p[f]].tolist()) for p, f in zip(place, first)] == [sorted(x) for x in plain(ids)]
        assert set(place.ravel().tolist()) == set(range(n))


def test_the_fit_sees_every_window_of_a_long_row():
    b = t.Bags(["a b c " * 7000, "d"])
    assert (b.owner == 0).sum() == len(plain(np.zeros(21_000))) and (b.owner == 1).sum() == 1


def test_a_passage_across_a_boundary_keeps_its_evidence():
    model = {"grams": np.zeros(t.BUCKETS, np.float32), "shift": 0.0, "slope": 1.0, "middle": 0.0}
    for w in ("vile", "foul"):
        model["grams"][t.grams(w)] = 1.0
    scorer = t.Scorer(model)
    clean = "one two six ten red sky sea sun".split()
    at = [scorer.score(" ".join(clean[:k] + ["vile", "foul"] + clean[k:] * 3)) for k in range(8)]
    halves = scorer.score(" ".join(["vile", *clean]))
    assert min(at) > halves + 0.02


def test_fit_and_scoring_give_one_number():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}x" for i in range(200)]
    texts = [" ".join([*rng.choice(vocabulary, 300).tolist(), *(["vile", "foul", "rotten"] if k % 2 else [])]) for k in range(60)]
    model = t.fit(texts, np.arange(60) % 2)
    b = t.Bags(texts)
    best = np.full(60, -np.inf)
    np.maximum.at(best, b.owner, t.window_scores(b, model["grams"][b.buckets].astype(float)) + model["shift"])
    got = [t.Scorer(model).score(x) for x in texts]
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(model["slope"] * (best - model["middle"]), -30, 30))), atol=1e-4)


def test_rows_are_bounded_by_words_not_cut():
    rows = [{"text": "a b c"}, {"text": "a " * 50}, {"text": "b"}]
    assert t.within(rows, 53) == rows[:2] and t.within(rows, 2) == rows[:1] and t.within([], 5) == []
