"""Exact tests, corrections, fits and pairing on tiny literal tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import curves, frontier, grid, pairing, stats, vectors


def test_sign_test_published_values(spark):
    df = spark.createDataFrame([(11, 0), (10, 0), (6, 0), (5, 0), (0, 0), (3, 3)], "a long, b long").select(scalar.sign_test_p(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([0.0009765625, 0.001953125, 0.03125, 0.0625, 1.0, 1.0])


def test_floor_and_needed_pairs(spark):
    df = spark.createDataFrame([(2,), (5,), (6,), (9,)], "n long").select(scalar.sign_test_floor(F.col("n")).alias("f"))
    assert [round(r.f, 4) for r in df.collect()] == [0.5, 0.0625, 0.0312, 0.0039]
    assert scalar.pairs_needed(0.05) == 6 and scalar.pairs_needed(0.05, 14) == 10


def test_holm_is_monotone_and_padding_costs(spark):
    df = spark.createDataFrame([("a", 0.0009765625), ("b", 0.001953125), ("c", 0.5)], "name string, p double").withColumn("g", F.lit(1))
    got = {r.name: r.p_holm for r in stats.holm(df, ["g"], family=14).collect()}
    assert got["a"] == pytest.approx(0.0137, abs=1e-4) and got["b"] == pytest.approx(0.0254, abs=1e-4) and got["c"] == 1.0


def test_wilcoxon_equals_enumeration(spark):
    d = [1.0, -2.0, 2.0, 3.0, 3.0, -1.0, 4.0, 0.0]
    got = stats.wilcoxon(spark.createDataFrame([(1, x) for x in d], "g int, delta double"), ["g"]).first()
    x = np.array([v for v in d if v])
    order = np.abs(x)
    rank = np.array([(order < v).sum() + ((order == v).sum() + 1) / 2 for v in order])
    sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product([0, 1], repeat=len(x))]
    w = rank[x > 0].sum()
    low = min(w, rank.sum() - w)
    assert got.n == 7 and got.p_exact == pytest.approx(min(1.0, 2 * np.mean(np.array(sums) <= low + 1e-9)))


def test_spearman_null_on_constant_side(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 2.0), (2, 1.0, 5.0), (2, 2.0, 6.0), (2, 3.0, 9.0)], "g int, x double, y double")
    assert {r.g: r.rho for r in stats.spearman(df, ["g"], "x", "y").collect()} == {1: None, 2: pytest.approx(1.0)}


def test_effect_size_null_when_nothing_varies(spark):
    df = spark.createDataFrame([(1, 1e6), (1, 1e6), (2, 1.0), (2, 3.0)], "g int, delta double")
    assert {r.g: r.dz for r in stats.effect_size(df, ["g"]).collect()} == {1: None, 2: pytest.approx(2 / np.sqrt(2))}


def test_bootstrap_is_the_same_in_any_partitioning(spark):
    df = spark.createDataFrame([(1, i, float(i * i % 7)) for i in range(12)], "g int, k int, v double")
    a, b = stats.bootstrap(df, ["g"], "k", "v", 100).first(), stats.bootstrap(df.repartition(3, "v"), ["g"], "k", "v", 100).first()
    assert a == b and a.lo <= np.mean([i * i % 7 for i in range(12)]) <= a.hi


def test_permutation_p_is_never_zero(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i)) for i in range(9)], "g int, k int, x double, y double")
    assert stats.permutation(df, ["g"], "k", "x", "y", 50).first().p == pytest.approx(1 / 51, abs=1e-3)


def test_cubic_equals_least_squares_and_bd_rate_is_sign_free(spark):
    rng = np.random.default_rng(1)
    rows = [("c", arm, float(q), float(np.exp(0.1 * q + 0.002 * q * q + off + rng.normal(0, 0.01)))) for arm, off in (("A", 0.0), ("B", -0.1)) for q in (20, 23, 25, 30, 34, 37)]
    df = spark.createDataFrame(rows, "clip string, arm string, q double, rate double")
    got = curves.bd_rate(df, ["clip"], "arm", "A", "B", "rate", "q").first()
    fit = lambda arm: np.polyint(np.polyfit([r[2] for r in rows if r[1] == arm], np.log([r[3] for r in rows if r[1] == arm]), 3))
    area = lambda p: np.polyval(p, 37) - np.polyval(p, 20)
    assert got.bd_rate == pytest.approx(100 * (np.exp((area(fit("B")) - area(fit("A"))) / 17) - 1), abs=1e-5)
    flipped = curves.bd_rate(df.withColumn("q", -F.col("q")), ["clip"], "arm", "A", "B", "rate", "q").first()
    assert flipped.bd_rate == pytest.approx(got.bd_rate, abs=1e-6)
    short = curves.bd_rate(df.where("q < 30"), ["clip"], "arm", "A", "B", "rate", "q").first()
    assert short.bd_rate is None


def test_pairing_keeps_first_of_duplicates_and_complete_units(spark):
    df = spark.createDataFrame([("c", "A", 1, 1.0, "h1"), ("c", "A", 1, 9.0, "h2"), ("c", "B", 1, 3.0, "h3"), ("d", "A", 1, 1.0, "h4")], "clip string, arm string, qp int, v double, h string")
    assert [(r.clip, r.delta) for r in pairing.two_arms(df, ["clip", "qp"], "arm", "A", "B", "v", "h").collect()] == [("c", 2.0)]
    assert {r.clip for r in pairing.complete(df, "clip", ["arm", "qp"]).collect()} == {"c"}


def test_lead_of_exactly_the_threshold_separates(spark):
    df = spark.createDataFrame([("x", "a", 0.1), ("x", "b", 0.15), ("y", "a", 0.1), ("z", "a", 0.1), ("z", "b", 0.149)], "cell string, arm string, s double")
    assert {r.cell: r.separable for r in frontier.decide(df, ["cell"], "arm", "s", 0.05).collect()} == {"x": True, "y": False, "z": False}


def test_pooling_keeps_constants(spark):
    df = spark.createDataFrame([(1, y, x, 3.5) for y in range(7) for x in range(6)], "f int, by int, bx int, v double")
    got = grid.pool(df, ["f"], "v", 20, 64, 130, 110).collect()
    assert {(r.sy, r.sx) for r in got} == {(y, x) for y in range(3) for x in range(2)} and all(abs(r.v - 3.5) < 1e-12 for r in got)


def test_frechet_of_equal_sets_is_nothing(spark):
    rng = np.random.default_rng(0)
    rows = [(g, [float(x) for x in v]) for g in (0, 1) for v in np.random.default_rng(5).normal(size=(40, 4))] + [(2, [float(x) for x in v + 1]) for v in rng.normal(size=(40, 4))]
    df = spark.createDataFrame(rows, "g int, v array<float>")
    m, c = vectors.frechet(df, "g", "v", 0, 1)
    assert m == pytest.approx(0, abs=1e-9) and c == pytest.approx(0, abs=1e-6)
    assert vectors.frechet(df, "g", "v", 0, 2)[0] > 1
