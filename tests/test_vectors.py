"""Moments that add up and subtract, validity of a distance, clusters and medoids against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import clusters, vectors


def frechet(a, b):
    m = ((a.mean(0) - b.mean(0)) ** 2).sum()
    s1, s2 = np.cov(a.T), np.cov(b.T)
    w = np.linalg.eigvals(s1 @ s2)
    return m + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(w.real, 0)).sum()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = [(g, s, k, rng.normal(size=5) + 0.2 * s) for g in ("p", "q") for s in range(4) for k in range(s * 100, s * 100 + 30)]
    ref = {k: rng.normal(size=5) for k in {r[2] for r in rows}}
    rows = [(g, s, k, ref[k].tolist(), v.tolist()) for g, s, k, v in rows]
    return rows, spark.createDataFrame(rows, "g string, s int, k int, ref array<double>, own array<double>").repartition(6).persist()


def test_moments_in_small_blocks(spark, data, monkeypatch):
    rows, df = data
    monkeypatch.setattr(vectors, "BLOCK", 11)
    monkeypatch.setattr(vectors, "SALTS", 2)
    monkeypatch.setattr(vectors, "HELD", 60)
    for keys in ("g", ["g", "s"]):
        for r in vectors.moments(df, keys, "own").collect():
            x = np.array([v[4] for v in rows if v[0] == r.g and (keys == "g" or v[1] == r.s)])
            assert r.n == len(x) and np.allclose(r.total, x.sum(0)) and np.allclose(np.array(r.products).reshape(5, 5), x.T @ x)


def test_moments_add_up_and_subtract(data):
    rows, df = data
    part = vectors.moments(df, ["g", "s"], "own")
    whole = vectors.added(part, ["g"])
    for r in vectors.without(whole, part, ["g"]).collect():
        x = np.array([v[4] for v in rows if v[0] == r.g and v[1] != r.s])
        assert r.n == len(x) and np.allclose(r.total, x.sum(0)) and np.allclose(np.array(r.products).reshape(5, 5), x.T @ x)
    one = vectors.moments(df.where("s = 0"), ["g", "s"], "own")
    assert vectors.without(vectors.added(one, ["g"]), one, ["g"]).collect() == []


def test_no_task_gets_rows_of_all_tasks(spark):
    df = spark.range(0, 600, 1, 60).select(F.lit("g").alias("g"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("v"))
    plan = vectors.moments(df, "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") + plan.count("FlatMapGroupsInArrow") == 2 and "_salt" in plan
    assert vectors.moments(df, "g", "v").first().n == 600


def test_validity(data):
    rows, df = data
    got = {(r.g, r.kind, r.part): r for r in vectors.validity(df, "g", "s", "k", "ref", "own", splits=2).collect()}
    assert {k[1] for k in got} == {"score", "identity", "split", "jackknife"} and len(got) == 2 + 1 + 2 + 8
    pick = lambda g, c, drop=None: np.array([r[c] for r in rows if r[0] == g and r[1] != drop])
    for g in "pq":
        assert got[g, "score", None].distance == pytest.approx(frechet(pick(g, 3), pick(g, 4)))
        for s in range(4):
            r = got[g, "jackknife", str(s)]
            assert r.n == 90 and r.distance == pytest.approx(frechet(pick(g, 3, s), pick(g, 4, s)))
    assert got[None, "identity", None].distance == pytest.approx(0, abs=1e-7) and got[None, "identity", None].n == 120
    assert all(0 < got[None, "split", str(i)].distance < 5 for i in range(2))


def test_separated_scores(spark):
    rows = [("a", "score", 1.0), ("a", "jackknife", 0.9), ("a", "jackknife", 1.1), ("b", "score", 1.05), ("b", "jackknife", 1.0), ("b", "jackknife", 1.1), ("c", "score", 9.0), ("c", "jackknife", 9.0), ("c", "jackknife", 9.5), (None, "identity", 0.0)]
    got = {r.g: r for r in vectors.jackknife_summary(spark.createDataFrame(rows, "g string, kind string, distance double"), "g").collect()}
    assert {g: r.separated for g, r in got.items()} == {"a": False, "b": False, "c": True} and got["a"].sd == pytest.approx(0.1) and got["c"].n_sources == 2


def brute_medoid(keys, x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    best = min(range(len(x)), key=lambda i: (round(d[i].sum(), 6), keys[i]))
    return keys[best], d[best].max()


@pytest.mark.parametrize("first", [2, 64])
def test_medoids(spark, monkeypatch, first):
    monkeypatch.setattr(clusters, "FIRST", first)
    rng = np.random.default_rng(2)
    x = {g: rng.normal(size=(n, 3)) * [1, 5, 1] for g, n in (("a", 150), ("b", 1), ("c", 2), ("d", 40))}
    x["d"][:] = x["d"][0]
    x["a"][:5] += 40  # the mean is pulled away, the medoid hardly is
    rows = [(g, i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)]
    got = {r.g: r for r in vectors.medoids(spark.createDataFrame(rows, "g string, k int, v array<double>").repartition(5), "g", "k", "v").collect()}
    for g, m in x.items():
        key, radius = brute_medoid(list(range(len(m))), m)
        assert (got[g].medoid, got[g].n) == (key, len(m)) and got[g].radius == pytest.approx(radius)


def test_covered(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(60, 2)) * 0.1 + c for c in ([0, 0], [5, 0], [0, 7])])
    rows = [(i, float(a) * 1000, float(b), 4.0) for i, (a, b) in enumerate(points)] + [(900, None, 1.0, 4.0), (None, 1.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double, c double").repartition(4)
    got = sorted(clusters.covered(df, "k", ["x", "y", "c"], 3).collect())
    z = points * [1000, 1]
    z = (z - z.mean(0)) / z.std(0)
    assert [(r.members, r.formed, r.asked) for r in got] == [(60, 3, 3)] * 3
    for r in got:
        part = range(r.probe // 60 * 60, r.probe // 60 * 60 + 60)
        key, radius = brute_medoid(list(part), z[list(part)])
        assert r.probe == key and r.radius == pytest.approx(radius)
    probes = z[[r.probe for r in got]]
    assert {round(r.worst, 9) for r in got} == {round(np.sqrt(((z[:, None] - probes[None]) ** 2).sum(-1)).min(1).max(), 9)}


def test_coinciding_rows_form_fewer_clusters(spark):
    df = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(10)], "k int, x double, y double")
    got = clusters.covered(df, "k", ["x", "y"], 4).collect()
    assert [(r.members, r.radius, r.worst, r.formed, r.asked) for r in got] == [(5, 0.0, 0.0, 2, 4)] * 2
    assert clusters.covered(df.where("k < 0"), "k", ["x", "y"], 4).collect() == []


def rounds_of(monkeypatch):
    taken, numbered = [], clusters.ranks.numbered
    monkeypatch.setattr(clusters.ranks, "numbered", lambda *a: (taken.append(1), numbered(*a))[1])
    monkeypatch.setattr(clusters, "FIRST", 64)
    monkeypatch.setattr(clusters, "MOST", 64)
    return taken


def test_medoids_of_many_dimensions_see_few_candidates(spark, monkeypatch):
    taken = rounds_of(monkeypatch)
    x = np.random.default_rng(5).normal(size=(900, 64))
    x[7] *= 0.6
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "g string, k int, v array<double>")
    got = vectors.medoids(df.repartition(4), "g", "k", "v").first()
    key, radius = brute_medoid(list(range(900)), x)
    assert (got.medoid, got.n) == (key, 900) and got.radius == pytest.approx(radius) and len(taken) <= 2

def test_clusters_of_copies_see_few_candidates(spark, monkeypatch):
    taken = rounds_of(monkeypatch)
    x = np.random.default_rng(6).normal(size=(60, 2)).round(3)
    rows = [(i + 1000 * c, float(a), float(b)) for c in range(20) for i, (a, b) in enumerate(x)]
    got = clusters.covered(spark.createDataFrame(rows, "k int, x double, y double"), "k", ["x", "y"], 1).collect()
    key, radius = brute_medoid(list(range(60)), (x - x.mean(0)) / x.std(0))
    assert [(r.probe, r.members) for r in got] == [(key, 1200)] and got[0].radius == pytest.approx(radius) and len(taken) == 1


def test_clusters_read_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    df = spark.range(200).select(F.col("id").alias("k"), counted(F.col("id").cast("double")).alias("x")).withColumn("y", F.col("k") % 7)
    assert [r.members for r in clusters.covered(df, "k", ["x", "y"], 2).collect()]
    # one pass, in which the filter and the column ask for it; three before
    assert seen.value <= 400
