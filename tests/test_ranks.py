"""Ranks, numbers and order statistics of hot groups against numpy and against windows."""

import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import ranks, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = [("hot", float(rng.integers(0, 400)) / 8, float(rng.normal())) for _ in range(4000)] + [("tied", 1.0, 2.0)] * 500 + [("one", 3.0, 4.0), ("gap", None, 1.0), (None, 5.0, 1.0), (None, 6.0, 1.0), ("zero", -0.0, 1.0), ("zero", 0.0, 2.0)]
    return spark.createDataFrame(out, "g string, x double, y double").repartition(7).persist()


def test_midranks_equal_windows(rows):
    w = Window.partitionBy("g")
    want = rows.where("x IS NOT NULL").select("g", "x", (F.rank().over(w.orderBy("x")) + (F.count("*").over(Window.partitionBy("g", "x")) - 1) / 2).alias("r"), F.count("*").over(w).alias("n")).distinct()
    got = ranks.midranks(rows, ["g"], "x").select("g", "x", F.col("rank").alias("r"), F.col("of").alias("n"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))


def test_no_window_over_a_group_and_no_large_task(spark, rows):
    got = ranks.midranks(rows, ["g"], "x")
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
    assert windows and all("_part" in w for w in windows)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    big = spark.range(200_000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    counted = big.groupBy("g", "x").agg(F.count("*").alias("ties"))
    _, before = ranks.parts(counted, ["g"], ["x"], "ties")
    sizes = [r["_rows"] for r in before.collect()]
    assert len(sizes) == tasks and sum(sizes) == 200_000 and max(sizes) < 2 * 200_000 / tasks


def test_rows_keep_their_rank(rows):
    got = ranks.ranked(rows, ["g"], "x", "r")
    assert got.count() == rows.where("x IS NOT NULL").count() and {r.r for r in got.where("g = 'tied'").collect()} == {250.5}


def test_numbers_equal_windows(rows):
    d = rows.withColumn("k", F.concat_ws("|", "x", "y"))
    want = d.select("g", "k", F.row_number().over(Window.partitionBy("g").orderBy("k")).alias("i")).collect()
    got = ranks.numbered(d, ["g"], ["k"], "i").select("g", "k", "i").collect()
    assert sorted(map(repr, want)) == sorted(map(repr, got))


@pytest.mark.parametrize("group", [["g"], []])
def test_spearman(rows, group):
    pdf = rows.toPandas().dropna(subset=["x", "y"])
    got = {(r["g"] if group else None): (r["n"], r["rho"]) for r in ranks.spearman(rows.where("g IS NOT NULL"), group, "x", "y").collect()}
    known = pdf[pdf.g.notna()]
    for g, part in known.groupby("g") if group else [(None, known)]:
        rho = part.x.rank().corr(part.y.rank()) if len(part) >= 3 else None
        assert got[g][0] == len(part) and got[g][1] == (None if rho is None or np.isnan(rho) else pytest.approx(rho, abs=1e-12))


def test_spearman_of_stats_takes_the_same_way(rows):
    a = {r.g: r.rho for r in stats.spearman(rows, ["g"], "x", "y").collect()}
    assert a["tied"] is None and a["one"] is None and abs(a["hot"]) < 0.1


@pytest.mark.parametrize("upper", [False, True])
def test_quantiles(rows, upper):
    shares = {"least": 0.0, "p10": 0.1, "q1": 0.25, "mid": 0.5, "p90": 0.9, "most": 1.0}
    got = {r.g: r for r in ranks.quantiles(rows, ["g"], "x", shares, upper).collect()}
    pdf = rows.toPandas().dropna(subset=["x"])
    assert "gap" not in got
    for g in ("hot", "tied", "one", "zero"):
        x = np.sort(pdf[pdf.g == g].x.to_numpy())
        assert got[g].n == len(x)
        for name, p in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p, method="higher" if upper else "linear"), abs=1e-12)
    assert got[None].mid == (6.0 if upper else 5.5)


def test_medians_of_several_values(rows):
    got = {r.g: (r.a, r.b) for r in ranks.medians(rows, ["g"], {"a": "x", "b": F.when(F.col("y") > 0, F.col("y"))}).collect()}
    pdf = rows.toPandas()
    hot = pdf[pdf.g == "hot"]
    assert got["hot"] == (pytest.approx(np.median(hot.x)), pytest.approx(np.median(hot.y[hot.y > 0]))) and got["gap"] == (None, 1.0)


def test_empty_table(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert ranks.midranks(none, ["g"], "x").collect() == [] and ranks.quantiles(none, ["g"], "x", {"m": 0.5}).collect() == [] and ranks.spearman(none, ["g"], "x", "y").collect() == []


def test_parts_of_a_small_table_do_not_grow_with_the_partitions(spark):
    """Each part has its bounds sampled to the driver: 600 partitions sampled 60,000 rows of a table of 90,000."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        small = spark.range(90_000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).cast("long").alias("ties"))
        laid, sums = ranks.parts(small, ["g"], ["x"], "ties")
        assert sums.count() == 5 and laid.count() == 90_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
