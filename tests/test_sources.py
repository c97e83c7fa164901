"""Files in and out, and the pieces that have no query of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import curves, grid, rules, stats
from tarn.sources import store


def test_tree_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("k1", '{"a": 1.0}'), ("007", "not json\nline\n")], "key string, doc_raw string")
    store.export_tree(docs, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in store.exported(spark, str(tmp_path / "t")).collect()) == sorted(tuple(r) for r in docs.collect())


def test_fresh_keeps_new_and_newer(spark):
    known = spark.createDataFrame([("a", 5), ("b", 5)], "key string, modified long")
    found = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "key string, modified long")
    assert sorted(r.key for r in store.fresh(found, known).collect()) == ["b", "c"]


def test_block_matrix(spark, tmp_path):
    (tmp_path / "m.csv").write_text("f0,f1\n1,2\n3,4\n5,x\n7,8\n")
    rows = {(r.frame, r.by, r.bx): r.value for r in store.block_matrix(spark, str(tmp_path / "m.csv"), 2).collect()}
    assert rows == {(0, 0, 0): 1, (1, 0, 0): 2, (0, 0, 1): 3, (1, 0, 1): 4, (0, 1, 0): 5, (1, 1, 0): None, (0, 1, 1): 7, (1, 1, 1): 8}


def test_attributes_sets_specs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("video,status,x\nv1,ok,1\nv2,failed,2\n")
    assert [r.video for r in store.attributes(spark, str(tmp_path / "a.csv"), ["x"]).collect()] == ["v1"]
    with pytest.raises(ValueError, match="missing columns: y"):
        store.attributes(spark, str(tmp_path / "a.csv"), ["y"])
    (tmp_path / "s.json").write_text('{"one": ["h1", "h2"],\n "two": ["h2"]}')
    assert sorted(tuple(r) for r in store.sets_of(spark, str(tmp_path / "s.json")).collect()) == [("one", "h1"), ("one", "h2"), ("two", "h2")]
    docs = spark.createDataFrame([(1, '{"codec": "x", "qp": 3}'), (2, '{"codec": "x", "qp": 3, "retired": "old"}'), (3, '{"codec": "y"}')], "id int, raw string").withColumn("doc", F.parse_json("raw"))
    kept, retired = store.specs(docs, {"codec": "x", "qp": "3"})
    assert [r.id for r in kept.collect()] == [1] and [tuple(r) for r in retired.collect()] == [("old", 1)]


def test_rules(spark):
    df = spark.createDataFrame([("x", None), ("n/a", " ")], "mark string, reason string")
    assert rules.with_reason(df, "mark", ["none"], "reason").count() == 2
    with pytest.raises(Exception, match="needs a reason"):
        rules.with_reason(df, "mark", ["n/a"], "reason").collect()
    v = spark.createDataFrame([(1.0, None), (float("nan"), ["old"]), (None, None)], "v double, stored array<string>")
    now = rules.verdict(*rules.metrics_present({"m": F.col("v")}))
    assert [r.stored for r in rules.backfill(v, "stored", now).collect()] == [[], ["old"], ["m is not a finite number"]]
    assert rules.backfill(v, "stored", now, force=True).collect()[1].stored == ["m is not a finite number"]
    q = spark.createDataFrame([("distinguishable", 5.0), ("same", 5.0), ("same", -1.0), ("same", None)], "q string, d double")
    assert [r[0] for r in q.select(rules.costs_bits(F.col("q"), F.col("d"))).collect()] == [None, "more bits at the same quality", None, "bitrate is missing on one side"]


def test_bd_quality_against_polyfit(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for c in range(4):
        fits, ends = [], []
        for arm in "AB":
            rate, q = np.sort(rng.uniform(10, 500, 6)), np.sort(rng.uniform(20, 45, 6))
            rows += [(c, arm, float(r), float(v)) for r, v in zip(rate, q)]
            fits.append(np.polyint(np.polyfit(np.log(rate), q, 3)))
            ends.append((np.log(rate).min(), np.log(rate).max()))
        lo, hi = max(e[0] for e in ends), min(e[1] for e in ends)
        a, b = (np.polyval(f, hi) - np.polyval(f, lo) for f in fits)
        want[c] = (b - a) / (hi - lo)
    got = curves.bd_quality(spark.createDataFrame(rows, "clip int, arm string, rate double, q double"), ["clip"], "arm", "A", "B", "rate", "q")
    assert {r.clip: r.bd_quality for r in got.collect()} == pytest.approx(want, rel=1e-6, abs=1e-7)


def test_components_of_a_long_snake(spark):
    rows = [(0, y, x, int(y % 2 == 0 or x == (9 if y % 4 == 1 else 0))) for y in range(9) for x in range(10)] + [(1, 0, 0, 1), (1, 2, 2, 1)]
    df = spark.createDataFrame(rows, "frame int, by int, bx int, fg int")
    got = grid.components(df.withColumn("fg", F.col("fg") == 1), ["frame"], "fg", store.written).groupBy("frame", "component").count().collect()
    assert sorted((r.frame, r.component.by, r.component.bx, r["count"]) for r in got) == [(0, 0, 0, 54), (1, 0, 0, 1), (1, 2, 2, 1)]


def test_equivalence_is_not_claimed_on_one_pair(spark):
    df = spark.createDataFrame([("a", i, 0.001 * (i % 3 - 1)) for i in range(9)] + [("b", 0, 0.0), ("c", 0, 0.0), ("c", 1, 0.01)], "g string, k int, delta double")
    got = {r.g: (r.verdict, r.thin) for r in stats.equivalence(df, ["g"], "k", 0.05).collect()}
    assert got == {"a": ("equivalent", False), "b": ("insufficient_pairs", False), "c": ("equivalent", True)}
