"""Cells, fronts, ladders and pairing on rows that repeat, lack values or lie on a threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import frontier, grid, pairing, suites, summaries


def front(rows):
    """Rows (cell, arm, lower, lower, higher) that no other of the cell dominates, on the axes that both have."""

    def over(b, a):
        both = [(x, y) for x, y in ((b[2], a[2]), (b[3], a[3]), (None if b[4] is None else -b[4], None if a[4] is None else -a[4])) if x is not None and y is not None]
        return all(x <= y for x, y in both) and any(x < y for x, y in both)

    return sorted(a[1] for a in rows if not any(over(b, a) for b in rows if b is not a and b[0] == a[0]))


def test_an_axis_that_one_lacks_does_not_save_it(spark):
    df = spark.createDataFrame([("c", "a", 1.0, 1.0, None), ("c", "b", 2.0, 2.0, 5.0), ("c", "d", None, None, None)], "cell string, arm string, x double, y double, t double")
    assert {r.arm for r in frontier.undominated(df, ["cell"], "arm", ["x", "y"], ["t"]).collect()} == {"a", "d"}


@pytest.mark.parametrize("n,seed", [(60, 1), (900, 2)])
def test_fronts_equal_brute_force(spark, n, seed):
    rng = np.random.default_rng(seed)
    axis = lambda gaps: None if rng.random() < gaps else float(rng.integers(0, 40))
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "small", f"a{i}", axis(0.05), axis(0.2), axis(0.3)) for i in range(n)]
    rows += [("hot", f"r{i}", 3.0, 3.0, None) for i in range(4)]
    df = spark.createDataFrame(rows, "cell string, arm string, x double, y double, t double").repartition(5)
    assert sorted(r.arm for r in frontier.undominated(df, ["cell"], "arm", ["x", "y"], ["t"]).collect()) == front(rows)


def test_a_front_of_many_blocks_on_a_hot_cell(spark):
    rng = np.random.default_rng(3)
    rows = [("c", f"a{i}", float(x), float(1000 - x + rng.integers(0, 3)), None) for i, x in enumerate(rng.permutation(1000))]
    df = spark.createDataFrame(rows, "cell string, arm string, x double, y double, t double")
    assert sorted(r.arm for r in frontier.undominated(df, ["cell"], "arm", ["x", "y"], ["t"]).collect()) == front(rows)


def decided(spark, rows, threshold=0.05):
    df = spark.createDataFrame(rows, "cell string, arm string, s double, ok boolean")
    return {r.cell: r for r in frontier.decided(df, ["cell"], "arm", "s", threshold, F.col("ok")).collect()}


def test_decided_cells(spark):
    got = decided(spark, [
        ("sep", "a", 0.20, True), ("sep", "b", 0.25, True), ("sep", "c", 0.1, False),
        ("tie", "a", 0.20, True), ("tie", "b", 0.24, True), ("tie", "c", 0.249, True), ("tie", "d", 0.26, True),
        ("one", "a", 0.20, True), ("one", "b", 0.10, None), ("none", "a", 0.2, False), ("none", "b", None, True), ("small", "a", 0.2, True), ("twice", "a", 0.2, True), ("twice", "a", 0.2, True), ("twice", "b", 0.9, True),
    ])
    assert (got["sep"].verdict, got["sep"].winner, got["sep"].runner_up, got["sep"].n_eligible, got["sep"].tied) == ("separable", "a", "b", 2, [])
    assert (got["tie"].verdict, got["tie"].winner, got["tie"].leader, got["tie"].tied) == ("tie_within_threshold", None, "a", ["a", "b", "c"])
    assert (got["one"].verdict, got["one"].winner, got["one"].margin) == ("single_eligible_arm", "a", None)
    assert (got["none"].verdict, got["none"].winner, got["none"].n_arms, got["none"].n_eligible) == ("no_eligible_arm", None, 2, 0)
    assert "small" not in got
    assert (got["twice"].verdict, got["twice"].margin, got["twice"].tied) == ("tie_within_threshold", 0.0, ["a", "a"])


def test_threshold_classes(spark):
    df = spark.createDataFrame([("r", "a", 0.0), ("r", "b", 0.006), ("t", "a", 0.0), ("t", "b", 0.004), ("n", "a", 0.0), ("n", "b", 0.0005)], "cell string, arm string, s double")
    classes = lambda t: {r.cell: r["class"] for r in frontier.threshold_classes(df, ["cell"], "arm", "s", t).collect()}
    assert classes([0.001, 0.003, 0.005]) == {"r": "robust", "t": "tight_only", "n": "never"}
    assert classes([0.003]) == {"r": "robust", "t": "robust", "n": "never"}


def test_threshold_classes_count_every_threshold(spark):
    df = spark.createDataFrame([(c, a, s) for c, lead in (("r", 0.006), ("t", 0.004), ("u", 0.002), ("n", 0.0005)) for a, s in (("a", 0.0), ("b", lead))], "cell string, arm string, s double")
    got = {r.cell: (r["class"], r.held) for r in frontier.threshold_classes(df, ["cell"], "arm", "s", [0.005, 0.001, 0.003]).collect()}
    assert got == {"r": ("robust", 3), "t": ("tight_only", 2), "u": ("tight_only", 1), "n": ("never", 0)}


def test_a_bitstream_votes_once(spark):
    bits = [(1.0, 5.0), (2.0, 4.2), (3.0, 2.9), (4.0, 2.1)]
    rows = [("c", f"s{i}", f"f{k}", x, y) for i, (x, y) in enumerate(bits) for k in range(30 if i == 3 else 1)] + [("up", f"s{i}", "f", float(i), float(i)) for i in range(4)] + [("two", "s0", "f", 1.0, 2.0), ("two", "s1", "f", 2.0, 1.0), ("c", "s9", "f", 9.0, None)]
    got = frontier.ladders(spark.createDataFrame(rows, "cell string, config string, fill string, x double, y double"), ["cell"], "config", "x", "y", 0.5, ["fill"]).collect()
    x, y = np.array(bits).T
    slope, at = np.polyfit(x, y, 1)
    assert len(got) == 33 and {r.points for r in got} == {4} and {r.cell for r in got} == {"c"}
    for r in got:
        assert r.slope == pytest.approx(slope) and r.residual == pytest.approx((slope * r.x + at - r.y) / 0.5)
        rest = x != r.x
        assert r.influence == pytest.approx(slope - np.polyfit(x[rest], y[rest], 1)[0])


def test_a_baseline_is_one_row(spark):
    df = spark.createDataFrame([("c", "A", 1.0, 9.0, "h2"), ("c", "A", 5.0, 2.0, "h1"), ("c", "B", 7.0, 7.0, "h3"), ("d", "B", 1.0, 1.0, "h4")], "cell string, arm string, x double, y double, h string")
    pair = lambda **k: [(r.base_x, r.base_y) for r in pairing.star(df, ["cell"], "arm", "A", ["x", "y"], **k).collect()]
    assert pair() == [(1.0, 9.0)] and pair(order=["h"]) == [(5.0, 2.0)] and pair(order=["h"], last=True) == [(1.0, 9.0)]


def test_contrasts_survive_repeated_and_null_arms(spark):
    rows = [("c", "A", 1.0, 2), ("c", "A", 9.0, 1), ("c", None, 3.0, 1), ("c", "B", 4.0, 1), ("d", "A", 1.0, 1), ("d", "B", None, 1), ("e", "A", None, 0), ("e", "A", 2.0, 1), ("e", "B", 5.0, 1)]
    df = spark.createDataFrame(rows, "cell string, arm string, v double, k int")
    got = suites.contrasts(df, ["cell"], "arm", [("A", "B"), ("B", "A")], "v", ["k"]).collect()
    assert sorted((r.cell, r.a, r.b, r.delta) for r in got) == [("c", "A", "B", -5.0), ("c", "B", "A", 5.0), ("e", "A", "B", 3.0), ("e", "B", "A", -3.0)]
    assert {r.delta for r in suites.contrasts(df.where("cell = 'c'"), ["cell"], "arm", [("A", "B")], "v").collect()} == {3.0}


def test_linked_runs_and_reasons(spark):
    rows = [("v", "t1", "roi", 1.0, 1), ("v", "t2", "roi", 2.0, 2), ("v", None, "roi", 3.0, 3), ("v", "t1", "base", 9.0, 5), ("v", "t1", "base", 8.0, 4), ("v", None, "base", 7.0, 6)]
    found, reasons = pairing.linked(spark.createDataFrame(rows, "clip string, target string, arm string, v double, h int"), ["clip", "target"], "arm", "roi", "base", ["v"], ["h"])
    assert [(r.h, r.base_v) for r in found.collect()] == [(1, 8.0)]
    assert {r.reason: r.n for r in reasons.collect()} == {"no_key": 1, "no_baseline": 1}


def test_ambiguous_keys_are_refused_also_when_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 2)], "k string, v int")
    alone, many = pairing.refuse_ambiguous(df, ["k"])
    assert [tuple(r) for r in alone.collect()] == [("b", 1)] and sorted((repr(r.k), r.n) for r in many.collect()) == [("'a'", 2), ("None", 2)]


def test_needed_pairs_take_alpha_itself():
    assert scalar.pairs_needed(0.0625) == 5 and scalar.pairs_needed(0.05) == 6 and scalar.pairs_needed(0.05, 14) == 10


def test_identities_do_not_collide(spark):
    maps = [{"a": "1,b=2"}, {"a": "1", "b": "2"}, {"a": '1","b":"2'}, {"a": None}, {"a": "null"}, {"a": ""}, {}, {"a": "x\\", "b": "y"}, {"a": 'x\\"', "b": "y"}, {"a": "x\ny"}, {"a": "x\\ny"}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    got = df.select(scalar.identity(F.col("m"), ["fill"]).alias("t"), scalar.content_hash(F.map_entries("m")).alias("h")).collect()
    assert len({r.t for r in got}) == len({r.h for r in got}) == len(maps) and got[1].t == '{"a":"1","b":"2"}'


def test_sweeps_by_arm_with_missing_keys(spark):
    rows = [("op", {"arm": "x", "k": "1", "r": "5"}), ("op", {"arm": "x", "k": "2", "r": "5"}), ("op", {"arm": "y", "k": "1", "r": "5"}), ("op", {"arm": "x", "r": "5"}), ("other", {"arm": "x", "k": "3", "r": "5"})]
    got = summaries.single_key_sweeps(spark.createDataFrame(rows, "op string, c map<string,string>"), "c", ["op"], ["arm"]).collect()
    assert [(r.op, r.key, r.rest, r.settings, r.runs) for r in got] == [("op", "k", '{"arm":"x","r":"5"}', 3, 3)]


def test_capture_has_one_definition(spark):
    df = spark.createDataFrame([(1, i, float(i), float((i * 3) % 5)) for i in range(5)], "f int, p int, s double, g double")
    down, up = grid.oracle_capture(df, ["f"], "s", "g", ["p"], 0.5).first(), summaries.capture(df, ["f"], "s", "g", ["p"], 0.5).first()
    assert down.capture == pytest.approx((2 + 4) / (4 + 3)) and up.ratio == pytest.approx((2 + 4 + 1) / (4 + 3 + 2)) and up.random == pytest.approx(3 * 2.0 / 9)
