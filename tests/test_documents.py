"""Documents through the whole chain, sinks, sets of vectors and verdicts that SQL does not reach."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import suites, vectors
from tarn.sources import store

DOCS = [
    ("run a", '{"a": 1, "note": "x, NaN, y", "v": NaN, "metrics": {"a":{"b":{"c":{"d":1.5}},"z":2}, "s": 3, "flag": true, "block_level": {"x": {"path": "p", "shape": [1, 2]}, "y": {"path": ""}}}}'),
    ("run/b", '{"metrics": {"fg": {"q": -Infinity, "r": 2.5, "w": "text"}}, "output_video": "o.mp4"}\n'),
    ("bad", '{"metrics": '),
]
METRICS = [("run a", "", "a.z", 2.0), ("run a", "", "s", 3.0), ("run a", "a.b.c", "d", 1.5), ("run/b", "fg", "r", 2.5)]


def test_scan_parse_flatten_export_scan(spark, tmp_path):
    store.export_tree(spark.createDataFrame(DOCS, "key string, doc_raw string"), str(tmp_path / "t"))
    found = store.scan_tree(spark, str(tmp_path / "t"), "part-*").select("key", "doc_raw")
    assert sorted(map(tuple, found.collect())) == sorted(DOCS)
    good, bad = store.parsed(found)
    assert [r.key for r in bad.collect()] == ["bad"]
    assert sorted(map(tuple, store.metric_rows(good, "key").select("key", "region", "metric", "value").collect())) == METRICS
    assert {r.key: r.n for r in good.select("key", F.variant_get("doc", "$.note", "string").alias("n")).collect()} == {"run a": "x, NaN, y", "run/b": None}
    store.export_tree(found, str(tmp_path / "again"))
    assert sorted(map(tuple, store.scan_tree(spark, str(tmp_path / "again"), "part-*").select("key", "doc_raw").collect())) == sorted(DOCS)


def test_artifacts_and_flat_rows(spark):
    good, _ = store.parsed(spark.createDataFrame(DOCS, "key string, doc_raw string"))
    assert sorted(map(tuple, store.artifact_rows(good, "key").collect())) == [("run a", "block_x", "p", "[1,2]"), ("run/b", "output_video", "o.mp4", None)]
    flat = {(r.key, r.path): r.value for r in store.flat_rows(good, "key").collect()}
    assert flat["run a", "metrics_a_b_c_d"] == "1.5" and flat["run a", "v"] is None and ("run a", "metrics_block_level_json") in flat and not any(p.startswith("metrics_block_level_x") for _, p in flat)
    kinds = {r.path: r.kind for r in store.union_schema(store.flat_rows(good, "key"), "key").collect()}
    assert kinds["a"] == "BIGINT" and kinds["v"] == "STRING" and kinds["metrics_flag"] == "BOOLEAN" and kinds["metrics_a_b_c_d"] == "DECIMAL"


def test_prefix_names_one_row_or_fails(spark):
    df = spark.createDataFrame([("abc", 1), ("abd", 2)], "hash string, x int")
    assert [tuple(r) for r in store.by_prefix(df, "hash", "abc").collect()] == [("abc", 1)]
    with pytest.raises(Exception, match="ambiguous"):
        store.by_prefix(df, "hash", "ab").collect()
    with pytest.raises(Exception, match="nothing starts"):
        store.by_prefix(df, "hash", "q").collect()


@pytest.mark.parametrize("form", ["csv", "tsv", "json", "parquet"])
def test_sinks(spark, tmp_path, form):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "k int, s string")
    store.save(df, str(tmp_path / form), form)
    read = spark.read.option("header", True).option("sep", "," if form == "csv" else "\t").option("inferSchema", True).csv(str(tmp_path / form)) if form in ("csv", "tsv") else getattr(spark.read, form)(str(tmp_path / form))
    assert sorted((r.k, r.s) for r in read.collect()) == [(1, "a b"), (2, "c")]
    with pytest.raises(ValueError, match="unknown format"):
        store.save(df, str(tmp_path / "x"), "xlsx")


def test_frame_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text(" frame , skip \n 1 , 36.36% \n 2 , x \n")
    assert [tuple(r) for r in store.frame_log(spark, str(tmp_path / "log.csv"), ["skip"]).collect()] == [("1", 36.36), ("2", None)]


def test_shards_are_the_library_s(spark):
    got = spark.range(50).select("id", scalar.shard_of(F.col("id").cast("string"), 4).alias("s")).collect()
    assert all(r.s == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_verdicts(spark):
    def of(deltas, low=True, family=1):
        df = spark.createDataFrame([(float(d), 1.0, low) for d in deltas], "d double, t double, low boolean").withColumn("g", F.lit(1))
        r = suites.assess(df, ["g"], "d", "t", "low", family).collect()
        return (r[0].verdict, r[0].direction) if r else None

    assert of([2.0]) == ("insufficient_pairs", "worse")
    assert of([2.0, -1.0] * 10) == ("no_consistent_direction", None) and of([0.0, 0.0, 0.0]) == ("no_consistent_direction", None)
    assert of([2.0] * 5) == ("underpowered", "worse") and of([2.0] * 6) == ("perceptual_loss", "worse") and of([-2.0] * 6) == ("perceptual_win", "better")
    assert of([2.0] * 6, low=False) == ("perceptual_win", "better") and of([0.5] * 8) == ("sub_jnd_significant", "worse")
    # a large one cannot carry many small ones
    assert of([0.1] * 7 + [40.0]) == ("sub_jnd_significant", "worse")
    assert of([2.0] * 6, family=2) == ("underpowered", "worse") and of([2.0] * 6 + [0.0] * 3) == ("perceptual_loss", "worse")


def test_frechet_against_the_matrices(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 6)), rng.normal(1, 2, size=(70, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([("a", v.tolist()) for v in x] + [("b", v.tolist()) for v in y], "g string, v array<double>").repartition(5)
    r = vectors.frechet_pairs(df, "g", "v").collect()
    s1, s2 = np.cov(x.T), np.cov(y.T)
    eig = np.linalg.eigvals(s1 @ s2)
    cov = np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(eig.real, 0)).sum()
    assert len(r) == 1 and r[0].mean_term == pytest.approx(((x.mean(0) - y.mean(0)) ** 2).sum()) and r[0].covariance_term == pytest.approx(cov)
    assert vectors.frechet(df, "g", "v", "a", "b") == (pytest.approx(r[0].mean_term), pytest.approx(cov))


def test_noise_ladder_rises(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))], "id long, v array<double>")
    got = sorted(map(tuple, vectors.noise_ladder(df, "id", "v", [0.01, 0.05, 0.2]).collect()))
    assert [x[0] for x in got] == [0.01, 0.05, 0.2] and all(x[2] for x in got)


def test_documents_are_parsed_once_and_opened_to_any_depth(spark):
    deep = '{"metrics": {"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h": 7}}}}}}}, "n": [NaN,-Infinity,"NaN, \\" NaN",1], "private": "", "bad": NaN, "x": 1}, "output_video": "o"}'
    good, bad = store.parsed(spark.createDataFrame([("k", deep), ("open", '{"a": "NaN, NaN')], "key string, doc_raw string"))
    assert [r.key for r in bad.collect()] == ["open"] and good.first().key == "k"
    assert good.select(F.to_json(F.variant_get("doc", "$.metrics.n", "variant"))).first()[0] == '[null,null,"NaN, \\" NaN",1]'
    assert sorted(map(tuple, store.metric_rows(good, "key").collect())) == [("k", "", "x", 1.0), ("k", "a.b.c.d.e.f.g", "h", 7.0)]
    assert {r.path: r.value for r in store.flat_rows(good, "key").collect()}["metrics_a_b_c_d_e_f_g_h"] == "7"
    plan = store.artifact_rows(good, "key")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1


def test_specs_filter_reads_a_built_document_once(spark):
    df = store.once(spark.createDataFrame([(1, "click"), (2, "view")], "k int, kind string"), "doc", F.parse_json(F.to_json(F.struct("kind"))))
    kept, _ = store.specs(df, {"kind": "click"})
    plan = kept._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.k for r in kept.collect()] == [1] and plan.count("parsejson") + plan.count("parse_json") == 1
