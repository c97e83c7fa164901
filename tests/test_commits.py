"""Commits over several tables, keyed state under any order of arrival, freshness from the listing, keys in documents."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tarn.operators import rules
from tarn.sources import store
from tarn.streaming import commits, state

FORM = "key string, doc_raw string, version long"


def verdicts(docs):
    psnr = F.try_variant_get("doc", "$.metrics.fg.psnr", "double")
    return docs.select("key", F.array_join(rules.verdict(*rules.metrics_present({"psnr": psnr})), "; ").alias("failures"))


DERIVE = {"metrics": lambda d: store.metric_rows(d, "key"), "artifacts": lambda d: store.artifact_rows(d, "key"), "verdicts": verdicts}


def doc(psnr, video=""):
    return json.dumps({"metrics": {"fg": {"psnr": psnr}}, "output_video": video})


def batch(spark, rows):
    return spark.createDataFrame(rows, FORM)


def seen(spark, where, at=None):
    out = {}
    for name, columns in (("documents", ["key", "version"]), ("metrics", ["key", "metric", "value"]), ("artifacts", ["key", "relpath"]), ("verdicts", ["key", "failures"])):
        out[name] = sorted(tuple(r) for r in commits.table(spark, where, name, at).select(*columns).collect())
    return out


def test_commits_replace_what_their_keys_had(spark, tmp_path):
    where = str(tmp_path / "s")
    with pytest.raises(LookupError):
        commits.table(spark, where, "documents")
    assert commits.commit(batch(spark, [("a", doc(30.0, "v.mp4"), 1), ("b", doc(-1.0), 1), ("c", "not json", 1), (None, doc(1.0), 1), ("a", doc(29.0), 0)]), where, 0, DERIVE, 4)
    first = seen(spark, where)
    assert first == {"documents": [("a", 1), ("b", 1)], "metrics": [("a", "psnr", 30.0), ("b", "psnr", -1.0)], "artifacts": [("a", "v.mp4")], "verdicts": [("a", ""), ("b", "psnr is not positive")]}
    assert [r.key for r in spark.read.parquet(f"{where}/rejected/batch=0").collect()] == ["c"]
    assert commits.commit(batch(spark, [("a", doc(31.0), 2), ("d", doc(5.0), 1), ("b", doc(9.0), 0), ("a", "broken", 9)]), where, 1, DERIVE, 4)
    assert seen(spark, where) == {"documents": [("a", 2), ("b", 1), ("d", 1)], "metrics": [("a", "psnr", 31.0), ("b", "psnr", -1.0), ("d", "psnr", 5.0)], "artifacts": [], "verdicts": [("a", ""), ("b", "psnr is not positive"), ("d", "")]}
    assert seen(spark, where, at=0) == first
    # again: nothing changes
    assert not commits.commit(batch(spark, [("z", doc(1.0), 1)]), where, 1, DERIVE, 4) and not commits.commit(batch(spark, [("z", doc(1.0), 1)]), where, 0, DERIVE, 4)
    now = seen(spark, where)
    assert commits.prune(spark, where) > 0 and seen(spark, where) == now and commits.prune(spark, where) == 0


@pytest.mark.parametrize("stops", ["metrics", "artifacts", "verdicts", "publish"])
def test_a_commit_that_stops_leaves_no_trace(spark, tmp_path, monkeypatch, stops):
    where = str(tmp_path / "s")
    commits.commit(batch(spark, [("a", doc(30.0, "v"), 1), ("b", doc(2.0), 1)]), where, 0, DERIVE, 2)
    before = seen(spark, where)

    def broken(*_):
        raise RuntimeError("lost")

    new = batch(spark, [("a", doc(-5.0), 2), ("e", doc(7.0, "w"), 1)])
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        if stops == "publish":
            m.setattr(commits, "_publish", broken)
        commits.commit(new, where, 1, {n: broken if n == stops else f for n, f in DERIVE.items()}, 2)
    assert seen(spark, where) == before
    assert commits.commit(new, where, 1, DERIVE, 2)
    assert seen(spark, where) == {"documents": [("a", 2), ("b", 1), ("e", 1)], "metrics": [("a", "psnr", -5.0), ("b", "psnr", 2.0), ("e", "psnr", 7.0)], "artifacts": [("e", "w")], "verdicts": [("a", "psnr is not positive"), ("b", ""), ("e", "")]}


def test_streamed_commits_and_a_lost_batch(spark, tmp_path):
    rows = [(f"k{i % 9}", doc(float(i)), i) for i in range(40)]
    random.Random(1).shuffle(rows)
    source, where, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    for i in range(0, 40, 10):
        batch(spark, rows[i : i + 10]).coalesce(1).write.mode("append").parquet(source)
    calls = []

    def once_lost(docs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return verdicts(docs)

    derive = {**DERIVE, "verdicts": once_lost}
    schema = batch(spark, rows[:1]).schema
    with pytest.raises(Exception, match="lost"):
        commits.follow(spark, source, schema, where, check, derive, 4, files=1).awaitTermination()
    assert commits.manifest(spark, where)["batch"] == 0
    commits.follow(spark, source, schema, where, check, derive, 4, files=1).awaitTermination()
    want = {}
    for k, _, v in rows:
        want[k] = max(v, want.get(k, -1))
    assert seen(spark, where)["documents"] == sorted(want.items()) and seen(spark, where)["metrics"] == sorted((k, "psnr", float(v)) for k, v in want.items())


def test_state_equals_batch_under_any_arrival(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(6)]), i, None if i % 5 == 0 else float(i)) for i in range(60)]
    form = "k string, v int, n int, x double"
    source, sink, check = (str(tmp_path / n) for n in ("in", "sink", "check"))
    for i in range(0, 60, 15):
        spark.createDataFrame(rows[i : i + 15], form).coalesce(1).write.mode("append").parquet(source)
    whole = spark.createDataFrame(rows, form)
    state.follow(spark, source, whole.schema, sink, check, ["k"], ["v", "n"], files=1).awaitTermination()
    got = state.current(spark, whole.schema, sink, ["k"], ["v", "n"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, store.keep_latest(whole, ["k"], ["v", "n"]).select("k", "v", "n", "x").collect()))
    # late rows of older versions end in the state; a newer one goes on
    sent = spark.read.parquet(f"{sink}/batch=*").count()
    spark.createDataFrame([("a", -1, 0, 1.0), ("b", None, 99, 1.0)], form).coalesce(1).write.mode("append").parquet(source)
    state.follow(spark, source, whole.schema, sink, check, ["k"], ["v", "n"], files=1).awaitTermination()
    assert spark.read.parquet(f"{sink}/batch=*").count() == sent
    spark.createDataFrame([("a", 77, 0, 1.5)], form).coalesce(1).write.mode("append").parquet(source)
    state.follow(spark, source, whole.schema, sink, check, ["k"], ["v", "n"], files=1).awaitTermination()
    assert {r.k: r.x for r in state.current(spark, whole.schema, sink, ["k"], ["v", "n"]).collect()}["a"] == 1.5


def tree(root, docs):
    for name, text in docs.items():
        os.makedirs(root / name, exist_ok=True)
        (root / name / "result.json").write_text(text)


def test_only_stale_files_are_opened(spark, tmp_path):
    root = tmp_path / "results"
    tree(root, {"a": '{"x": 1}', "b": '{"x": 2}', "_tmp": "{}", ".hid": "{}"})
    listed = store.list_tree(spark, str(root))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    first = store.refreshed(spark, str(root), spark.createDataFrame([], "key string, modified timestamp"))
    known = store.written(first.select("key", "modified"))
    assert sorted((r.key, r.doc_raw) for r in first.collect()) == [("a", '{"x": 1}'), ("b", '{"x": 2}')]
    assert store.refreshed(spark, str(root), known).collect() == []
    # other text under the old time: had it been opened, it would be seen
    times = os.stat(root / "a" / "result.json")
    (root / "a" / "result.json").write_text('{"x": 9}')
    os.utime(root / "a" / "result.json", ns=(times.st_atime_ns, times.st_mtime_ns))
    os.utime(root / "b" / "result.json", (times.st_atime + 50, times.st_mtime + 50))
    tree(root, {"c": '{"x": 3}'})
    assert sorted((r.key, r.doc_raw) for r in store.refreshed(spark, str(root), known).collect()) == [("b", '{"x": 2}'), ("c", '{"x": 3}')]
    shutil.rmtree(root / "c")


def test_the_hash_in_the_file_comes_first(spark):
    rows = [("d1", '{"experiment_hash": "h1"}', 1), ("d2", '{"x": 1}', 1), ("d3", '{"experiment_hash": ""}', 1), ("d4", '{"experiment_hash": null}', 1), ("h1", '{"x": 2}', 1), ("d5", '{"experiment_hash": "d2"}', 2), ("d6", '{"experiment_hash": {"a": 1}}', 1)]
    docs, _ = store.parsed(spark.createDataFrame(rows, "key string, doc_raw string, modified long"))
    assert sorted((r.key, r.folder) for r in store.resolved(docs).collect()) == [("d2", "d5"), ("d3", "d3"), ("d4", "d4"), ("d6", "d6"), ("h1", "h1")]
    assert sorted((r.key, r.folder) for r in store.resolved(docs, key_from="folder").collect()) == sorted((r[0], r[0]) for r in rows)
    with pytest.raises(ValueError):
        store.resolved(docs, key_from="else")
