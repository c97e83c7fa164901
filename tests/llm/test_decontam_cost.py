"""What decontamination moves."""

import re

from tarn.llm import decontam


def test_words_of_rows_without_candidates_stay(spark, monkeypatch):
    """The table of words is joined with the candidates of its rows only after a broadcast has left those rows alone."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "a b c d e f g h i j k l m n"), (3, None)], "doc_id long, text string")
    plans, plain = [], decontam.written
    monkeypatch.setattr(decontam, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    got = decontam.contamination(docs, spark.createDataFrame([("i", text)], "item_id string, text string")).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == [(1, 40, 1), (2, 0, 0), (3, 0, 0)]
    found = next(p for p in plans if "n_hit" in p)
    assert re.search(r"Join LeftSemi, \(_rid[^\n]*rightHint=\(strategy=broadcast\)", found)


def test_candidates_do_not_go_through_the_driver(spark, monkeypatch):
    """Their files are small, since windows repeat, so Spark would broadcast them by itself; only what small() has counted is broadcast."""
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string")
    plans, plain = {}, decontam.written

    def kept(df):
        out = plain(df)
        plans[",".join(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(decontam, "written", kept)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    got = decontam.contamination(docs, spark.createDataFrame([("i", text)], "item_id string, text string"))
    assert {(r.n_hit, r.n_items) for r in got.collect()} == {(400, 1)}
    plan = plans["_rid,n_hit,_g"]
    # one broadcast, of the numbers of likely rows; the candidates are merged
    assert "SortMergeJoin" in plan and len(set(re.findall(r"BroadcastHashJoin[^\n]*", plan))) == 1 and "LeftSemi" in re.search(r"BroadcastHashJoin[^\n]*", plan)[0]


def test_long_words_are_not_broadcast(spark, monkeypatch):
    """A few windows can be large; by rows alone they were broadcast. Null strings count nothing."""
    few = spark.createDataFrame([("a" * 100,), ("b",), (None,)], "g string")
    hint = lambda: few.join(decontam.small(few), "g")._jdf.queryExecution().analyzed().toString() + few.join(decontam.small(few), "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in hint()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 101)
    assert "strategy=broadcast" in hint()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 100)
    assert "strategy=merge" in hint() and "broadcast" not in hint()
    docs, bench = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    merged = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == merged
