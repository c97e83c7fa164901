"""Documents: corrupt ones, nesting, upserts, citability, streaming."""

from pyspark.sql import functions as F

from tarn.sources import store
from tarn.streaming.ingest import current, ingest, prune


def test_parse_flatten_and_views(spark):
    raw = [("a", '{"metrics":{"foreground":{"psnr":30,"lpips_mean":0.1,"ok":true},"transmitted":{"foreground":{"psnr":1.5}},"fps":NaN,"stray":2,"block_level":{"x":{"y":1}}}}', ["f"]), ("b", "{broken", None), ("c", '{"metrics":{"foreground":{"psnr":31}}}', None)]
    good, bad = store.parsed(spark.createDataFrame(raw, "hash string, doc_raw string, invariant_failures array<string>"))
    assert [r.hash for r in bad.collect()] == ["b"]
    m = store.metric_rows(good, "hash")
    assert {tuple(r) for r in m.collect()} == {("a", "foreground", "psnr", 30.0), ("a", "foreground", "lpips_mean", 0.1), ("a", "transmitted.foreground", "psnr", 1.5), ("a", "", "stray", 2.0), ("c", "foreground", "psnr", 31.0)}
    assert [r.hash for r in store.citable(good, m, "hash").collect()] == ["c"]
    assert {r.metric for r in store.foreground(m).collect()} == {"psnr"}


def test_tree_scan_skips_bookkeeping(spark, tmp_path):
    for k in ("h1", "_tmp"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "result.json").write_text('{\n "a": 1\n}\n')
    assert [(r.key, r.doc_raw) for r in store.scan_tree(spark, str(tmp_path)).collect()] == [("h1", '{\n "a": 1\n}\n')]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z"), (2, 0, "w")], "k int, v int, t string")
    for i in range(4):
        df.where(F.pmod(F.col("v") + F.col("k"), F.lit(4)) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    where = str(tmp_path / "store")
    q = ingest(spark, str(tmp_path / "in" / "*"), df.schema, where, str(tmp_path / "ck"), ["k"], ["v"], buckets=8, files=1)
    q.awaitTermination()
    want = {tuple(r) for r in store.keep_latest(df, ["k"], ["v"]).select("k", "v", "t").collect()}
    assert {tuple(r) for r in current(spark, df.schema, where).collect()} == want
    folders = lambda: [p.name for p in (tmp_path / "store").glob("*/bucket=*")]
    before = folders()
    # batches wrote the buckets of their own keys alone, and only the last version of each is kept
    assert 2 < len(before) <= 4 and prune(spark, where) == len(before) - len(set(before)) > 0 and sorted(folders()) == sorted(set(before))
    assert {tuple(r) for r in current(spark, df.schema, where).collect()} == want
