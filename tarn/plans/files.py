"""Queries through files: what is derived from the tables is written to the shared folder and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import curves, grid, pairing, rules, stats
from tarn.plans.catalog import F1, F3, SIGN_P, blocks, load, query, runs
from tarn.plans.documents import _docs
from tarn.sources import store
from tarn.streaming import commits, state
from tarn.streaming.ingest import current, ingest


def _nations(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.max("c_acctbal"), 2).alias("top"))


@query("SELECT 'n/' || c_nationkey AS key, count(*) AS n, round(max(c_acctbal), 2) AS top FROM customer WHERE c_nationkey <> 0 GROUP BY c_nationkey")
def s1_s8_tree(spark, sf_dir):
    """Documents exported to a tree and scanned again; a name of bookkeeping is skipped."""
    name = F.when(F.col("c_nationkey") == 0, "_skipped").otherwise(F.concat(F.lit("n/"), F.col("c_nationkey").cast("string")))
    folder = store.shared_folder(spark)
    store.export_tree(_nations(spark, sf_dir).select(name.alias("key"), F.to_json(F.struct("n", "top")).alias("doc_raw")), folder)
    good, _ = store.parsed(store.scan_tree(spark, folder, "part-*"))
    return good.select("key", F.variant_get("doc", "$.n", "long").alias("n"), F.variant_get("doc", "$.top", "double").alias("top"))


@query(f"""WITH {F3}, g AS (SELECT y, x FROM range(12) a(y), range(10) b(x)), t AS (SELECT unnest(range(1, 8)) AS frame) SELECT CAST(t.frame - 1 AS INT) AS frame, CAST(y AS INT) AS "by", CAST(x AS INT) AS bx, round(v, 2) AS value FROM g CROSS JOIN t LEFT JOIN f3 ON f3.frame = t.frame AND f3."by" = y AND f3.bx = x""")
def s12_block_matrix(spark, sf_dir):
    """A matrix file: a line for each block, a column for each frame; an empty cell is no number."""
    cells = blocks(spark, sf_dir).groupBy((F.col("by") * 10 + F.col("bx")).alias("b")).pivot("frame", list(range(1, 8))).agg(F.first(F.round("v", 2)))
    line = F.concat_ws(",", *[F.coalesce(F.col(str(f)).cast("string"), F.lit("-")) for f in range(1, 8)])
    lines = spark.range(120).select(F.col("id").cast("int").alias("b")).join(cells, "b", "left").select("b", line.alias("value"))
    folder = store.shared_folder(spark)
    # one small file, as this format is: a line for each block of a frame
    head = spark.range(1).select(F.lit(-1).alias("b"), F.lit("f1,f2,f3,f4,f5,f6,f7").alias("value"))
    head.unionByName(lines).repartition(1).sortWithinPartitions("b").select("value").write.text(folder)
    return store.block_matrix(spark, folder, 10).select("frame", "by", "bx", "value")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(count(*) AS VARCHAR) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY c_nationkey")
def s13_attributes(spark, sf_dir):
    folder = store.shared_folder(spark)
    status = F.when(F.col("c_nationkey") % 3 != 0, "ok").otherwise("failed")
    _nations(spark, sf_dir).select(F.col("c_nationkey").alias("nation"), "n", status.alias("status")).write.option("header", True).csv(folder)
    return store.attributes(spark, folder, ["nation", "n"]).select("nation", "n")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS nation, round(100.0 * sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) / count(*), 2) AS share FROM customer GROUP BY c_nationkey")
def s14_frame_log(spark, sf_dir):
    """A log of padded cells and percents."""
    share = F.round(100.0 * F.count_if(F.col("c_acctbal") < 0) / F.count("*"), 2)
    rows = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(share.alias("s"))
    folder = store.shared_folder(spark)
    # one file, so that the header stands before all lines
    lines = spark.range(1).select(F.lit(-1).alias("k"), F.lit(" nation ,  share ").alias("value")).unionByName(rows.select(F.col("c_nationkey").alias("k"), F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" ,  "), F.col("s").cast("string"), F.lit("% ")).alias("value")))
    lines.repartition(1).sortWithinPartitions("k").select("value").write.text(folder)
    return store.frame_log(spark, folder, ["share"])


@query(f'WITH {F3} SELECT frame, "by", bx, v FROM f3')
def s17_block_table(spark, sf_dir):
    folder = store.shared_folder(spark)
    store.save_blocks(blocks(spark, sf_dir).select("frame", "by", "bx", "v"), folder, "frame")
    return spark.read.parquet(folder).select("frame", "by", "bx", "v")


@query('SELECT DISTINCT p_type AS "set", p_brand AS hash FROM part')
def s18_sets(spark, sf_dir):
    named = load(spark, sf_dir, "part").groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("h"))
    folder = store.shared_folder(spark)
    # a definition file is one object: types and their brands, a fixed few
    named.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "h")))).alias("value")).write.text(folder)
    return store.sets_of(spark, folder)


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0")
def j1_citable(spark, sf_dir):
    """Runs without a recorded failure that have metrics."""
    failures = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("rate"))).when(F.col("event_id") % 4 == 1, F.array().cast("array<string>"))
    r = load(spark, sf_dir, "events").select("event_id", "event_type", failures.alias("invariant_failures"))
    return store.citable(r, store.metric_rows(_docs(spark, sf_dir), "event_id"), "event_id").select("event_id", "event_type")


@query(f"""WITH {F3} SELECT frame, "by", bx, round(coalesce(0.6 * v + 0.4 * lag(v) OVER (PARTITION BY "by", bx ORDER BY frame), v), 6) AS smooth FROM f3""")
def w5_smoothed(spark, sf_dir):
    return grid.smooth_time(blocks(spark, sf_dir), ["by", "bx"], "frame", "v", 0.6).select("frame", "by", "bx", F.round("smooth", 6).alias("smooth"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE 'done' END AS mark FROM orders")
def q20_reasons(spark, sf_dir):
    """Cells that need a reason have one; one without would stop the query."""
    mark, reason = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise("done"), F.when(F.col("o_orderstatus") == "P", "pending")
    return rules.with_reason(load(spark, sf_dir, "orders").select("o_orderkey", mark.alias("mark"), reason.alias("reason")), "mark", ["n/a"], "reason").select("o_orderkey", "mark")


@query(f"WITH {F1} SELECT a.clip, CAST(a.qp AS VARCHAR) AS qp, round(b.rate - a.rate, 6) AS delta FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'A' AND b.arm = 'N' AND a.qp <> 3")
def x3_dotted_pairs(spark, sf_dir):
    """Pair keys, arm and value named by dotted keys of documents; a document that lacks a key is in no pair."""
    config = F.struct("clip", F.when(F.col("qp") != 3, F.col("qp")).alias("qp"), F.col("arm").alias("restorer"))
    d = runs(spark, sf_dir).select(F.parse_json(F.to_json(F.struct(config.alias("config"), F.struct("rate").alias("metrics")))).alias("doc"))
    named = pairing.by_keys(d, "doc", {"clip": "config.clip", "qp": "config.qp"}, {"arm": "config.restorer"}, {"value": "metrics.rate"})
    return pairing.two_arms(named, ["clip", "qp"], "arm", "A", "N", "value", "value").select("clip", "qp", F.round("delta", 6).alias("delta"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def st1_ingested(spark, sf_dir):
    """Events that arrive in files, upserted by user in a stream: the last one of each stays."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    source, where, checkpoint = (store.shared_folder(spark) for _ in range(3))
    e.repartition(3, "event_id").write.parquet(source)
    ingest(spark, source, e.schema, where, checkpoint, ["user_id"], ["event_id"], buckets=8, files=2).awaitTermination()
    return current(spark, e.schema, where)


def _event_documents(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    fg = F.struct(F.when(F.col("event_id") % 7 > 0, F.col("value") - 20).alias("psnr"))
    text = F.to_json(F.struct(F.struct(fg.alias("fg")).alias("metrics"), F.when(F.col("event_type") == "click", F.concat(F.lit("v/"), F.col("user_id").cast("string"))).alias("output_video")))
    # every 13th is cut short: a text that is no document
    return e.select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_id") % 13 == 0, F.substring(text, 1, 10)).otherwise(text).alias("doc_raw"), F.col("event_id").alias("version"))


@query("""WITH d AS (SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS kind FROM events WHERE event_id % 13 <> 0 GROUP BY 1),
v AS (SELECT d.*, CASE WHEN d.version % 7 > 0 THEN e.value - 20 END AS psnr FROM d JOIN events e ON e.event_id = d.version)
SELECT CAST(user_id AS VARCHAR) AS key, version, round(psnr, 6) AS psnr, CASE WHEN kind = 'click' THEN 'v/' || user_id END AS video, CASE WHEN psnr IS NULL THEN 'psnr is not a finite number' WHEN psnr <= 0 THEN 'psnr is not positive' ELSE '' END AS failures FROM v""")
def st1_committed(spark, sf_dir):
    """Documents that arrive in files, committed batch by batch with their metric and artifact rows and rule verdicts under one manifest."""
    docs = _event_documents(spark, sf_dir)
    source, where, checkpoint = (store.shared_folder(spark) for _ in range(3))
    docs.repartition(3, "version").write.parquet(source)
    psnr = F.try_variant_get("doc", "$.metrics.fg.psnr", "double")
    derive = {
        "metrics": lambda d: store.metric_rows(d, "key"), "artifacts": lambda d: store.artifact_rows(d, "key"),
        "verdicts": lambda d: d.select("key", F.array_join(rules.verdict(*rules.metrics_present({"psnr": psnr})), "; ").alias("failures")),
    }
    commits.follow(spark, source, docs.schema, where, checkpoint, derive, buckets=8, files=2).awaitTermination()
    metrics = commits.table(spark, where, "metrics").where("metric = 'psnr'").select("key", F.round("value", 6).alias("psnr"))
    artifacts = commits.table(spark, where, "artifacts").select("key", F.col("relpath").alias("video"))
    base = commits.table(spark, where, "documents").select("key", "version").join(metrics, "key", "left").join(artifacts, "key", "left")
    return base.join(commits.table(spark, where, "verdicts").select("key", "failures"), "key")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def st2_keyed_state(spark, sf_dir):
    """Events that arrive in files, the last one of each user held as keyed state of the stream."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    source, where, checkpoint = (store.shared_folder(spark) for _ in range(3))
    e.repartition(3, "event_id").write.parquet(source)
    state.follow(spark, source, e.schema, where, checkpoint, ["user_id"], ["event_id"], files=2).awaitTermination()
    return state.current(spark, e.schema, where, ["user_id"], ["event_id"])


def _nation_tree(spark, sf_dir):
    folder = store.shared_folder(spark)
    hash_ = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("h"), F.col("c_nationkey").cast("string")))
    store.export_tree(_nations(spark, sf_dir).select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("key"), F.to_json(F.struct(hash_.alias("experiment_hash"), "n")).alias("doc_raw")), folder)
    return folder


@query("SELECT 'n' || c_nationkey AS key, count(*) AS n FROM customer WHERE c_nationkey % 2 = 1 OR c_nationkey % 3 = 0 GROUP BY c_nationkey")
def s9_refreshed(spark, sf_dir):
    """A tree held against what is known of it: only files that are new, or newer than known, are opened."""
    folder = _nation_tree(spark, sf_dir)
    number = F.substring("key", 2, 9).cast("int")
    listed = store.list_tree(spark, folder, "part-*")
    known = listed.where(number % 2 == 0).select("key", F.when(number % 3 == 0, F.col("modified") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("modified")).alias("modified"))
    good, _ = store.parsed(store.refreshed(spark, folder, known, "part-*"))
    return good.select("key", F.variant_get("doc", "$.n", "long").alias("n"))


@query("SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'h' ELSE 'n' END || c_nationkey AS key, 'n' || c_nationkey AS folder, count(*) AS n FROM customer GROUP BY c_nationkey")
def s4_resolved_keys(spark, sf_dir):
    """Documents by the hash in their text, where they have one, else by their folder's name."""
    good, _ = store.parsed(store.scan_tree(spark, _nation_tree(spark, sf_dir), "part-*"))
    return store.resolved(good).select("key", "folder", F.variant_get("doc", "$.n", "long").alias("n"))


@query("SELECT 'region=' || n_regionkey || '/nation=' || n_nationkey AS place, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey")
def s15_reports(spark, sf_dir):
    """Reports at any depth below a root, by a pattern of their names, with the place they were found in."""
    folder = store.shared_folder(spark)
    by = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    by.select("region", "nation", F.to_json(F.struct("n")).alias("value")).write.partitionBy("region", "nation").text(folder)
    good, _ = store.parsed(store.reports(spark, folder, "part-*"))
    return good.select("place", F.variant_get("doc", "$.n", "long").alias("n"))


@query(f"""WITH {F1}, d AS (SELECT a.clip, a.qp, a.arm, round(avg(b.rate - a.rate), 6) AS d FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'R' WHERE a.arm IN ('A', 'N') GROUP BY ALL), s AS (SELECT arm, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg FROM (SELECT arm, clip, round(avg(d), 6) AS d FROM d GROUP BY ALL) GROUP BY 1), p AS (SELECT *, {SIGN_P} AS p FROM s), r AS (SELECT *, row_number() OVER (ORDER BY p, arm) AS k FROM p)
SELECT arm, n_pos, n_neg, round(p, 9) AS p, round(least(1.0, max((2 - k + 1) * p) OVER (ORDER BY k)), 9) AS p_holm FROM r""")
def t12_holm_over_contrasts(spark, sf_dir):
    from tarn.operators import suites

    c = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "R"), ("N", "R")], "rate")
    s = stats.signs(suites.per_unit(c.withColumnRenamed("a", "arm"), ["arm"], "clip", "delta"), ["arm"])
    h = stats.holm(s.withColumn("_all", F.lit(1)).select("_all", "p", "arm", "n_pos", "n_neg"), ["_all"])
    return h.select("arm", "n_pos", "n_neg", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query(None)
def t20_bd_study_with_holm(spark, sf_dir):
    """BD-rate of two contrasts for each clip, gated by their overlap, a sign test of each and Holm over both."""
    r = runs(spark, sf_dir)
    parts = []
    for a, b in (("A", "R"), ("A", "N")):
        bd = curves.bd_rate(r.where(F.col("arm").isin(a, b)), ["clip"], "arm", a, b, "rate", "bg_q")
        parts.append(bd.where("overlap >= 0.5").select(F.lit(f"{a}-{b}").alias("contrast"), "clip", F.col("bd_rate").alias("delta")))
    s = stats.signs(parts[0].unionByName(parts[1]), ["contrast"])
    return stats.holm(s.withColumn("_all", F.lit(1)).select("_all", "p", "contrast", "n_pos", "n_neg"), ["_all"]).drop("_all")
