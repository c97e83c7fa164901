"""Queries of documents: metric, artifact and flat rows, schemas, provenance, picks, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import pairing, rules, summaries
from tarn.plans.catalog import F1, load, query, runs, spread
from tarn.sources import store


def _docs(spark, sf_dir):
    """A nested document for each event."""
    e = spread(load(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k")
    raw = F.format_string(
        '{"user":%s,"tags":["%s","t"],"note":"x, NaN, y","output_video":"%s","metrics":{"plain":%s,"fg":{"value":%s,"bad":NaN,"ok":true},"deep":{"a":{"b":{"k":%s}},"z":%s},"block_level":{"ssim":{"path":"b/%s.csv","shape":[4,%s]}}}}',
        F.col("user_id").cast("string"), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("v/"), F.col("event_id").cast("string"))), F.col("user_id").cast("string"),
        F.coalesce(F.col("value").cast("string"), F.lit("null")), F.coalesce(k, F.lit("null")), (F.col("event_id") % 7).cast("string"), F.col("event_id").cast("string"), F.coalesce(k, F.lit("0")),
    )
    return store.parsed(e.select("event_id", raw.alias("doc_raw")))[0]


_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
_METRICS = f"""m AS (
  SELECT event_id, '' AS region, 'plain' AS metric, CAST(user_id AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'fg', 'value', value FROM events WHERE value IS NOT NULL
  UNION ALL SELECT event_id, 'deep.a.b', 'k', {_K} FROM events WHERE {_K} IS NOT NULL UNION ALL SELECT event_id, '', 'deep.z', CAST(event_id % 7 AS DOUBLE) FROM events
)"""
_ARTIFACTS = """a AS (
  SELECT event_id, 'block_ssim' AS kind, 'b/' || event_id || '.csv' AS relpath, '[4,' || coalesce(json_extract_string(props, '$.k'), '0') || ']' AS shape FROM events
  UNION ALL SELECT event_id, 'output_video', 'v/' || event_id, NULL FROM events WHERE event_id % 3 <> 0
)"""


@query(f"WITH {_METRICS} SELECT * FROM m")
def p1_nested_metric_rows(spark, sf_dir):
    return store.metric_rows(_docs(spark, sf_dir), "event_id")


@query(f"WITH {_ARTIFACTS} SELECT * FROM a")
def p4_artifact_rows(spark, sf_dir):
    return store.artifact_rows(_docs(spark, sf_dir), "event_id")


@query(f"WITH {_METRICS}, {_ARTIFACTS} SELECT event_id, 'metric' AS level, CASE WHEN region = '' THEN metric ELSE region || '.' || metric END AS name, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT event_id, 'artifact', kind, count(*) FROM a GROUP BY ALL")
def u6_levels_together(spark, sf_dir):
    return store.derived_levels(_docs(spark, sf_dir), "event_id").groupBy("event_id", "level", "name").agg(F.count("*").alias("n"))


@query(f"""SELECT event_id, CAST(user_id AS VARCHAR) AS "user", '2' AS tags_n, '["' || event_type || '","t"]' AS tags_json, 'x, NaN, y' AS note, CAST(CAST({_K} AS BIGINT) AS VARCHAR) AS metrics_deep_a_b_k,
'{{"ssim":{{"path":"b/' || event_id || '.csv","shape":[4,' || coalesce(json_extract_string(props, '$.k'), '0') || ']}}}}' AS metrics_block_level_json FROM events""")
def p2_flat_columns(spark, sf_dir):
    return store.wide(store.flat_rows(_docs(spark, sf_dir), "event_id"), "event_id", ["user", "tags_n", "tags_json", "note", "metrics_deep_a_b_k", "metrics_block_level_json"])


@query(f"""SELECT * FROM (VALUES ('user', 'BIGINT'), ('tags_n', 'BIGINT'), ('tags_json', 'STRING'), ('note', 'STRING'), ('output_video', 'STRING'), ('metrics_plain', 'BIGINT'), ('metrics_fg_ok', 'BOOLEAN'), ('metrics_fg_bad', 'STRING'),
('metrics_deep_a_b_k', 'BIGINT'), ('metrics_deep_z', 'BIGINT'), ('metrics_block_level_json', 'STRING'), ('metrics_fg_value', 'DECIMAL')) v(path, kind)""")
def p3_union_schema(spark, sf_dir):
    """All columns and their types."""
    return store.union_schema(store.flat_rows(_docs(spark, sf_dir), "event_id"), "event_id").select("path", "kind")


@query("SELECT event_id, 'x, NaN, y' AS note, true AS same FROM events")
def s2_s5_parsed_and_canonical(spark, sf_dir):
    """Text in strings survives the tolerant parse; the canonical text does not depend on the order of keys."""
    d = _docs(spark, sf_dir)
    again = F.parse_json(store.canonical(F.col("doc")))
    return d.select("event_id", F.variant_get("doc", "$.note", "string").alias("note"), (store.canonical(again) == store.canonical(F.col("doc"))).alias("same"))


@query("SELECT event_id, user_id, value FROM events WHERE value > 60 AND event_type = 'click' ORDER BY event_id")
def s11_matching_runs(spark, sf_dir):
    return store.matching(load(spark, sf_dir, "events"), "value > 60 AND event_type = 'click'", "event_id").select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 321")
def s10_by_prefix(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("hash", F.md5(F.col("event_id").cast("string").cast("binary")))
    return store.by_prefix(e, "hash", "caf1a3dfb505ffed0d024130f58c5cfa"[:12]).select("event_id", "user_id", "event_type", "value")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, c_name, c_mktsegment, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 20")
def s20_provenance(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), F.col("o_custkey").alias("c_custkey"))
    p = store.provenance(o, load(spark, sf_dir, "customer").where("c_nationkey < 20"), "c_custkey", ["c_name", "c_mktsegment"])
    return p.select("o_orderkey", "price", "run.c_name", "run.c_mktsegment", "found")


@query(f"WITH {_ARTIFACTS}, h AS (SELECT event_id FROM a WHERE kind IN ('block_ssim', 'output_video') GROUP BY 1 HAVING count(DISTINCT kind) = 2) SELECT event_type, user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_id IN (SELECT event_id FROM h) GROUP BY 1, 2")
def s21_replayable(spark, sf_dir):
    r = load(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return store.replayable(r, store.artifact_rows(_docs(spark, sf_dir), "event_id"), "event_id", ["event_type", "user_id"], ["block_ssim", "output_video"])


@query("SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def s22_first_runs(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice")
    return store.first_of(o, ["o_orderpriority", "o_orderstatus"], ["o_orderkey"])


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS value FROM customer""")
def s16_payload(spark, sf_dir):
    return store.payload(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


@query("SELECT p_type || '+' || coalesce(CASE WHEN p_size > 25 THEN split_part(p_name, ' ', 1) END, 'none') AS arm, p_size <= 25 AS is_control, count(*) AS n FROM part GROUP BY 1, 2")
def p11_arm_labels(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_type").alias("transport"), F.when(F.col("p_size") > 25, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("fill"))
    return p.groupBy(scalar.arm_label(F.col("transport"), F.col("fill")).alias("arm"), F.col("fill").isNull().alias("is_control")).agg(F.count("*").alias("n"))


@query(f"WITH {F1} SELECT clip, qp, arm, region, CASE region WHEN 'foreground' THEN fg_q WHEN 'background' THEN bg_q ELSE rate END AS value, region <> 'overall' AS gates FROM f1, (VALUES ('foreground'), ('background'), ('overall')) v(region)")
def p13_resolved_metrics(spark, sf_dir):
    """A region's metric by its key, from a table of the keys; a banned one is an error."""
    table = [("foreground", "q", "fg_q", True), ("background", "q", "bg_q", True), ("overall", "q", "rate", False)]
    asked = runs(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, ("foreground", "background", "overall")))).alias("region"))
    return summaries.resolved(asked, "region", "q", table, banned=["fid_fg_bbox"]).select("clip", "qp", "arm", "region", "value", "gates")


@query(f"WITH {F1} SELECT a.clip, a.qp, round(b.bg_q - a.bg_q, 6) AS delta, abs(b.bg_q - a.bg_q) < 0.005 AS within, round(abs(b.bg_q - a.bg_q) / 0.005, 6) AS margin, CASE WHEN abs(b.bg_q - a.bg_q) < 0.005 THEN 'tie' WHEN b.bg_q < a.bg_q THEN 'b' ELSE 'a' END AS better FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'A' AND b.arm = 'R'")
def p14_compared(spark, sf_dir):
    two = pairing.two_arms(runs(spark, sf_dir), ["clip", "qp"], "arm", "A", "R", "bg_q", "qp")
    c = summaries.compared(two, "value_a", "value_b", 0.005, True)
    return c.select("clip", "qp", F.round("delta", 6).alias("delta"), "within", F.round("margin", 6).alias("margin"), "better")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size IN (1, 5, 9, 14) GROUP BY 1")
def p17_members(spark, sf_dir):
    return summaries.members(load(spark, sf_dir, "part"), {"p_type": ["ECONOMY", "STANDARD"], "p_size": [1, 5, 9, 14]}).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def p18_pinned(spark, sf_dir):
    """Runs of a pinned list of keys, kept as a table."""
    pins = load(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(pins, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query(f"SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN {_K} END, value, -1) AS value FROM events")
def p21_first_known(spark, sf_dir):
    """The first source that has a value, in their order."""
    d = _docs(spark, sf_dir)
    k = F.when(F.col("event_id") % 4 == 0, F.try_variant_get("doc", "$.metrics.deep.a.b.k", "double"))
    return d.select("event_id", scalar.first_known(k, F.try_variant_get("doc", "$.metrics.nowhere", "double"), F.try_variant_get("doc", "$.metrics.fg.value", "double"), F.lit(-1.0)).alias("value"))


@query("SELECT doc_id, regexp_replace(regexp_replace(source || '/' || lang || '_360x240.mp4', '^.*/', ''), '(_[0-9]+x[0-9]+)?(\\.[a-z0-9]+)?$', '') AS name FROM documents")
def p24_clean_names(spark, sf_dir):
    path = F.concat("source", F.lit("/"), "lang", F.lit("_360x240.mp4"))
    return load(spark, sf_dir, "documents").select("doc_id", scalar.clip_name(path).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (p_size * 16) || 'x' || (p_size * 9) WHEN p_size % 3 = 1 THEN p_size || 'p' ELSE 'unknown' END AS resolution FROM part")
def p25_resolutions(spark, sf_dir):
    s = F.col("p_size")
    w, h, tag = F.when(s % 3 == 0, s * 16), F.when(s % 3 == 0, s * 9), F.when(s % 3 == 1, F.concat(s.cast("string"), F.lit("p")))
    return load(spark, sf_dir, "part").select("p_partkey", scalar.resolution_label((w, h), tag=tag).alias("resolution"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(['enc_size', 'enc_price', 'fx_brand']) AS name FROM part) WHERE regexp_matches(name, '^enc_') GROUP BY 1")
def p27_parameter_group(spark, sf_dir):
    names = load(spark, sf_dir, "part").select(F.explode(F.array(*map(F.lit, ("enc_size", "enc_price", "fx_brand")))).alias("name"))
    return summaries.parameter_group(names, "name", "enc").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(round_even(l_discount * 100 * 8, 0), CASE l_returnflag WHEN 'A' THEN 20 WHEN 'R' THEN 50 ELSE 1000 END) AS INT) AS strength FROM lineitem WHERE l_linenumber <= 7")
def p29_strengths(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalar.strength(F.col("l_discount") * 100, 8.0, F.col("l_returnflag"), {"A": 20, "R": 50}).alias("strength"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1, 2")
def a3_dotted_groups(spark, sf_dir):
    """Groups by dotted keys of documents; rows that lack a key are in no group."""
    o = load(spark, sf_dir, "orders")
    doc = F.parse_json(F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("priority")).alias("config"))))
    return summaries.by_dotted(o.select(doc.alias("doc")), "doc", {"o_orderstatus": "config.status", "o_orderpriority": "config.priority"}).agg(F.count("*").alias("n"))


@query(f"WITH {F1} SELECT arm, round(avg(fg_q), 6) AS fg_mean, round(stddev_pop(fg_q), 6) AS fg_sd, round(avg(bg_q), 6) AS bg_mean, round(stddev_pop(bg_q), 6) AS bg_sd FROM f1 GROUP BY 1")
def a24_by_approach(spark, sf_dir):
    return summaries.spread_by(runs(spark, sf_dir), ["arm"], {"fg": "fg_q", "bg": "bg_q"}).select("arm", *[F.round(c, 6).alias(c) for c in ("fg_mean", "fg_sd", "bg_mean", "bg_sd")])


@query(f"WITH {F1} SELECT clip, count(*) AS runs FROM f1 GROUP BY 1")
def a39_runs_by_clip(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("clip").agg(F.count("*").alias("runs"))


@query("SELECT o_orderstatus, count(*) AS expected, sum(n) AS found, sum(n) = count(*) * 4 AS matches FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def q19_row_counts(spark, sf_dir):
    """Rows of a log against the number that is expected of it."""
    log = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = load(spark, sf_dir, "orders").join(log, "o_orderkey", "left")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("expected"), F.sum("n").alias("found")).withColumn("matches", rules.count_matches(F.col("found"), F.col("expected") * 4))


@query("SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1")
def p9_numbers(spark, sf_dir):
    return load(spark, sf_dir, "events").where(rules.is_number(F.col("value"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) ELSE 'davis' END AS dataset, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '/' || o_orderkey ELSE o_orderpriority END AS name FROM orders) GROUP BY 1")
def p5_datasets(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").groupBy(scalar.dataset_of(name).alias("dataset")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","size":"' || p_size || '","type":"' || p_type || '"}'), 1, 16) AS hash FROM part""")
def p7_content_hashes(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    c = F.col
    return p.select("p_partkey", scalar.content_hash(F.array(pair("type", c("p_type")), pair("hash", c("p_name")), pair("size", c("p_size")), pair("_seen", c("p_partkey")), pair("brand", c("p_brand")))).alias("hash"))


@query("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 0 AND o_custkey % 9 <> 0) AS clear, count(*) FILTER (o_custkey % 9 = 0) AS missing FROM orders GROUP BY 1")
def q6_rule_runner(spark, sf_dir):
    price = F.when(F.col("o_custkey") % 9 != 0, F.col("o_totalprice"))
    judged = load(spark, sf_dir, "orders").withColumn("failures", rules.verdict(*rules.metrics_present({"price": price})))
    return judged.groupBy("o_orderstatus").agg(F.count_if(F.size("failures") == 0).alias("clear"), F.count_if(F.array_contains("failures", "price is not a finite number")).alias("missing"))


@query(f"WITH {F1} SELECT a.clip, a.qp, CASE WHEN abs(b.bg_q - a.bg_q) < 0.005 AND b.rate > a.rate THEN 'more bits at the same quality' END AS failure FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'A' AND b.arm = 'R'")
def q8_pair_rule(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir).where("arm IN ('A', 'R')"), ["clip", "qp"], "arm", "A", ["rate", "bg_q"])
    quality = F.when(F.abs(F.col("bg_q") - F.col("base_bg_q")) < 0.005, "same").otherwise("distinguishable")
    return s.select("clip", "qp", rules.costs_bits(quality, F.col("rate") - F.col("base_rate")).alias("failure"))


@query(None)
def l7_shards(spark, sf_dir):
    """Keys by their shard; DuckDB has no crc32, the test takes the library's."""
    return load(spark, sf_dir, "orders").select("o_orderkey", scalar.shard_of(F.col("o_orderkey").cast("string"), 4).alias("shard"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) OR c_custkey % 10 = 3")
def u2_s9_fresh(spark, sf_dir):
    """What is found and not known, or known in an older version."""
    found = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 10 == 3, 2).otherwise(1).alias("modified"))
    known = load(spark, sf_dir, "customer").where("c_nationkey < 12").select("c_custkey", F.lit(1).alias("modified"))
    return store.fresh(found, known, "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND event_id % 3 <> 0")
def p6_s19_specs(spark, sf_dir):
    d = store.once(_docs(spark, sf_dir), "doc", F.parse_json(F.to_json(F.struct(F.try_variant_get("doc", "$.tags[0]", "string").alias("kind"), F.try_variant_get("doc", "$.user", "long").alias("user"), F.when(F.col("event_id") % 3 == 0, F.lit("old")).alias("retired")))))
    kept, _ = store.specs(d, {"kind": "click"})
    return kept.select("event_id", F.try_variant_get("doc", "$.user", "long").alias("user_id"))
