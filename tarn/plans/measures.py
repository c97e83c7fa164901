"""Queries of the column functions, the composed products and the set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import curves, frontier, pairing, ranks, stats, summaries, vectors
from tarn.plans.catalog import F1, RANKED, _curves, load, query, runs
from tarn.plans.reports import FRONT, MARGINS


@query("""SELECT '{"brand":"' || p_brand || '","size":"' || p_size || '"}' AS identity, count(*) AS n, count(DISTINCT p_type) AS fills FROM part GROUP BY 1""")
def p8_config_identity(spark, sf_dir):
    config = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("fill"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    return load(spark, sf_dir, "part").groupBy(scalar.identity(config, ["fill"]).alias("identity")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("fills"))


P10 = """SELECT l_linenumber AS c, CASE l_linenumber % 4 WHEN 0 THEN 'x265' WHEN 1 THEN 'kvazaar' WHEN 2 THEN 'svtav1' ELSE 'x264' END AS codec, l_quantity > 25 AS has_qp, CASE WHEN l_tax > 0.05 THEN 'cqp' END AS mode,
CASE WHEN l_discount > 0.08 THEN 'kvazaar' WHEN l_discount > 0.06 THEN 'blur' WHEN l_discount < 0.01 THEN 'what' END AS roi FROM lineitem"""


@query(f"""WITH r AS ({P10}) SELECT codec, CASE WHEN roi = 'kvazaar' THEN 'cqp' WHEN roi = 'blur' AND codec = 'kvazaar' THEN 'vbr_1pass' WHEN roi = 'blur' THEN 'vbr_2pass' WHEN roi IS NOT NULL THEN 'n/a'
WHEN codec = 'x265' AND has_qp THEN 'cqp' WHEN codec IN ('x264', 'x265') THEN 'vbr_2pass' WHEN codec = 'kvazaar' AND (has_qp OR coalesce(mode = 'cqp', false)) THEN 'cqp' WHEN codec = 'svtav1' AND has_qp THEN 'crf' ELSE 'vbr_1pass' END AS mode, count(*) AS n FROM r GROUP BY 1, 2""")
def p10_rate_control(spark, sf_dir):
    codec = F.element_at(F.array(*map(F.lit, ("x265", "kvazaar", "svtav1", "x264"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    roi = F.when(F.col("l_discount") > 0.08, "kvazaar").when(F.col("l_discount") > 0.06, "blur").when(F.col("l_discount") < 0.01, "what")
    mode = scalar.rate_control(codec, F.col("l_quantity") > 25, F.when(F.col("l_tax") > 0.05, "cqp"), roi, {"kvazaar": "cqp", "svtav1": "crf", "x265_aq": "vbr_2pass"}, ["blur"], ["x264", "x265"], {"x265": "cqp", "kvazaar": "cqp", "svtav1": "crf"})
    return load(spark, sf_dir, "lineitem").groupBy(codec.alias("codec"), mode.alias("mode")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey % 3 IN (1, 2) GROUP BY 1")
def p16_arm_match(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("third", F.nullif(F.col("o_custkey") % 3, F.lit(2)))
    return o.where(scalar.matches({"o_orderstatus": ["F", "P"], "third": [1, 2]}, {"third": 2})).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN CAST(user_id AS DOUBLE) WHEN 3 THEN CAST(user_id AS DOUBLE) + 0.5 END AS number FROM events""")
def p22_numbers(spark, sf_dir):
    u = F.col("user_id").cast("string")
    text = F.element_at(F.array(F.lit("True"), F.lit(" false"), F.concat(F.lit("["), u, F.lit(", 7]")), F.concat(u, F.lit(".5")), F.lit("none")), (F.col("event_id") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", scalar.number_of(text).alias("number"))


@query("SELECT CASE WHEN lower(p_name) LIKE '%a%' THEN 'first' WHEN lower(p_name) LIKE '%e%' THEN 'second' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def p23_classify(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(scalar.classified(F.col("p_name"), [("a", "first"), ("e", "second")], "other").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN length(t) <= 12 THEN t ELSE substr(t, 1, 12) || '-' || substr(sha1(t), 1, 8) END AS slug FROM (SELECT c_custkey, regexp_replace(lower(c_mktsegment || ' #' || c_nationkey), '[^a-z0-9_.-]+', '-', 'g') AS t FROM customer))
SELECT c_custkey, slug || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS slug FROM s WINDOW w AS (PARTITION BY slug ORDER BY c_custkey)""")
def p26_unique_slugs(spark, sf_dir):
    s = load(spark, sf_dir, "customer").select("c_custkey", scalar.slug(F.concat_ws(" #", "c_mktsegment", F.col("c_nationkey").cast("string")), 12).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("c_custkey"))
    return s.select("c_custkey", F.concat("slug", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")).alias("slug"))


@query("SELECT CASE WHEN l_linestatus = 'O' THEN greatest(1, least(4, CAST(round_even(l_discount * 10 * 4, 0) AS INT))) ELSE 0 END AS level, count(*) AS n FROM lineitem GROUP BY 1")
def p30_levels(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(scalar.level_of(F.col("l_discount") * 10, 4, F.col("l_linestatus") == "O").alias("level")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN CAST((o_custkey % 7) * 25 AS BIGINT) END AS frames, round(o_totalprice * 8 / nullif((o_custkey % 7) / 25.0, 0), 4) AS bits FROM orders")
def p15_p33_rates(spark, sf_dir):
    seven = F.col("o_custkey") % 7
    return load(spark, sf_dir, "orders").select("o_orderkey", scalar.frame_count(seven, F.lit(25)).cast("long").alias("frames"), F.round(scalar.bitrate(F.col("o_totalprice"), F.nullif(seven, F.lit(0)), F.lit(25.0)), 4).alias("bits"))


@query(f"""WITH {F1}, w AS (SELECT clip, qp, row_number() OVER (PARTITION BY clip, qp ORDER BY bg_q, arm) AS a, row_number() OVER (PARTITION BY clip, qp ORDER BY rate, arm) AS b, rate FROM f1),
c AS (SELECT clip, qp, max(rate) FILTER (a = 1) - max(rate) FILTER (b = 1) AS given FROM w GROUP BY 1, 2) SELECT count(*) AS cells, count(*) FILTER (given = 0) AS free, count(*) FILTER (given > 0) AS costly, round(median(given) FILTER (given > 0), 6) AS middle, round(max(given), 6) AS most FROM c""")
def a9_conflicts(spark, sf_dir):
    c = runs(spark, sf_dir).groupBy("clip", "qp").agg((F.min_by("rate", F.struct("bg_q", "arm")) - F.min("rate")).alias("given"))
    g = F.col("given")
    by = c.groupBy(F.lit(1).alias("_g")).agg(F.count("*").alias("cells"), F.count_if(g == 0).alias("free"), F.count_if(g > 0).alias("costly"), F.round(F.max(g), 6).alias("most"))
    middle = ranks.medians(c.where(g > 0).withColumn("_g", F.lit(1)), ["_g"], {"middle": g})
    return by.join(middle, "_g", "left").select("cells", "free", "costly", F.round("middle", 6).alias("middle"), "most")


@query(f"WITH {F1}, {FRONT} SELECT arm, round(avg(rate / frames), 6) AS seconds, round(median(frames / rate), 9) AS fps, count(*) FILTER (NOT EXISTS (SELECT 1 FROM front f WHERE f.clip = f1.clip AND f.qp = f1.qp AND f.arm = f1.arm)) AS dominated FROM f1 GROUP BY 1")
def a12_a13_throughput(spark, sf_dir):
    r = runs(spark, sf_dir)
    on = frontier.undominated(r, ["clip", "qp"], "arm", ["rate", "bg_q"], ["fg_q"]).select("clip", "qp", "arm", F.lit(True).alias("_on"))
    fps = scalar.throughput(F.col("frames"), F.col("rate"))
    by = r.join(on, ["clip", "qp", "arm"], "left").groupBy("arm").agg(F.round(F.avg(F.col("rate") / F.col("frames")), 6).alias("seconds"), F.count_if(F.col("_on").isNull()).alias("dominated"))
    return ranks.same(by, ranks.medians(r, ["arm"], {"fps": fps}), ["arm"], "left").select("arm", "seconds", F.round("fps", 9).alias("fps"), "dominated")


@query("SELECT l_shipdate, round(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS a_bits, round(sum(l_extendedprice) FILTER (l_returnflag <> 'A'), 2) AS other_bits, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1")
def a29_frame_log(spark, sf_dir):
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(
        F.round(F.sum(F.when(flag == "A", F.col("l_extendedprice"))), 2).alias("a_bits"), F.round(F.sum(F.when(flag != "A", F.col("l_extendedprice"))), 2).alias("other_bits"),
        F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weighted"),
    )


@query(f"""WITH {F1}, l AS (SELECT clip, qp, arm, unnest(['rate', 'bg_q', 'fg_q']) AS metric, unnest([rate, bg_q, fg_q]) AS v FROM f1) SELECT a.arm, a.metric, count(*) AS pairs, round(median(a.v - b.v), 6) AS delta FROM l a JOIN l b ON a.clip = b.clip AND a.qp = b.qp AND a.metric = b.metric AND b.arm = 'A' WHERE a.arm <> 'A' GROUP BY 1, 2 HAVING count(*) >= 3""")
def a37_whole_frame(spark, sf_dir):
    long = runs(spark, sf_dir).select("clip", "qp", "arm", F.explode(F.create_map(F.lit("rate"), F.col("rate"), F.lit("bg_q"), F.col("bg_q"), F.lit("fg_q"), F.col("fg_q"))).alias("metric", "v"))
    d = pairing.star(long, ["clip", "qp", "metric"], "arm", "A", ["v"]).withColumn("d", F.col("v") - F.col("base_v"))
    often = d.groupBy("arm", "metric").agg(F.count("*").alias("pairs")).where("pairs >= 3")
    return ranks.same(often, ranks.medians(d, ["arm", "metric"], {"delta": "d"}), ["arm", "metric"], "left").withColumn("delta", F.round("delta", 6))


@query(f"WITH {F1} SELECT clip, round(avg(fg_q), 4) AS masked, round(avg(bg_q * 500), 4) AS boxed, round(100 * (avg(bg_q * 500) - avg(fg_q)) / avg(fg_q), 4) AS gap_pct, count(*) FILTER (bg_q * 500 < fg_q) AS worse FROM f1 GROUP BY 1")
def a41_bias(spark, sf_dir):
    m, b = F.avg("fg_q"), F.avg(F.col("bg_q") * 500)
    return runs(spark, sf_dir).groupBy("clip").agg(F.round(m, 4).alias("masked"), F.round(b, 4).alias("boxed"), F.round(100 * (b - m) / m, 4).alias("gap_pct"), F.count_if(F.col("bg_q") * 500 < F.col("fg_q")).alias("worse"))


@query(f"WITH {F1}, f AS (SELECT clip FROM f1 WHERE arm IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT arm || qp) = 14) SELECT a.clip, round(avg(100 * (a.rate - b.rate) / b.rate), 6) AS pct FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'A' JOIN f ON f.clip = a.clip WHERE a.arm = 'R' GROUP BY 1")
def a45_matched_rungs(spark, sf_dir):
    r = pairing.complete(runs(spark, sf_dir).where("arm IN ('A', 'R')"), "clip", ["arm", "qp"])
    s = pairing.star(r, ["clip", "qp"], "arm", "A", ["rate"])
    return s.groupBy("clip").agg(F.round(F.avg(100 * (F.col("rate") - F.col("base_rate")) / F.col("base_rate")), 6).alias("pct"))


@query(f"""WITH {F1}, b AS (SELECT 'bg_q' AS feature, arm, {RANKED.format('bg_q')} AS x, {RANKED.format('rate')} AS y FROM f1 UNION ALL SELECT 'fg_q', arm, {RANKED.format('fg_q')}, {RANKED.format('rate')} FROM f1),
r AS (SELECT feature, arm, count(*) AS n, corr(x, y) AS rho FROM b GROUP BY 1, 2 HAVING count(*) >= 30) SELECT feature, count(*) AS runs, count(*) FILTER (rho > 0) AS n_pos, count(*) FILTER (rho < 0) AS n_neg, round(avg(rho), 6) AS rho FROM r GROUP BY 1""")
def t25_feature_scan(spark, sf_dir):
    """rho of each feature within each run of 30 rows or more, and how often its sign agrees."""
    long = runs(spark, sf_dir).select("arm", "rate", F.explode(F.create_map(F.lit("bg_q"), F.col("bg_q"), F.lit("fg_q"), F.col("fg_q"))).alias("feature", "x"))
    r = stats.spearman(long, ["feature", "arm"], "x", "rate").where("n >= 30")
    return r.groupBy("feature").agg(F.count("*").alias("runs"), F.count_if(F.col("rho") > 0).alias("n_pos"), F.count_if(F.col("rho") < 0).alias("n_neg"), F.round(F.avg("rho"), 6).alias("rho"))


@query()
def t20_bd_study(spark, sf_dir):
    """BD-rate of each clip whose ranges overlap by half, then one sign test; the fits have no short SQL, tests hold them against a solver."""
    b = curves.bd_rate(_curves(spark, sf_dir), ["clip"], "arm", "A", "N", "rate", "q").where("overlap >= 0.5 AND bd_rate IS NOT NULL")
    one = b.withColumn("study", F.lit("N over A"))
    return stats.signs(one, ["study"], "bd_rate").join(ranks.medians(one, ["study"], {"bd_rate": "bd_rate"}).withColumn("bd_rate", F.round("bd_rate", 4)), "study").select("study", "n_pos", "n_neg", "n_zero", F.round("p", 9).alias("p"), "bd_rate")


@query("""WITH s AS (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE)) AS s, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), a AS (SELECT i, sum(s) AS t, sum(n) AS n FROM s GROUP BY 1) SELECT label, round(sum((a.t / a.n - (a.t - s.s) / (a.n - s.n)) ** 2), 9) AS shift FROM s JOIN a USING (i) GROUP BY 1""")
def t33_leave_one_out(spark, sf_dir):
    return vectors.leave_one_out(load(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("shift", F.round("shift", 9))


@query(f"WITH {F1} SELECT clip, qp FROM f1 WHERE arm = 'A' AND bg_q < 0.05 INTERSECT SELECT clip, qp FROM f1 WHERE arm = 'R' AND bg_q < 0.05")
def u1_common_keys(spark, sf_dir):
    r = runs(spark, sf_dir).where("bg_q < 0.05")
    return r.where("arm = 'A'").select("clip", "qp").intersect(r.where("arm = 'R'").select("clip", "qp"))


@query(f"WITH {F1}, {MARGINS} SELECT clip, qp FROM c WHERE margin >= 0.003 - 1e-9 EXCEPT SELECT clip, qp FROM c WHERE margin >= 0.008 - 1e-9")
def u3_flipping_cells(spark, sf_dir):
    d = frontier.decide(runs(spark, sf_dir), ["clip", "qp"], "arm", "bg_q", 0.0)
    return d.where(F.col("margin") >= 0.003 - 1e-9).select("clip", "qp").exceptAll(d.where(F.col("margin") >= 0.008 - 1e-9).select("clip", "qp"))


@query("SELECT n_regionkey, count(DISTINCT s) = 1 AS same FROM (SELECT n_regionkey, n_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def u4_equal_sets(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    sets = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "n_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    return sets.groupBy("n_regionkey").agg((F.count_distinct("s") == 1).alias("same"))


@query(f"WITH {F1}, a AS (SELECT clip, max(rate) AS a FROM f1 WHERE qp <= 3 GROUP BY 1), b AS (SELECT clip, max(rate) AS b FROM f1 WHERE qp > 3 GROUP BY 1) SELECT clip, a, b, round(b - a, 6) AS delta FROM a JOIN b USING (clip)")
def j6_x2_user_predicates(spark, sf_dir):
    """Two sides chosen by predicates given as text."""
    r, side = runs(spark, sf_dir), {"a": "qp <= 3", "b": "qp > 3"}
    return r.groupBy("clip").agg(*[F.max(F.when(F.expr(p), F.col("rate"))).alias(n) for n, p in side.items()]).dropna(subset=list(side)).withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


@query(f"""WITH {F1}, {MARGINS}, r AS (SELECT clip, qp, arm, row_number() OVER (PARTITION BY clip, qp ORDER BY rate, arm) AS k FROM f1) SELECT c.clip, c.qp, c.winner AS by_quality, r.arm AS by_rate, c.separable FROM c JOIN r ON c.clip = r.clip AND c.qp = r.qp AND r.k = 1 WHERE n_arms >= 2""")
def m2_operating_map(spark, sf_dir):
    """The two objectives' winners of each cell of two arms or more, side by side."""
    r = runs(spark, sf_dir)
    q = frontier.decide(r, ["clip", "qp"], "arm", "bg_q", 0.005).where("n_arms >= 2").select("clip", "qp", F.col("winner").alias("by_quality"), "separable")
    return q.join(frontier.decide(r, ["clip", "qp"], "arm", "rate", 0.0).select("clip", "qp", F.col("winner").alias("by_rate")), ["clip", "qp"])


@query(f"WITH {F1}, {FRONT} SELECT arm, m.cells, round(m.rate, 6) AS rate, round(on_front / seen, 6) AS share FROM (SELECT arm, count(DISTINCT clip || '|' || qp) AS cells, median(rate) AS rate FROM f1 JOIN (SELECT clip, qp FROM f1 GROUP BY 1, 2 HAVING count(DISTINCT arm) = 3) USING (clip, qp) GROUP BY 1) m JOIN (SELECT arm, count(*) AS seen FROM f1 GROUP BY 1) USING (arm) JOIN (SELECT arm, count(*) AS on_front FROM front GROUP BY 1) USING (arm)")
def m3_trade_off_surface(spark, sf_dir):
    r = runs(spark, sf_dir)
    share = summaries.front_share(r, frontier.undominated(r, ["clip", "qp"], "arm", ["rate", "bg_q"], ["fg_q"]), "arm")
    return summaries.matched_medians(r, ["clip", "qp"], "arm", ["rate"]).join(share, "arm").select("arm", "cells", F.round("rate", 6).alias("rate"), F.round("share", 6).alias("share"))


X1 = "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


@query(X1)
def x1_any_sql(spark, sf_dir):
    for t in ("customer", "nation", "region"):
        load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(X1)
