"""Queries of the rules, summaries and pairings; the tables stand in for runs as in the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import frontier, pairing, ranks, rules, stats, summaries
from tarn.plans.catalog import DELTAS, F1, clip_deltas, load, query, runs

MARGINS = "m AS (SELECT clip, qp, arm, bg_q, lead(bg_q) OVER w - bg_q AS margin, row_number() OVER w AS rn, count(*) OVER (PARTITION BY clip, qp) AS n_arms FROM f1 WINDOW w AS (PARTITION BY clip, qp ORDER BY bg_q, arm)), c AS (SELECT clip, qp, arm AS winner, margin, n_arms, coalesce(margin >= 0.005 - 1e-9, false) AS separable FROM m WHERE rn = 1)"
FRONT = """front AS (SELECT a.clip, a.qp, a.arm FROM f1 a WHERE NOT EXISTS (SELECT 1 FROM f1 b WHERE a.clip = b.clip AND a.qp = b.qp AND a.arm <> b.arm AND b.rate <= a.rate AND b.bg_q <= a.bg_q AND b.fg_q >= a.fg_q
AND (b.rate < a.rate OR b.bg_q < a.bg_q OR b.fg_q > a.fg_q)))"""


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


@query("""SELECT l_returnflag, concat_ws('; ', CASE WHEN l_quantity - 25 <= 0 THEN 'foreground is not positive' END, CASE WHEN l_discount <= 0 THEN 'background is not positive' END, CASE WHEN l_tax IS NULL THEN 'overall is not a finite number' WHEN l_tax <= 0 THEN 'overall is not positive' END) AS failures, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def q1_metrics_present(spark, sf_dir):
    found = rules.verdict(*rules.metrics_present({"foreground": F.col("l_quantity") - 25, "background": F.col("l_discount"), "overall": F.col("l_tax")}))
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.array_join(found, "; ").alias("failures")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_totalprice AS sent, o_custkey % 100 AS frames, o_totalprice * 8 / ((o_custkey % 100) / 25.0) * (1 + (o_orderkey % 5 - 2) * 0.006) AS actual FROM orders)
SELECT CASE WHEN actual IS NULL OR frames = 0 THEN 'bitrate is missing' WHEN abs(actual - sent * 8 / (frames / 25.0)) / (sent * 8 / (frames / 25.0)) > 0.01 THEN 'bitrate disagrees with the bytes sent' ELSE 'ok' END AS failure, count(*) AS n FROM r GROUP BY 1""")
def q2_bitrate_accounting(spark, sf_dir):
    frames = F.col("o_custkey") % 100
    actual = F.try_divide(F.col("o_totalprice") * 8, frames / F.lit(25.0)) * (1 + (F.col("o_orderkey") % 5 - 2) * 0.006)
    failure = rules.bitrate_accounting(actual, F.col("o_totalprice"), frames, F.lit(25.0))
    return load(spark, sf_dir, "orders").groupBy(F.coalesce(failure, F.lit("ok")).alias("failure")).agg(F.count("*").alias("n"))


@query("""SELECT l_shipmode AS component, CASE WHEN l_shipmode IN ('AIR', 'RAIL') AND l_linestatus = 'O' AND l_returnflag NOT IN ('A', 'R') THEN 'not at a fixed quality' ELSE 'ok' END AS failure, count(*) AS n FROM
(SELECT CASE l_linenumber % 3 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' ELSE 'SHIP' END AS l_shipmode, l_linestatus, l_returnflag FROM lineitem) GROUP BY 1, 2""")
def q3_fixed_quality(spark, sf_dir):
    component = F.element_at(F.array(*map(F.lit, ("AIR", "RAIL", "SHIP"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    failure = rules.fixed_quality(F.col("component"), F.when(F.col("l_linestatus") == "O", "blur"), F.col("l_returnflag"), ["AIR", "RAIL"], ["A", "R"])
    return load(spark, sf_dir, "lineitem").select(component.alias("component"), "l_linestatus", "l_returnflag").groupBy("component", F.coalesce(failure, F.lit("ok")).alias("failure")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, concat_ws('; ', CASE WHEN l_discount > l_tax + 0.05 THEN 'restoration made the background worse' END, CASE WHEN l_tax - l_discount > 0.005 THEN 'restoration clipped the output' END) AS failures, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def q4_q5_restoration(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    found = rules.verdict(rules.restoration_did_not_hurt(F.col("l_linestatus"), d, t), rules.not_saturated(F.col("l_linestatus"), t, d))
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.array_join(found, "; ").alias("failures")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'overall is not positive' WHEN value IS NULL THEN 'overall is not a finite number' ELSE '' END AS old,
CASE WHEN value IS NULL THEN 'overall is not a finite number' WHEN value <= 0 THEN 'overall is not positive' ELSE '' END AS now FROM events)
SELECT event_type, CASE WHEN old IS NULL THEN 'missing' ELSE 'stale' END AS state, count(*) AS n FROM v WHERE old IS NULL OR old <> now GROUP BY 1, 2""")
def q7_verdict_audit(spark, sf_dir):
    now = rules.verdict(*rules.metrics_present({"overall": F.col("value")}))
    old = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 7 == 0, F.array(F.lit("overall is not positive"))).when(F.col("value").isNull(), F.array(F.lit("overall is not a finite number"))).otherwise(F.array().cast("array<string>"))
    return rules.audit(load(spark, sf_dir, "events").withColumn("stored", old), "stored", now).groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query(f"WITH {F1} SELECT arm, CASE WHEN bg_q BETWEEN 0.045 AND 0.055 THEN 'in band' WHEN bg_q > 0.07 THEN 'alarm' ELSE 'outside plausible' END AS status, count(*) AS n FROM f1 GROUP BY 1, 2")
def q9_bands(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("arm", rules.band(F.col("bg_q"), (0.045, 0.055), alarm_above=0.07).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {F1}, g AS (SELECT count(*) >= 100 AS enough, bool_or(bg_q > 0.06) AS spread, count(DISTINCT arm) = 3 AS arms, avg(fg_q) > 25 AS better FROM f1) SELECT *, enough AND spread AND arms AND better AS passed FROM g")
def q10_gate(spark, sf_dir):
    return rules.gate(runs(spark, sf_dir), {"enough": F.count("*") >= 100, "spread": F.bool_or(F.col("bg_q") > 0.06), "arms": F.count_distinct("arm") == 3, "better": F.avg("fg_q") > 25})


@query("""SELECT o_orderpriority, count(*) AS planned, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n < 3) AS short, count(*) FILTER (worst > 0.09) AS breach FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, max(l_discount) AS worst FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def q11_completeness(spark, sf_dir):
    got = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_discount").alias("worst"))
    return rules.completeness(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), got, ["o_orderkey"], ["o_orderpriority"], {"short": F.col("n") < 3, "breach": F.col("worst") > 0.09})


@query("SELECT l_partkey % 50 AS clip, l_returnflag AS arm, count(*) FILTER (l_discount > 0.08) AS breach, count(*) FILTER (l_discount <= 0.08 AND l_tax > 0.06) AS pending FROM lineitem GROUP BY 1, 2")
def q12_breach_pending(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("clip"), F.col("l_returnflag").alias("arm"), rules.verdict(F.when(F.col("l_discount") > 0.08, "output clipped"), F.when(F.col("l_tax") > 0.06, "not evaluated")).alias("f"))
    clipped = F.exists("f", lambda x: F.contains(x, F.lit("clipped")))
    return li.groupBy("clip", "arm").agg(F.count_if(clipped).alias("breach"), F.count_if(~clipped & (F.size("f") > 0)).alias("pending"))


@query(f"WITH {F1}, e AS (SELECT clip, qp // 3 AS half, arm, min(bg_q) AS lo, max(bg_q) AS hi FROM f1 WHERE arm <> 'N' GROUP BY 1, 2, 3) SELECT clip, half, max(lo) > min(hi) AS disjoint FROM e GROUP BY 1, 2")
def q14_disjoint_ranges(spark, sf_dir):
    return rules.disjoint_ranges(runs(spark, sf_dir).where("arm <> 'N'").withColumn("half", F.floor(F.col("qp") / 3)), ["clip", "half"], "arm", "bg_q")


@query(f"WITH {F1} SELECT clip, arm, qp, rate AS now, round(rate, 1) AS expected FROM f1 WHERE abs(rate - round(rate, 1)) > 0.04")
def q15_reconcile(spark, sf_dir):
    r = runs(spark, sf_dir)
    return rules.reconcile(r, r.withColumn("rate", F.round("rate", 1)), ["clip", "arm", "qp"], "rate", 0.04)


@query("""SELECT reason, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'too small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'no customer' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY 1""")
def q16_drops(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_known"))
    o = load(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    return rules.drops(o, F.when(F.col("o_totalprice") < 50000, "too small").when(F.col("o_orderstatus") == "P", "pending").when(F.col("_known").isNull(), "no customer"), "o_orderkey")


@query("""WITH a AS (SELECT l_linenumber AS level, count(*) AS n_before FROM lineitem GROUP BY 1), b AS (SELECT CASE WHEN l_discount > 0.09 THEN 1 ELSE l_linenumber END AS level, count(*) AS n_after FROM lineitem GROUP BY 1)
SELECT level, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after FROM a FULL JOIN b USING (level) WHERE coalesce(n_before, 0) <> coalesce(n_after, 0)""")
def q18_histogram_changes(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return rules.histogram_changes(li.select(F.col("l_linenumber").alias("level")), li.select(F.when(F.col("l_discount") > 0.09, 1).otherwise(F.col("l_linenumber")).alias("level")), ["level"])


@query("""WITH c AS (SELECT o_custkey, any_value(o_totalprice) AS control FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey, round(o_totalprice - control, 6) AS gain FROM orders LEFT JOIN c USING (o_custkey) WHERE o_orderstatus = 'F'""")
def j3_matched_control(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    control = pairing.refuse_ambiguous(o.where("o_orderstatus = 'P'"), ["o_custkey"])[0].select("o_custkey", F.col("o_totalprice").alias("control"))
    return o.where("o_orderstatus = 'F'").join(control, "o_custkey", "left").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("control"), 6).alias("gain"))


@query(f"WITH {F1} SELECT a.clip, a.qp, round(b.rate - a.rate, 6) AS n_over_a, round(c.rate - a.rate, 6) AS r_over_a FROM f1 a JOIN f1 b USING (clip, qp) JOIN f1 c USING (clip, qp) WHERE a.arm = 'A' AND b.arm = 'N' AND c.arm = 'R'")
def j9_three_arms(spark, sf_dir):
    wide = runs(spark, sf_dir).groupBy("clip", "qp").pivot("arm", ["A", "N", "R"]).agg(F.first("rate")).dropna(subset=["A", "N", "R"])
    return wide.select("clip", "qp", F.round(F.col("N") - F.col("A"), 6).alias("n_over_a"), F.round(F.col("R") - F.col("A"), 6).alias("r_over_a"))


@query(f"WITH {F1}, s AS (SELECT a.clip, a.arm, a.rate < b.rate AS g1, a.bg_q < b.bg_q AS g2 FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'A' WHERE a.arm <> 'A') SELECT arm, count(*) FILTER (g1 AND g2) AS both, count(*) FILTER (g1 AND NOT g2) AS first_only, count(*) FILTER (NOT g1 AND g2) AS second_only, count(*) FILTER (NOT g1 AND NOT g2) AS neither FROM s GROUP BY 1")
def j12_a11_two_goals(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir), ["clip", "qp"], "arm", "A", ["rate", "bg_q"])
    return summaries.cross_tab(s, "arm", F.col("rate") < F.col("base_rate"), F.col("bg_q") < F.col("base_bg_q"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1")
def j14_first_match(spark, sf_dir):
    one = summaries.first_of(load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])
    o = load(spark, sf_dir, "orders")
    return one.join(o, one.l_orderkey == o.o_orderkey).select("l_partkey", "l_orderkey", "l_linenumber", "o_custkey")


@query(f"WITH {F1}, w AS (SELECT clip, qp, arg_min(arm, lpad(CAST(CAST(round(bg_q * 1e9) AS BIGINT) AS VARCHAR), 12, '0') || arm) AS masked, arg_min(arm, lpad(CAST(CAST(round(rate * 1e6) AS BIGINT) AS VARCHAR), 18, '0') || arm) AS boxed FROM f1 GROUP BY 1, 2) SELECT * FROM w WHERE masked <> boxed")
def j22_winner_flips(spark, sf_dir):
    w = runs(spark, sf_dir).groupBy("clip", "qp").agg(F.min_by("arm", F.struct("bg_q", "arm")).alias("masked"), F.min_by("arm", F.struct("rate", "arm")).alias("boxed"))
    return w.where("masked <> boxed")


@query(f"""WITH {F1}, s AS (SELECT a.clip, a.qp, a.arm, a.rate, b.rate AS base, abs(a.bg_q - b.bg_q) AS margin, row_number() OVER (PARTITION BY a.clip, a.qp ORDER BY a.rate, a.arm) AS k, row_number() OVER (PARTITION BY a.clip, a.qp ORDER BY abs(a.bg_q - b.bg_q) DESC, a.arm DESC) AS m FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'A' WHERE a.arm <> 'A')
SELECT clip, qp, bool_and(margin < 0.005) AS all_ok, max(arm) FILTER (k = 1) AS winner, round(100 * (max(base) - max(rate) FILTER (k = 1)) / max(base), 6) AS saving_pct, max(arm) FILTER (m = 1) AS worst FROM s GROUP BY 1, 2""")
def a4_group_verdict(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir), ["clip", "qp"], "arm", "A", ["rate", "bg_q"]).withColumn("margin", F.abs(F.col("bg_q") - F.col("base_bg_q"))).withColumn("ok", F.col("margin") < 0.005)
    return summaries.group_verdict(s, ["clip", "qp"], "arm", "rate", "ok", "base_rate", "margin").withColumn("saving_pct", F.round("saving_pct", 6))


@query(f"WITH {F1}, {MARGINS} SELECT winner, count(*) AS cells, count(*) FILTER (separable) AS separable, count(*) FILTER (NOT separable AND n_arms > 1) AS ties, count(*) FILTER (n_arms = 1) AS single FROM c GROUP BY 1")
def a5_winner_counts(spark, sf_dir):
    return summaries.winner_counts(frontier.decide(runs(spark, sf_dir), ["clip", "qp"], "arm", "bg_q", 0.005))


@query(f"WITH {F1} SELECT arm, count(*) AS n, round(median(rate), 6) AS rate, round(median(bg_q), 6) AS bg_q FROM f1 GROUP BY 1 HAVING count(*) >= 8")
def a6_medians(spark, sf_dir):
    return summaries.medians(runs(spark, sf_dir), "arm", ["rate", "bg_q"]).select("arm", "n", r6("rate"), r6("bg_q"))


@query(f"WITH {F1}, k AS (SELECT clip, qp FROM f1 GROUP BY 1, 2 HAVING count(DISTINCT arm) = 3) SELECT arm, count(DISTINCT clip || '|' || qp) AS cells, round(median(rate), 6) AS rate FROM f1 JOIN k USING (clip, qp) GROUP BY 1")
def a7_matched_medians(spark, sf_dir):
    return summaries.matched_medians(runs(spark, sf_dir), ["clip", "qp"], "arm", ["rate"]).select("arm", "cells", r6("rate"))


@query(f"WITH {F1}, {FRONT} SELECT arm, seen, coalesce(on_front, 0) AS on_front, round(coalesce(on_front, 0) / seen, 6) AS share FROM (SELECT arm, count(*) AS seen FROM f1 GROUP BY 1 HAVING count(*) >= 4) LEFT JOIN (SELECT arm, count(*) AS on_front FROM front GROUP BY 1) USING (arm)")
def a8_front_share(spark, sf_dir):
    r = runs(spark, sf_dir)
    return summaries.front_share(r, frontier.undominated(r, ["clip", "qp"], "arm", ["rate", "bg_q"], ["fg_q"]), "arm").withColumn("share", F.round("share", 6))


@query("SELECT o_orderpriority AS task, o_orderstatus AS res, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS sd, row_number() OVER (PARTITION BY o_orderpriority ORDER BY avg(o_totalprice) DESC, o_orderstatus) AS place FROM orders GROUP BY 1, 2")
def a15_throughput(spark, sf_dir):
    by = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("res")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("sd"))
    return by.select("task", "res", r6("mean"), r6("sd"), F.row_number().over(Window.partitionBy("task").orderBy(F.desc("mean"), "res")).alias("place"))


@query(f"WITH {F1} SELECT clip, round(avg(rate), 6) AS mean_rate, round(median(bg_q), 6) AS median_q, max(frames) AS frames, round(avg(CASE WHEN bg_q < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS outcome_rate FROM f1 GROUP BY 1")
def a16_a17_by_video(spark, sf_dir):
    r = runs(spark, sf_dir)
    by = r.groupBy("clip").agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.max("frames").alias("frames"), F.round(F.avg((F.col("bg_q") < 0.05).cast("double")), 6).alias("outcome_rate"))
    return ranks.same(by, ranks.medians(r, ["clip"], {"median_q": "bg_q"}), ["clip"], "left").withColumn("median_q", F.round("median_q", 6))


@query(f"WITH {F1}, {MARGINS}, k AS (SELECT clip, winner, count(*) AS n FROM c GROUP BY 1, 2) SELECT clip, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) >= 0.6 AS degenerate FROM k GROUP BY 1")
def a18_degeneracy(spark, sf_dir):
    return summaries.degeneracy(frontier.decide(runs(spark, sf_dir), ["clip", "qp"], "arm", "bg_q", 0.005), ["clip"], "winner", 0.6).withColumn("share", F.round("share", 6))


@query("""WITH u AS (SELECT l_returnflag AS arm, l_partkey, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag AS arm, stddev_pop(l_quantity) AS pooled FROM lineitem GROUP BY 1)
SELECT arm, round(avg(s), 6) AS within, round(any_value(pooled), 6) AS pooled, round(any_value(pooled) / avg(s), 6) AS inflation FROM u JOIN p USING (arm) GROUP BY 1""")
def a20_spread_inflation(spark, sf_dir):
    return summaries.spread_inflation(load(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "arm"), ["arm"], "l_partkey", "l_quantity").select("arm", r6("within"), r6("pooled"), r6("inflation"))


@query(f"""WITH {F1}, b AS (SELECT arm, clip, qp, max(bg_q) OVER (PARTITION BY arm, clip) - min(bg_q) OVER (PARTITION BY arm, clip) AS spread, row_number() OVER (PARTITION BY arm, clip ORDER BY bg_q, qp) AS k FROM f1),
n AS (SELECT arm, qp, count(*) AS n, sum(spread) AS s FROM b WHERE k = 1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY n DESC, qp) AS k FROM n)
SELECT arm, CAST(sum(n) AS BIGINT) AS videos, round(sum(s) / sum(n), 6) AS mean_spread, max(qp) FILTER (k = 1) AS best, round(max(n) / sum(n), 6) AS share FROM r GROUP BY 1""")
def a21_sweep_summary(spark, sf_dir):
    return summaries.sweep_summary(runs(spark, sf_dir), ["arm"], "qp", "bg_q", "clip").withColumn("mean_spread", F.round("mean_spread", 6)).withColumn("share", F.round("share", 6))


@query("""WITH a AS (SELECT (sqrt(3.0) / 3 * l_quantity - l_discount * 100 / 3) / 4.0 AS q, (2.0 / 3 * (l_discount * 100)) / 4.0 AS r, l_extendedprice AS v FROM lineitem),
b AS (SELECT *, -q - r AS s, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM a), c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM b)
SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r, count(*) AS n, round(avg(v), 4) AS mean FROM c GROUP BY 1, 2""")
def a25_hexagons(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("y"), "l_extendedprice")
    return summaries.hexagons(li, "l_quantity", "y", "l_extendedprice", 4.0).withColumn("mean", F.round("mean", 4))


@query("SELECT o_orderstatus, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 6) AS {n}" for n, q in (("least", 0), ("q1", 0.25), ("middle", 0.5), ("q3", 0.75), ("most", 1))) + " FROM orders GROUP BY 1")
def a27_five_numbers(spark, sf_dir):
    five = {"least": 0.0, "q1": 0.25, "middle": 0.5, "q3": 0.75, "most": 1.0}
    return ranks.quantiles(load(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", five).select("o_orderstatus", *[r6(n) for n in five])


@query("SELECT c_nationkey, round(median(c_acctbal), 6) AS middle FROM customer GROUP BY 1 HAVING median(c_acctbal) > 0 ORDER BY 2, 1 LIMIT 10")
def a28_lowest_medians(spark, sf_dir):
    by = ranks.medians(load(spark, sf_dir, "customer"), ["c_nationkey"], {"middle": "c_acctbal"}).withColumn("middle", F.round("middle", 6))
    return by.where("middle > 0").orderBy("middle", "c_nationkey").limit(10)


@query(f"WITH {F1} SELECT a.qp, count(*) FILTER (a.rate < b.rate) AS saves, round(median(100 * (a.rate - b.rate) / b.rate), 6) AS rate_pct, round(median(a.bg_q - b.bg_q), 6) AS gap, count(*) FILTER (a.bg_q < b.bg_q) AS better FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'A' WHERE a.arm = 'R' GROUP BY 1")
def a38_trade_by_rung(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir).where("arm IN ('A', 'R')"), ["clip", "qp"], "arm", "A", ["rate", "bg_q"])
    by = s.groupBy("qp").agg(F.count_if(F.col("rate") < F.col("base_rate")).alias("saves"), F.count_if(F.col("bg_q") < F.col("base_bg_q")).alias("better"))
    middle = ranks.medians(s, ["qp"], {"rate_pct": 100 * (F.col("rate") - F.col("base_rate")) / F.col("base_rate"), "gap": F.col("bg_q") - F.col("base_bg_q")})
    return ranks.same(by, middle, ["qp"], "left").select("qp", "saves", r6("rate_pct"), r6("gap"), "better")


@query(f"WITH {F1}, s AS (SELECT clip, qp, max(rate) FILTER (arm = 'R') < max(rate) FILTER (arm = 'A') AS g1, max(bg_q) FILTER (arm = 'R') < max(bg_q) FILTER (arm = 'A') AS g2 FROM f1 GROUP BY 1, 2) SELECT qp, count(*) AS n, count(*) FILTER (g1 = g2) AS agree FROM s GROUP BY 1")
def a44_concordance(spark, sf_dir):
    pick = lambda v, a: F.max(F.when(F.col("arm") == a, F.col(v)))
    s = runs(spark, sf_dir).groupBy("clip", "qp").agg((pick("rate", "R") < pick("rate", "A")).alias("g1"), (pick("bg_q", "R") < pick("bg_q", "A")).alias("g2"))
    return summaries.concordance(s, ["qp"], F.col("g1"), F.col("g2"))


@query(f"""WITH {DELTAS}, j AS (SELECT clip, qp, metric, delta, CASE metric WHEN 'bg_q' THEN 0.004 WHEN 'fg_q' THEN 2.0 ELSE 20.0 END AS jnd FROM d), k AS (SELECT *, abs(delta) >= jnd AS outside, row_number() OVER (PARTITION BY clip, qp ORDER BY abs(delta) >= jnd DESC, abs(delta) / jnd DESC, metric DESC) AS rn FROM j)
SELECT clip, qp, count(*) AS available, count(*) FILTER (outside) AS outside, max(metric) FILTER (rn = 1 AND outside) AS binding, CASE WHEN bool_or(outside) THEN 'distinguishable' WHEN bool_or(metric = 'bg_q') THEN 'indistinguishable' ELSE 'indistinguishable_psnr_only' END AS verdict FROM k GROUP BY 1, 2""")
def t16_pair_verdict(spark, sf_dir):
    d = clip_deltas(spark, sf_dir).withColumn("jnd", F.when(F.col("metric") == "bg_q", 0.004).when(F.col("metric") == "fg_q", 2.0).otherwise(20.0))
    return summaries.pair_verdict(d, ["clip", "qp"], "metric", "delta", "jnd", ["bg_q"])


@query(f"""WITH {DELTAS}, n AS (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY clip) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n, delta AS v FROM c),
x AS (SELECT metric, rep, CAST(CAST('0x' || substr(md5('b|' || metric || '|' || rep || '|' || i), 1, 8) AS UBIGINT) % n AS BIGINT) AS i FROM n, range(200) t(rep)),
m AS (SELECT metric, rep, avg(v) AS m FROM x JOIN n USING (metric, i) GROUP BY 1, 2), l AS (SELECT metric, list_sort(list(m)) AS l FROM m GROUP BY 1), z AS (SELECT metric, count(*) AS n, avg(delta) AS mean, max(abs(delta)) AS max_abs FROM c GROUP BY 1)
SELECT metric, n, round(mean, 6) AS mean, round(l[11], 6) AS lo, round(l[191], 6) AS hi, round(max_abs, 6) AS max_abs, CASE WHEN n < 2 THEN 'insufficient_pairs' WHEN l[11] > -0.05 AND l[191] < 0.05 AND max_abs < 0.05 THEN 'equivalent' ELSE 'not_shown_equivalent' END AS verdict FROM l JOIN z USING (metric)""")
def t11_equivalence(spark, sf_dir):
    c = clip_deltas(spark, sf_dir).groupBy("metric", "clip").agg(F.round(F.avg("delta"), 6).alias("delta"))
    return stats.equivalence(c, ["metric"], "clip", 0.05).select("metric", "n", r6("mean"), r6("lo"), r6("hi"), r6("max_abs"), "verdict")


@query(f"""WITH {F1}, s AS (SELECT a.clip, a.qp, a.rate AS base, b.rate - a.rate AS d FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND a.arm = 'A' AND b.arm = 'R'),
o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY base, d) AS k, count(*) OVER (PARTITION BY clip) AS n FROM s) SELECT clip, round(median(d) FILTER (k <= 2) - median(d) FILTER (k > n - 2), 6) AS contrast FROM o WHERE n >= 4 GROUP BY 1""")
def t24_regime_contrast(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir).where("arm IN ('A', 'R')"), ["clip", "qp"], "arm", "A", ["rate"]).withColumn("d", F.col("rate") - F.col("base_rate"))
    return summaries.regime_contrast(s, "clip", "base_rate", "d").withColumn("contrast", F.round("contrast", 6))


@query(f"""WITH {F1}, l AS (SELECT clip, arm, qp, ln(rate) AS x, bg_q AS y FROM f1), f AS (SELECT clip, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM l GROUP BY 1 HAVING count(*) >= 3 AND regr_slope(y, x) < 0) SELECT clip, arm, qp, round((s * x + i - y) / 0.005, 6) AS residual FROM l JOIN f USING (clip)""")
def t21_ladder_residuals(spark, sf_dir):
    return stats.residuals(runs(spark, sf_dir).select("clip", "arm", "qp", F.log("rate").alias("x"), F.col("bg_q").alias("y")), ["clip"], "x", "y", 0.005).select("clip", "arm", "qp", r6("residual"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w2_best_of_duplicates(spark, sf_dir):
    return summaries.first_of(load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderpriority"], ["o_totalprice", "o_orderkey"])


@query("SELECT p_brand, v, row_number() OVER (PARTITION BY p_brand ORDER BY try_cast(v AS DOUBLE) NULLS LAST, v) AS place FROM (SELECT p_brand, CAST(p_size AS VARCHAR) AS v FROM part UNION SELECT p_brand, p_type FROM part)")
def l6_numeric_order(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    v = p.select("p_brand", F.explode(F.array(F.col("p_size").cast("string"), "p_type")).alias("v")).distinct()
    return v.select("p_brand", "v", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("v").try_cast("double").asc_nulls_last(), "v")).alias("place"))


@query("SELECT p_brand, n_nationkey FROM (SELECT DISTINCT p_brand FROM part), nation WHERE (p_brand, n_nationkey) NOT IN (SELECT p_brand, s_nationkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49)")
def g2_planned_not_observed(spark, sf_dir):
    li, p, s = load(spark, sf_dir, "lineitem").where("l_quantity > 49"), load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    seen = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select("p_brand", F.col("s_nationkey").alias("n_nationkey")).distinct()
    # the plan itself: a product of two lists of settings
    plan = p.select("p_brand").distinct().crossJoin(load(spark, sf_dir, "nation").select("n_nationkey"))
    return plan.join(seen, ["p_brand", "n_nationkey"], "left_anti")
