"""Queries of suites: verdicts, significance tables, contrasts, links, scorecards, predictor scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import pairing, stats, suites
from tarn.plans.catalog import CLIP_DELTAS, F1, F3, JND, SIGN_P, _clips, assess, assessed_sql, blocks, load, query, runs

def _sign_p(pos: str, neg: str) -> str:
    return SIGN_P.replace("n_pos", pos).replace("n_neg", neg)


_SUITES = """u AS (
  SELECT 'all' AS suite, metric, clip, delta FROM c UNION ALL SELECT 'risen', metric, clip, delta FROM c WHERE delta > 0 UNION ALL SELECT 'fallen', metric, clip, delta FROM c WHERE delta < 0
  UNION ALL SELECT 'few', metric, clip, delta FROM c WHERE delta > 0 AND clip < 'Brand#15' UNION ALL SELECT 'one', metric, clip, delta FROM c WHERE clip = 'Brand#1'
)"""


@query(f"""WITH {CLIP_DELTAS}, {_SUITES}, {JND}, {assessed_sql('u', 'suite, metric', 1)}
SELECT suite, metric, n, n_pos, n_neg, round(mean, 9) AS mean, round(med, 9) AS median, round(p, 9) AS p, round(p_corrected, 9) AS p_corrected, direction, clears, verdict FROM v""")
def t14_suite_verdicts(spark, sf_dir):
    """Suites of one metric each, cut so that wins, losses, small effects, mixed, thin and single ones occur."""
    c = _clips(spark, sf_dir).select("metric", "clip", "delta")
    cuts = {"all": F.lit(True), "risen": F.col("delta") > 0, "fallen": F.col("delta") < 0, "few": (F.col("delta") > 0) & (F.col("clip") < "Brand#15"), "one": F.col("clip") == "Brand#1"}
    named = F.array_compact(F.array(*[F.when(cut, F.lit(name)) for name, cut in cuts.items()]))
    v = assess(c.select("*", F.explode(named).alias("suite")), ["suite", "metric"], 1)
    return v.select("suite", "metric", "n", "n_pos", "n_neg", F.round("mean", 9).alias("mean"), F.round("median", 9).alias("median"), F.round("p", 9).alias("p"), F.round("p_corrected", 9).alias("p_corrected"), "direction", "clears", "verdict")


_OBJECTIVES = "o AS (SELECT a.clip, a.qp, a.arm, unnest(['quality', 'bits']) AS objective, unnest([a.bg_q - b.bg_q, round(100 * (a.rate - b.rate) / b.rate, 6)]) AS d FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'A' WHERE a.arm <> 'A'), u AS (SELECT objective, arm, clip, round(avg(d), 6) AS d FROM o GROUP BY ALL)"


def _objectives(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir), ["clip", "qp"], "arm", "A", ["rate", "bg_q"])
    gains = F.create_map(F.lit("quality"), F.col("bg_q") - F.col("base_bg_q"), F.lit("bits"), F.round(100 * (F.col("rate") - F.col("base_rate")) / F.col("base_rate"), 6))
    return s.select("clip", "qp", "arm", F.explode(gains).alias("objective", "d"))


@query(f"""WITH {F1}, {_OBJECTIVES}, s AS (SELECT objective, arm, count(*) AS n, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg FROM u GROUP BY ALL), p AS (SELECT *, {SIGN_P} AS p FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY p, arm) AS k FROM p), h AS (SELECT *, least(1.0, max((5 - k + 1) * p) OVER (PARTITION BY objective ORDER BY k)) AS p_holm FROM r)
SELECT objective, arm, n, n_pos AS base_wins, n_neg AS cand_wins, round(p, 9) AS p, round(p_holm, 9) AS p_holm, CASE WHEN n < 6 THEN 'underpowered (n<6)' WHEN p_holm < 0.05 THEN 'SIGNIFICANT' ELSE 'n.s.' END AS verdict FROM h""")
def t23_significance(spark, sf_dir):
    units = suites.per_unit(_objectives(spark, sf_dir), ["objective", "arm"], "clip", "d")
    t = suites.significance(units, ["objective"], "arm", "d", 5)
    return t.select("objective", "arm", "n", F.col("n_pos").alias("base_wins"), F.col("n_neg").alias("cand_wins"), F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), "verdict")


@query(f"WITH {CLIP_DELTAS}, {JND}, {assessed_sql('c', 'metric', 2)}, g AS (SELECT metric, min(delta) AS least, max(delta) AS most FROM c GROUP BY 1) SELECT metric, n, round(mean, 6) AS mean, round(p_corrected, 9) AS p_corrected, verdict, round(least, 6) AS least, round(most, 6) AS most FROM v JOIN g USING (metric)")
def t36_effects_of_one_arm(spark, sf_dir):
    """Several effects of one arm, a family of two, with the bounds of the gain."""
    c = _clips(spark, sf_dir)
    bounds = c.groupBy("metric").agg(F.round(F.min("delta"), 6).alias("least"), F.round(F.max("delta"), 6).alias("most"))
    return assess(c, ["metric"], 2).join(bounds, "metric").select("metric", "n", F.round("mean", 6).alias("mean"), F.round("p_corrected", 9).alias("p_corrected"), "verdict", "least", "most")


_SUBSETS = "w AS (SELECT CASE WHEN clip < 'Brand#2' THEN 'first' ELSE 'second' END AS subset, * FROM c UNION ALL SELECT 'both', * FROM c)"


@query(f"WITH {CLIP_DELTAS}, {_SUBSETS}, {JND}, {assessed_sql('w', 'subset, metric', 1)} SELECT subset, metric, n, n_pos, n_neg, round(p, 9) AS p, verdict FROM v")
def t37_breadth(spark, sf_dir):
    """The same verdict on each subset of the clips and on all."""
    part = F.when(F.col("clip") < "Brand#2", "first").otherwise("second")
    c = _clips(spark, sf_dir).select("metric", "clip", "delta", F.explode(F.array(part, F.lit("both"))).alias("subset"))
    return assess(c, ["subset", "metric"], 1).select("subset", "metric", "n", "n_pos", "n_neg", F.round("p", 9).alias("p"), "verdict")


_CONTRASTS = "x AS (SELECT a.arm AS a, b.arm AS b, a.clip, round(avg(b.bg_q - a.bg_q), 6) AS delta, 'bg_q' AS metric FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE (a.arm, b.arm) IN (('A', 'N'), ('A', 'R'), ('N', 'R')) GROUP BY ALL)"


@query(f"WITH {F1}, {_CONTRASTS}, {JND}, {assessed_sql('x', 'a, b', 3)} SELECT a, b, n, n_pos, n_neg, round(mean, 6) AS mean, round(p_corrected, 9) AS p_corrected, verdict FROM v")
def t38_contrasts(spark, sf_dir):
    c = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "N"), ("A", "R"), ("N", "R")], "bg_q")
    units = suites.per_unit(c, ["a", "b"], "clip", "delta").withColumn("metric", F.lit("bg_q"))
    return assess(units, ["a", "b"], 3).select("a", "b", "n", "n_pos", "n_neg", F.round("mean", 6).alias("mean"), F.round("p_corrected", 9).alias("p_corrected"), "verdict")


@query(f"""WITH {F1}, {_OBJECTIVES}, s AS (SELECT objective, arm, count(*) AS units, count(*) FILTER (d < 0) AS favouring, count(*) FILTER (d > 0) AS against, avg(d) AS mean FROM u GROUP BY ALL)
SELECT objective, arm, units, favouring, against, round(mean, 6) AS mean, round({_sign_p('against', 'favouring')}, 9) AS p FROM s""")
def t39_relinked(spark, sf_dir):
    l = suites.links(_objectives(spark, sf_dir), ["objective", "arm"], "clip", "d", 1.0)  # noqa: E741
    return l.select("objective", "arm", "units", "favouring", "against", F.round("mean", 6).alias("mean"), F.round("p", 9).alias("p"))


@query(f"""WITH {F1}, l AS (SELECT 'A-N' AS link, a.clip, a.qp, b.rate - a.rate AS d FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'A' AND b.arm = 'N' UNION ALL SELECT 'N-R', a.clip, a.qp, b.rate - a.rate FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'N' AND b.arm = 'R'),
u AS (SELECT link, clip, round(avg(d), 6) AS d FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY d) AS i, count(*) OVER (PARTITION BY link) AS n FROM u)
SELECT link, count(*) AS units, round(max(CASE WHEN i = n // 2 + 1 THEN d END), 6) AS upper_median, count(*) FILTER (abs(d) >= 20) AS perceptible FROM k GROUP BY 1""")
def t40_chain(spark, sf_dir):
    """Links of a chain of arms, each against the one before it."""
    c = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "N"), ("N", "R")], "rate").select(F.concat_ws("-", "a", "b").alias("link"), "clip", "delta")
    return suites.links(c, ["link"], "clip", "delta", 20.0).select("link", "units", F.round("upper_median", 6).alias("upper_median"), "perceptible")


@query(f"""WITH {F1}, {_OBJECTIVES}, g AS (SELECT objective, arm, -d AS gain FROM u), s AS (SELECT objective, arm, count(*) FILTER (gain > 0) AS n_pos, count(*) FILTER (gain < 0) AS n_neg, avg(gain) AS mean, min(gain) AS worst, max(gain) AS best FROM g GROUP BY ALL), p AS (SELECT *, {SIGN_P} AS p FROM s)
SELECT objective, arm, n_pos, n_neg, round(mean, 6) AS mean, round(worst, 6) AS worst, round(best, 6) AS best, CASE WHEN least(1.0, 2 / pow(2.0, n_pos + n_neg)) > 0.05 THEN 'open' WHEN p <= 0.05 AND n_pos > n_neg THEN 'met' WHEN p <= 0.05 THEN 'missed' ELSE 'not shown' END AS verdict FROM p""")
def t41_scorecard(spark, sf_dir):
    units = suites.per_unit(_objectives(spark, sf_dir), ["objective", "arm"], "clip", "d").withColumn("gain", -F.col("d"))
    s = suites.scorecard(units, ["objective", "arm"], "gain")
    return s.select("objective", "arm", "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("mean", "worst", "best")], "verdict")


@query(f"WITH {F1} SELECT clip, qp, arg_min(arm, (bg_q, arm)) AS best, count(*) AS n, round(max(bg_q) - min(bg_q), 6) AS spread, max(bg_q) - min(bg_q) >= 0.004 AS tells FROM f1 GROUP BY 1, 2")
def t42_best_per_cell(spark, sf_dir):
    return suites.best_per_cell(runs(spark, sf_dir), ["clip", "qp"], "arm", "bg_q", 0.004).withColumn("spread", F.round("spread", 6))


@query(f"""WITH {F1}, d AS (SELECT a.qp, b.fg_q - a.fg_q AS d FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'A' AND b.arm = 'N'), s AS (SELECT qp, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg FROM d GROUP BY 1), t AS (SELECT *, CAST(sign(n_pos - n_neg) AS INT) AS side FROM s)
SELECT *, coalesce(side * lag(side) OVER (ORDER BY qp) < 0, false) AS flipped FROM t""")
def t43_sign_flips(spark, sf_dir):
    c = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "N")], "fg_q")
    return suites.sign_flips(c, ["qp"], "delta")


_ATTRS = """attrs AS (SELECT p_brand AS clip, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 6) AS price, CASE WHEN p_brand > 'Brand#3' THEN NULL ELSE round(avg(p_partkey), 6) END AS place FROM part GROUP BY 1),
oc AS (SELECT a.clip, round(avg(CASE WHEN b.bg_q < a.bg_q THEN 1.0 ELSE 0.0 END), 6) AS y FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'A' AND b.arm = 'R' GROUP BY 1),
lo AS (SELECT clip, y, unnest(['size', 'price', 'place']) AS attribute, unnest([size, price, place]) AS x FROM attrs JOIN oc USING (clip)), lg AS (SELECT * FROM lo WHERE x IS NOT NULL)"""


def _attributes(spark, sf_dir):
    at = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("clip")).agg(F.round(F.avg("p_size"), 6).alias("size"), F.round(F.avg("p_retailprice"), 6).alias("price"), F.round(F.avg("p_partkey"), 6).alias("place"))
    at = at.withColumn("place", F.when(F.col("clip") <= "Brand#3", F.col("place")))
    won = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "R")], "bg_q").groupBy("clip").agg(F.round(F.avg((F.col("delta") < 0).cast("double")), 6).alias("y"))
    return suites.outcomes_by_attribute(at.join(won, "clip"), ["size", "price", "place"], "clip", "y")


@query(f"WITH {F1}, {_ATTRS} SELECT attribute, clip, x, y FROM lg")
def j20_attributes_to_outcomes(spark, sf_dir):
    return _attributes(spark, sf_dir).select("attribute", "clip", "x", "y")


_RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY attribute ORDER BY x) + (count(*) OVER (PARTITION BY attribute, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY attribute ORDER BY y) + (count(*) OVER (PARTITION BY attribute, y) - 1) / 2.0 AS ry FROM lg), rh AS (SELECT attribute, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY 1)"


@query(f"WITH {F1}, {_ATTRS}, {_RANKED} SELECT attribute, n, round(rho, 9) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 6) AS t FROM rh")
def t27_predictors(spark, sf_dir):
    return suites.predictors(_attributes(spark, sf_dir), ["attribute"]).select("attribute", "n", F.round("rho", 9).alias("rho"), F.round("t", 6).alias("t"))


@query(None)
def t26_predictor_scan(spark, sf_dir):
    """Predictors on each subset: rho, permutation p by seeded draws, Holm inside the subset, and the count of rows as confound."""
    long = _attributes(spark, sf_dir)
    subset = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("clip") < "Brand#2", "first"))))
    cut = long.select("*", subset.alias("subset"))
    p = stats.permutation(cut, ["subset", "attribute"], "clip", "x", "y", 200)
    n = cut.groupBy("subset", "attribute").agg(F.count("*").alias("n"))
    return stats.holm(p.join(n, ["subset", "attribute"]).where("rho IS NOT NULL").select("subset", "p", "attribute", "rho", "n"), ["subset"]).withColumn("survives", F.col("p_holm") < 0.05)


@query(f"""WITH {F3}, lg AS (SELECT "by", unnest(['v', 'w']) AS predictor, unnest([v, w]) AS x FROM f3), s AS (SELECT "by", predictor, stddev_pop(x) / abs(avg(x)) AS cv FROM lg GROUP BY ALL) SELECT "by", predictor, round(cv, 6) AS cv, cv < 0.05 AS degenerate FROM s""")
def t30_degenerate_predictors(spark, sf_dir):
    return suites.degenerate(blocks(spark, sf_dir), "by", ["v", "w"]).withColumn("cv", F.round("cv", 6))


@query(f"""WITH {F3}, e AS (SELECT frame, "by" IN (0, 11) OR bx IN (0, 9) AS edge, v FROM f3) SELECT frame, round(avg(v) FILTER (edge), 4) AS at_edge, round(avg(v) FILTER (NOT edge), 4) AS inside, round(avg(v) FILTER (edge) - avg(v) FILTER (NOT edge), 4) AS excess FROM e GROUP BY 1""")
def t30_edge_excess(spark, sf_dir):
    edge = F.col("by").isin(0, 11) | F.col("bx").isin(0, 9)
    a, b = F.avg(F.when(edge, F.col("v"))), F.avg(F.when(~edge, F.col("v")))
    return blocks(spark, sf_dir).groupBy("frame").agg(F.round(a, 4).alias("at_edge"), F.round(b, 4).alias("inside"), F.round(a - b, 4).alias("excess"))


@query(None)
def t7_bootstrap_rho(spark, sf_dir):
    """Percentile interval of Spearman's rho over the blocks of each frame."""
    return stats.bootstrap_rho(blocks(spark, sf_dir).withColumn("place", F.col("by") * 100 + F.col("bx")), ["frame"], "place", "v", "w", 100)


@query("SELECT n, least(1.0, 2 / pow(2.0, n)) AS floor, least(1.0, 3 * 2 / pow(2.0, n)) <= 0.05 AS enough FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n")
def t2_floors(spark, sf_dir):
    n = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("n").distinct()
    return n.select("n", scalar.sign_test_floor(F.col("n")).alias("floor"), (F.col("n") >= scalar.pairs_needed(0.05, 3)).alias("enough"))


@query("""WITH d AS (SELECT l_returnflag AS arm, round(l_extendedprice - 38000 - 700 * l_quantity / 20, 2) AS d, l_linenumber AS k FROM lineitem), z AS (SELECT arm, d, abs(d) AS a FROM d WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY arm ORDER BY a) + (count(*) OVER (PARTITION BY arm, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY arm, a) AS t FROM z),
s AS (SELECT arm, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(t * t - 1) AS ties FROM r GROUP BY 1)
SELECT arm, CAST(n AS INT) AS n, w AS w_plus, round(abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48.0), 6) AS z FROM s""")
def t4_wilcoxon_large(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.round(F.col("l_extendedprice") - 38000 - 700 * F.col("l_quantity") / 20, 2).alias("delta"))
    return stats.wilcoxon(d, ["arm"]).select("arm", "n", "w_plus", F.round("z", 6).alias("z"))


@query(f"WITH {F1}, {_OBJECTIVES}, s AS (SELECT objective, arm, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg FROM u GROUP BY ALL), p AS (SELECT *, {SIGN_P} AS p FROM s) SELECT objective, arg_min(arm, (p, arm)) AS arm, round(least(1.0, 2 * min(p)), 9) AS p_bonferroni FROM p GROUP BY 1")
def t13_single_candidate(spark, sf_dir):
    """The one candidate that is reported, corrected for all that were tried."""
    s = stats.signs(suites.per_unit(_objectives(spark, sf_dir), ["objective", "arm"], "clip", "d"), ["objective", "arm"], "d")
    return s.groupBy("objective").agg(F.min_by("arm", F.struct("p", "arm")).alias("arm"), F.round(stats.bonferroni(F.min("p"), 2), 9).alias("p_bonferroni"))


@query(f"WITH {F1} SELECT DISTINCT arm FROM f1 WHERE arm <> 'A'")
def u5_candidates(spark, sf_dir):
    return runs(spark, sf_dir).where("arm <> 'A'").select("arm").distinct()


@query(f"WITH {F1}, b AS (SELECT clip, regr_slope(bg_q, rate) AS s, regr_intercept(bg_q, rate) AS i FROM f1 WHERE arm = 'A' GROUP BY 1) SELECT f1.clip, qp, arm, round(abs(bg_q - s * rate - i), 6) AS residual FROM f1 JOIN b USING (clip) WHERE arm <> 'A' ORDER BY abs(bg_q - s * rate - i) DESC, clip, qp, arm LIMIT 10")
def l5_largest_residuals(spark, sf_dir):
    """A top-10 report: the limit is its feature."""
    r = runs(spark, sf_dir)
    line = r.where("arm = 'A'").groupBy("clip").agg(F.regr_slope("bg_q", "rate").alias("s"), F.regr_intercept("bg_q", "rate").alias("i"))
    off = F.abs(F.col("bg_q") - F.col("s") * F.col("rate") - F.col("i"))
    return r.where("arm <> 'A'").join(line, "clip").select("clip", "qp", "arm", off.alias("_r")).orderBy(F.desc("_r"), "clip", "qp", "arm").limit(10).select("clip", "qp", "arm", F.round("_r", 6).alias("residual"))


@query(f"""WITH {F1}, g AS (SELECT a.clip, a.qp, a.arm, a.bg_q - n.bg_q AS gain, (a.bg_q - n.bg_q) < 0 AS improved FROM f1 a JOIN f1 n ON a.clip = n.clip AND a.qp = n.qp AND n.arm = 'N' WHERE a.arm <> 'N') SELECT clip, qp, arm, round(gain, 6) AS gain, improved FROM g""")
def j11_gain_over_control(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir), ["clip", "qp"], "arm", "N", ["bg_q"])
    return s.select("clip", "qp", "arm", F.round(F.col("bg_q") - F.col("base_bg_q"), 6).alias("gain"), (F.col("bg_q") < F.col("base_bg_q")).alias("improved"))


@query(f"WITH {F1}, o AS (SELECT * FROM f1 WHERE arm = 'R'), t AS (SELECT o.clip, o.qp, o.rate, b.qp AS base_qp, b.rate AS base_rate, row_number() OVER (PARTITION BY o.clip, o.qp ORDER BY abs(b.rate - o.rate), b.qp) AS k FROM o JOIN f1 b ON b.clip = o.clip AND b.arm = 'A') SELECT clip, qp, base_qp, round(rate - base_rate, 6) AS off FROM t WHERE k = 1")
def j13_baseline_at_own_target(spark, sf_dir):
    """Each run beside the baseline run of its clip whose rate is nearest to its own."""
    return pairing.nearest(runs(spark, sf_dir), ["clip"], "arm", "R", "A", "qp", "rate").select("clip", "qp", "base_qp", F.round("off", 6).alias("off"))


@query(f"WITH {F1} SELECT a.qp, count(*) AS n, round(avg(r.fg_q - a.fg_q), 6) AS mean, count(*) FILTER (r.fg_q > a.fg_q) AS higher FROM f1 a JOIN f1 r ON a.clip = r.clip AND a.qp = r.qp WHERE a.arm = 'A' AND r.arm = 'R' GROUP BY 1")
def j23_shared_points(spark, sf_dir):
    c = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "R")], "fg_q")
    return c.groupBy("qp").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean"), F.count_if(F.col("delta") > 0).alias("higher"))


_AUDIT = f"""SELECT arm, count(*) AS cells, count(*) FILTER (db <= 0 AND dq <= 0.005) AS both, count(*) FILTER (db <= 0 AND dq > 0.005) AS bits_only, count(*) FILTER (db > 0 AND dq <= 0.005) AS quality_only, count(*) FILTER (db > 0 AND dq > 0.005) AS neither, round(avg(CASE WHEN db <= 0 AND dq <= 0.005 THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN c.bg_q IS NOT NULL AND a.bg_q < c.bg_q THEN 1.0 ELSE 0.0 END), 6) AS over_control
FROM (SELECT a.*, a.rate - b.rate AS db, a.bg_q - b.bg_q AS dq FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'A' WHERE a.arm <> 'A') a LEFT JOIN (SELECT clip, qp, bg_q FROM f1 WHERE arm = 'N') c USING (clip, qp) GROUP BY arm"""


@query(f"WITH {F1} {_AUDIT}")
def m4_goal_audit(spark, sf_dir):
    """Each arm's cells by which goals they meet against the baseline, and how often they beat the unfilled control."""
    r = runs(spark, sf_dir)
    s = pairing.star(r, ["clip", "qp"], "arm", "A", ["rate", "bg_q"]).join(r.where("arm = 'N'").select("clip", "qp", F.col("bg_q").alias("control")), ["clip", "qp"], "left")
    bits, quality = F.col("rate") - F.col("base_rate") <= 0, F.col("bg_q") - F.col("base_bg_q") <= 0.005
    return s.groupBy("arm").agg(
        F.count("*").alias("cells"), F.count_if(bits & quality).alias("both"), F.count_if(bits & ~quality).alias("bits_only"), F.count_if(~bits & quality).alias("quality_only"), F.count_if(~bits & ~quality).alias("neither"),
        F.round(F.avg((bits & quality).cast("double")), 6).alias("share"), F.round(F.avg(F.coalesce(F.col("bg_q") < F.col("control"), F.lit(False)).cast("double")), 6).alias("over_control"),
    )
