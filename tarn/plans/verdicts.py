"""Queries of whole verdicts: pairs with what was left out, suites with interval and wording, goals, predictors and their adjudication, block damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import adjudicate, audits, ranks, suites
from tarn.plans.catalog import DRAW, F1, SIGN_P, load, query, runs
from tarn.plans.studies import _ATTRS, _RANKED, _attributes

PAIRED = """r AS (SELECT p_brand AS clip, l_returnflag AS arm, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS rung, l_linenumber AS qp, CAST(l_suppkey % 2 AS INT) AS v, p_brand || '|' || l_returnflag || '|' || l_linenumber || '|' || (l_suppkey % 2) AS hash,
  round(avg(l_discount), 9) AS bg_q, CASE WHEN l_linenumber <> 3 OR l_returnflag <> 'R' THEN round(avg(l_quantity), 6) END AS fg_q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag, l_linenumber, l_suppkey % 2),
m AS (SELECT *, CASE WHEN qp = 5 AND arm = 'R' AND v = 0 THEN 'failed' WHEN rung IS NULL THEN 'no_pair_key' END AS why, qp = 4 AS unknown FROM r WHERE arm IN ('A', 'R')),
g AS (SELECT * FROM m WHERE why IS NULL), s AS (SELECT clip, rung, arm, arg_min(hash, hash) AS hash, arg_min(bg_q, hash) AS bg_q, arg_min({'x': fg_q}, hash)['x'] AS fg_q FROM g GROUP BY 1, 2, 3),
k AS (SELECT a.clip, a.rung, a.hash AS key_a, b.hash AS key_b, a.bg_q AS bg_a, b.bg_q AS bg_b, a.fg_q AS fg_a, b.fg_q AS fg_b FROM s a JOIN s b USING (clip, rung) WHERE a.arm = 'A' AND b.arm = 'R'),
l AS (SELECT clip, rung, key_a, key_b, unnest(['bg_q', 'fg_q']) AS metric, unnest([bg_a, fg_a]) AS value_a, unnest([bg_b, fg_b]) AS value_b FROM k)"""


def _collected(spark, sf_dir):
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    by = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("clip"), F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("qp"), (F.col("l_suppkey") % 2).cast("int").alias("v"))
    r = by.agg(F.round(F.avg("l_discount"), 9).alias("bg_q"), F.round(F.avg("l_quantity"), 6).alias("_fg"))
    r = r.withColumn("hash", F.concat_ws("|", "clip", "arm", "qp", "v")).withColumn("fg_q", F.when((F.col("qp") != 3) | (F.col("arm") != "R"), F.col("_fg"))).withColumn("rung", F.when(F.col("qp") < 7, F.col("qp")))
    failures = F.when((F.col("qp") == 5) & (F.col("arm") == "R") & (F.col("v") == 0), F.array(F.lit("bad"))).when(F.col("qp") != 4, F.array().cast("array<string>"))
    return suites.collect_pairs(r.withColumn("failures", failures), ["clip", "rung"], "arm", "A", "R", ["bg_q", "fg_q"], "hash", "failures")


@query(f"WITH {PAIRED} SELECT metric, clip, rung, key_a, key_b, round(value_b - value_a, 9) AS delta FROM l WHERE value_a IS NOT NULL AND value_b IS NOT NULL")
def t15_pairs(spark, sf_dir):
    """Pairs of two arms over all metrics; of runs that the pair keys do not tell apart the first by hash."""
    return _collected(spark, sf_dir)[0].select("metric", "clip", "rung", "key_a", "key_b", F.round("delta", 9).alias("delta"))


@query(f"""WITH {PAIRED}, x AS (SELECT why AS reason, NULL AS metric, hash AS x FROM m WHERE why IS NOT NULL UNION ALL SELECT 'unchecked', NULL, hash FROM g WHERE unknown
UNION ALL SELECT 'ambiguous', NULL, g.hash FROM g JOIN s USING (clip, rung, arm) WHERE g.hash <> s.hash UNION ALL SELECT 'unpaired', NULL, clip || '|' || rung FROM s GROUP BY clip, rung HAVING count(DISTINCT arm) < 2
UNION ALL SELECT 'no_metric', metric, clip || '|' || rung FROM l WHERE value_a IS NULL OR value_b IS NULL)
SELECT reason, metric, count(*) AS n, array_to_string(list_sort(list(x))[1:3], '; ') AS examples FROM x GROUP BY 1, 2""")
def t15_skips(spark, sf_dir):
    """What the pairing left out, by reason, with the first examples."""
    return _collected(spark, sf_dir)[1].withColumn("examples", F.array_join("examples", "; "))


SUITES = """d AS (SELECT a.clip, a.qp, b.bg_q - a.bg_q AS d, row_number() OVER (PARTITION BY a.qp ORDER BY a.clip) AS k FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp WHERE a.arm = 'A' AND b.arm = 'R'),
u AS (SELECT clip, qp, round(CASE WHEN qp = 1 THEN abs(d) + 0.02 WHEN qp = 2 THEN -abs(d) - 0.02 WHEN qp = 3 THEN abs(d) / 100 + 0.0001 WHEN qp = 4 THEN d WHEN qp IN (5, 6) THEN abs(d) + 0.02 WHEN k % 2 = 0 THEN 0 ELSE abs(d) + 0.02 END, 9) AS delta FROM d
  WHERE qp NOT IN (5, 6) OR (qp = 5 AND k <= 4) OR (qp = 6 AND k = 1))"""


def _suites(spark, sf_dir):
    c = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "R")], "bg_q")
    c = ranks.numbered(c.select("clip", "qp", "delta"), ["qp"], ["clip"], "k")
    q, d = F.col("qp"), F.col("delta")
    moved = F.when(q == 1, F.abs(d) + 0.02).when(q == 2, -F.abs(d) - 0.02).when(q == 3, F.abs(d) / 100 + 0.0001).when(q == 4, d).when(q.isin(5, 6), F.abs(d) + 0.02).when(F.col("k") % 2 == 0, F.lit(0.0)).otherwise(F.abs(d) + 0.02)
    kept = ~q.isin(5, 6) | ((q == 5) & (F.col("k") <= 4)) | ((q == 6) & (F.col("k") == 1))
    return c.where(kept).select("clip", "qp", F.round(moved, 9).alias("delta"), F.lit(0.005).alias("jnd"), F.lit(True).alias("low"))


_WORDS = " ".join(f"WHEN '{v}' THEN '{w.replace(chr(39), chr(39) * 2)}'" for v, w in suites.WORDING.items())


@query(f"""WITH {F1}, {SUITES}, s AS (SELECT qp, count(*) AS n, count(*) FILTER (delta > 0) AS n_pos, count(*) FILTER (delta < 0) AS n_neg, count(*) FILTER (delta = 0) AS n_zero, avg(delta) AS mean, median(delta) AS mid, stddev_samp(delta) AS sd, max(abs(delta)) AS scale, count(*) FILTER (abs(delta) >= 0.005) AS clearing FROM u GROUP BY 1),
nb AS (SELECT qp, row_number() OVER (PARTITION BY qp ORDER BY clip) - 1 AS i, count(*) OVER (PARTITION BY qp) AS n, delta AS v FROM u), dr AS (SELECT qp, rep, CAST({DRAW.format("'b|' || qp || '|' || rep || '|' || i")} % n AS BIGINT) AS i FROM nb, range(200) t(rep)),
me AS (SELECT qp, rep, avg(v) AS m FROM dr JOIN nb USING (qp, i) GROUP BY 1, 2), ci AS (SELECT qp, list_sort(list(m))[6] AS lo, list_sort(list(m))[196] AS hi FROM me GROUP BY 1),
p AS (SELECT *, {SIGN_P} AS p, least(1.0, 2 / pow(2.0, n_pos + n_neg)) AS floor, n_pos + n_neg > 0 AND (n_pos = 0 OR n_neg = 0) AS one_way FROM s JOIN ci USING (qp)),
a AS (SELECT *, least(1.0, 2 * p) AS pc, CASE WHEN one_way AND n_pos = 0 THEN 'better' WHEN one_way THEN 'worse' END AS dir, abs(mean) >= 0.005 AND 2 * clearing >= n AS clears, qp % 2 = 1 AS pri FROM p),
v AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_pairs' WHEN NOT one_way THEN 'no_consistent_direction' WHEN least(1.0, 2 * floor) > 0.05 THEN 'underpowered' WHEN pc > 0.05 THEN 'consistent_not_significant' WHEN clears AND dir = 'worse' THEN 'perceptual_loss' WHEN clears THEN 'perceptual_win' ELSE 'sub_jnd_significant' END AS verdict FROM a)
SELECT qp, n, n_pos, n_neg, n_zero, verdict, pri AS is_primary, CASE verdict {_WORDS} END AS wording, CASE WHEN n > 1 THEN round(mean, 6) END AS mean, CASE WHEN n > 1 THEN round(mid, 6) END AS median, CASE WHEN n > 1 AND sd > 1e-12 * greatest(scale, 1e-300) THEN round(mean / sd, 6) END AS dz,
CASE WHEN n > 1 THEN round(lo, 6) END AS ci_low, CASE WHEN n > 1 THEN round(hi, 6) END AS ci_high, CASE WHEN n > 1 THEN lo > 0 OR hi < 0 END AS ci_excludes_zero, CASE WHEN n > 1 THEN round(pc, 9) END AS p_corrected, CASE WHEN n > 1 THEN dir END AS direction, CASE WHEN n > 1 THEN clears END AS clears,
CASE WHEN n < 2 THEN '' ELSE concat_ws('; ', CASE WHEN n_zero > 0 THEN n_zero || ' pair(s) of exactly 0 are in no test: two arms of identical output?' END, CASE WHEN verdict = 'underpowered' THEN (n_pos + n_neg) || ' informative pair(s) in a family of 2 cannot be significant; 7 are needed' END,
CASE WHEN verdict = 'sub_jnd_significant' AND NOT (lo > 0 OR hi < 0) THEN 'the interval of the mean holds 0: state the interval, not the mean alone' END, CASE WHEN verdict IN ('perceptual_win', 'perceptual_loss') AND NOT pri THEN 'not the primary metric of its region: it corroborates and carries no claim' END) END AS warnings FROM v""")
def t14_full_verdicts(spark, sf_dir):
    """Suites cut so that each outcome that the rules can reach occurs, with interval, effect size, wording and warnings."""
    v = suites.suite_verdicts(_suites(spark, sf_dir), ["qp"], "clip", "delta", "jnd", "low", F.col("qp") % 2 == 1, family=2)
    r6 = [F.round(c, 6).alias(c) for c in ("mean", "median", "dz", "ci_low", "ci_high")]
    return v.select("qp", "n", "n_pos", "n_neg", "n_zero", "verdict", "is_primary", "wording", *r6, "ci_excludes_zero", F.round("p_corrected", 9).alias("p_corrected"), "direction", "clears", F.array_join("warnings", "; ").alias("warnings"))


@query()
def t14_signed_rank(spark, sf_dir):
    """The signed-rank p of each suite beside its sign test's; tests hold it against enumeration."""
    v = suites.suite_verdicts(_suites(spark, sf_dir), ["qp"], "clip", "delta", "jnd", "low", F.col("qp") % 2 == 1, family=2)
    return v.select("qp", "n", F.round("sign_p", 9).alias("sign_p"), F.round("wilcoxon_p", 9).alias("wilcoxon_p"), F.round("floor", 9).alias("floor"), F.round("jnd_ratio", 6).alias("jnd_ratio"))


GAINS = "g AS (SELECT a.arm, a.clip, round((n.bg_q - a.bg_q) / 0.005, 6) AS gain FROM f1 a JOIN f1 n ON a.clip = n.clip AND a.qp = n.qp WHERE n.arm = 'N' AND a.arm <> 'N')"


@query(f"""WITH {F1}, {GAINS}, h AS (SELECT arm, clip, list_sort(list(gain))[count(*) // 2 + 1] AS g FROM g GROUP BY 1, 2), s AS (SELECT arm, count(*) AS n, count(*) FILTER (g > 0) AS n_pos, count(*) FILTER (g <= 0) AS n_neg, list_sort(list(g))[count(*) // 2 + 1] AS value FROM h GROUP BY 1),
p AS (SELECT *, {SIGN_P} AS p FROM s), r AS (SELECT *, row_number() OVER (ORDER BY p, arm) AS k, count(*) OVER () AS m FROM p), q AS (SELECT *, least(1.0, max((m - k + 1) * p) OVER (ORDER BY k)) AS ph FROM r)
SELECT arm AS method, 'method' AS kind, round(value, 6) AS value, n, n_pos AS favouring, round(ph, 9) AS p_holm, CASE WHEN n < 2 THEN 'insufficient' WHEN n_pos > 0 AND n_neg > 0 AND ph > 0.05 THEN 'not_significant' WHEN 2 / pow(2.0, n) > 0.05 THEN 'underpowered' WHEN ph > 0.05 THEN 'not_significant' WHEN abs(value) >= 1 - 1e-9 THEN 'perceptual_win' ELSE 'sub_jnd_significant' END AS verdict FROM q
UNION ALL SELECT 'none', 'null', 0.0, NULL, NULL, NULL, 'reference' UNION ALL SELECT 'source', 'oracle', 10.0, NULL, NULL, NULL, 'upper bound'""")
def t41_goal_rows(spark, sf_dir):
    """A goal's methods by their gain over the unfilled control, each clip once, between null and oracle."""
    g = suites.contrasts(runs(spark, sf_dir), ["clip", "qp"], "arm", [("A", "N"), ("R", "N")], "bg_q").select(F.col("a").alias("arm"), "clip", F.round(F.col("delta") / 0.005, 6).alias("gain"))
    rows = suites.goal_rows(g, "arm", "clip", "gain", 1.0, [("none", "null", 0.0, "reference"), ("source", "oracle", 10.0, "upper bound")])
    return rows.select("method", "kind", F.round("value", 6).alias("value"), "n", "favouring", F.round("p_holm", 9).alias("p_holm"), "verdict")


#: Two-sided p of Student's t with nu degrees by its finite series, th = atan(t / sqrt(nu)).
STUDENT = """CASE WHEN rho IS NULL THEN NULL WHEN abs(rho) >= 1 THEN 0.0 WHEN nu % 2 = 1 THEN 1 - 2 / pi() * (th + CASE WHEN nu > 1 THEN sin(th) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda k: exp(2 * k * ln(2.0) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos(th), 2 * k + 1))) ELSE 0 END)
ELSE 1 - sin(th) * list_sum(list_transform(range(0, nu // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2.0) - 2 * lgamma(k + 1)) * pow(cos(th), 2 * k))) END"""


@query(f"""WITH {F1}, {_ATTRS}, {_RANKED}, t AS (SELECT attribute, n, rho, CAST(n - 2 AS BIGINT) AS nu, atan(abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) AS th FROM rh), p AS (SELECT *, {STUDENT} AS p FROM t), k AS (SELECT *, row_number() OVER (ORDER BY p, attribute) AS k, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
h AS (SELECT *, least(1.0, max((m - k + 1) * p) OVER (ORDER BY k)) AS ph FROM k) SELECT attribute, n, round(rho, 9) AS rho, round(p, 8) AS p, round(ph, 8) AS p_holm, CASE WHEN ph < 0.05 THEN 'SIGNIFICANT' WHEN p >= 0.05 THEN 'loser' ELSE 'loser (dies under Holm)' END AS verdict FROM h""")
def t27_predictor_p(spark, sf_dir):
    """Predictors with the p of Student's distribution and Holm over all of them."""
    r = adjudicate.predictors(_attributes(spark, sf_dir), [], "attribute", "x", "y")
    return r.select("attribute", "n", F.round("rho", 9).alias("rho"), F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"), "verdict")


NAMES = ["size", "orders", "likely"]
CELLS = """ce AS (SELECT n_name AS unit, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'open' END AS verdict, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
atb AS (SELECT unit, n_nationkey % 2 AS origin, CASE WHEN n_nationkey <> 3 THEN round(avg(c_acctbal), 6) END AS size, CAST(count(o_orderkey) AS DOUBLE) AS orders, round(avg(CASE WHEN o_orderkey % 4 < 3 AND o_orderstatus IN ('F', 'O') THEN CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END END), 6) AS likely
  FROM (SELECT n_name AS unit, n_nationkey, c_acctbal, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY unit, n_nationkey),
ra AS (SELECT target, unit, avg(hit) AS rate, count(*) AS cells FROM (SELECT unit, unnest(['wins', 'open']) AS target, unnest([CASE WHEN verdict IN ('won', 'lost') THEN CASE WHEN verdict = 'won' THEN 1.0 ELSE 0.0 END END, CASE WHEN verdict = 'open' THEN 1.0 ELSE 0.0 END]) AS hit FROM ce) WHERE hit IS NOT NULL GROUP BY 1, 2),
ln AS (SELECT target, unit, rate AS y, cells, origin, attribute, x FROM (SELECT *, unnest(['size', 'orders', 'likely']) AS attribute, unnest([size, orders, likely]) AS x FROM ra JOIN atb USING (unit)) WHERE x IS NOT NULL),
lo AS (SELECT *, unnest(CASE WHEN cells >= 50 AND unit NOT IN ('NATION_1', 'NATION_2') THEN ['all', 'thick', 'dropped'] WHEN cells >= 50 THEN ['all', 'thick'] WHEN unit NOT IN ('NATION_1', 'NATION_2') THEN ['all', 'dropped'] ELSE ['all'] END) AS subset FROM ln),
rk AS (SELECT *, rank() OVER (PARTITION BY target, subset, attribute ORDER BY x) + (count(*) OVER (PARTITION BY target, subset, attribute, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY target, subset, attribute ORDER BY y) + (count(*) OVER (PARTITION BY target, subset, attribute, y) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY target, subset, attribute ORDER BY unit) AS i, count(*) OVER (PARTITION BY target, subset, attribute) AS n FROM lo),
ob AS (SELECT target, subset, attribute, max(n) AS n, CASE WHEN max(n) >= 3 THEN corr(rx, ry) END AS rho FROM rk GROUP BY 1, 2, 3)"""
PERM = f"""mv AS (SELECT target, subset, attribute, rep, rx, row_number() OVER (PARTITION BY target, subset, attribute, rep ORDER BY {DRAW.format("'p|' || target || '|' || subset || '|' || attribute || '|' || rep || '|' || i")}, i) AS i FROM rk, range(1, 201) t(rep) WHERE n >= 3),
rr AS (SELECT mv.target, mv.subset, mv.attribute, rep, corr(mv.rx, rk.ry) AS r FROM mv JOIN rk ON mv.target = rk.target AND mv.subset = rk.subset AND mv.attribute = rk.attribute AND mv.i = rk.i GROUP BY 1, 2, 3, 4),
pp AS (SELECT target, subset, attribute, n, rho, CASE WHEN rho IS NOT NULL THEN (SELECT (count(*) FILTER (abs(r) >= abs(rho) - 1e-12) + 1) / 201.0 FROM rr WHERE rr.target = ob.target AND rr.subset = ob.subset AND rr.attribute = ob.attribute) END AS p FROM ob),
ho AS (SELECT *, least(1.0, max((3 - k + 1) * p) OVER (PARTITION BY target, subset ORDER BY k)) AS ph FROM (SELECT *, row_number() OVER (PARTITION BY target, subset ORDER BY p, attribute) AS k FROM pp WHERE p IS NOT NULL)),
sc AS (SELECT pp.*, ph, CASE WHEN pp.n < 6 THEN 'descriptive' WHEN coalesce(abs(pp.rho) >= 0.5, false) AND coalesce(ph < 0.05, false) THEN 'predictive' WHEN coalesce(abs(pp.rho) >= 0.5, false) THEN 'suggestive' ELSE 'negative' END AS status FROM pp LEFT JOIN ho USING (target, subset, attribute))"""


def _adjudicated(spark, sf_dir):
    o, c, n = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    # customers grow with the input: merged, since a broadcast of all would pass through the driver
    e = o.join(c.hint("merge"), o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    status = F.col("o_orderstatus")
    cells = e.select(F.col("n_name").alias("unit"), F.when(status == "F", "won").when(status == "O", "lost").otherwise("open").alias("verdict"))
    likely = F.when((F.col("o_orderkey") % 4 < 3) & status.isin("F", "O"), (status == "F").cast("double"))
    at = e.groupBy(F.col("n_name").alias("unit"), "n_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("_size"), F.count("o_orderkey").cast("double").alias("orders"), F.round(F.avg(likely), 6).alias("likely"))
    at = at.withColumn("size", F.when(F.col("n_nationkey") != 3, F.col("_size")))
    targets = {"wins": (["won"], ["won", "lost"]), "open": (["open"], ["won", "lost", "open"])}
    return adjudicate.adjudicate(cells, "unit", "verdict", targets, at, NAMES, F.col("n_nationkey") % 2 == 1, ["NATION_1", "NATION_2"], min_cells=50)


@query(f"WITH {CELLS}, {PERM}, t AS (SELECT target, subset, count(*) FILTER (status = 'predictive') >= 3 AS together FROM sc GROUP BY 1, 2) SELECT target, subset, attribute, n, round(rho, 6) AS rho, round(p, 9) AS p, round(ph, 9) AS p_holm, status, coalesce(abs(rho) > 0.9, false) AS alarm, together FROM sc JOIN t USING (target, subset)")
def t26_scan(spark, sf_dir):
    """Attributes against outcome rates on all units, on those of enough cells and without two named ones."""
    s = _adjudicated(spark, sf_dir)[0]
    return s.select("target", "subset", "attribute", "n", F.round("rho", 6).alias("rho"), F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), "status", "alarm", "together")


@query(f"""WITH {CELLS}, {PERM}, q AS (SELECT target, attribute, rank() OVER (PARTITION BY target, attribute ORDER BY x) + (count(*) OVER (PARTITION BY target, attribute, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY target, attribute ORDER BY cells) + (count(*) OVER (PARTITION BY target, attribute, cells) - 1) / 2.0 AS rc,
  rank() OVER (PARTITION BY target, attribute ORDER BY origin) + (count(*) OVER (PARTITION BY target, attribute, origin) - 1) / 2.0 AS ro FROM ln), cv AS (SELECT target, attribute, corr(rx, rc) AS cov, corr(rx, ro) AS pro FROM q GROUP BY 1, 2),
w AS (SELECT target, rank() OVER (PARTITION BY target ORDER BY rate) + (count(*) OVER (PARTITION BY target, rate) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY target ORDER BY cells) + (count(*) OVER (PARTITION BY target, cells) - 1) / 2.0 AS rc FROM ra), oc AS (SELECT target, corr(ry, rc) AS ocov FROM w GROUP BY 1),
a AS (SELECT s.target, s.attribute, s.n, s.rho, s.ph, s.status, k.n AS thick_n, k.rho AS thick_rho, k.ph AS thick_ph, cov, pro, ocov, coalesce(k.n >= 3 AND k.ph < 0.05, false) AS holds, coalesce(abs(cov) < 0.75 * abs(s.rho), false) AS cleaner FROM sc s LEFT JOIN sc k ON k.target = s.target AND k.attribute = s.attribute AND k.subset = 'thick' LEFT JOIN cv ON cv.target = s.target AND cv.attribute = s.attribute LEFT JOIN oc ON oc.target = s.target WHERE s.subset = 'all')
SELECT target, attribute, n, round(rho, 6) AS rho, round(ph, 9) AS p_holm, status, thick_n, round(thick_rho, 6) AS thick_rho, round(cov, 6) AS coverage_rho, round(ocov, 6) AS outcome_coverage_rho, round(pro, 6) AS provenance_rho, holds, cleaner, CASE WHEN status = 'predictive' AND NOT (holds AND cleaner) THEN 'withdrawn' ELSE status END AS verdict FROM a""")
def t26_adjudicated(spark, sf_dir):
    """One verdict for each target and attribute, after coverage, provenance and the thick units have been heard."""
    a = _adjudicated(spark, sf_dir)[1]
    r6 = [F.round(c, 6).alias(c) for c in ("rho", "thick_rho", "coverage_rho", "outcome_coverage_rho", "provenance_rho")]
    return a.select("target", "attribute", "n", "status", "thick_n", *r6, F.round("p_holm", 9).alias("p_holm"), "holds", "cleaner", "verdict")


MINED = """ru AS (SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN 'baselines' ELSE 'fill' END AS component, l_linestatus AS video, l_returnflag || l_linestatus || (l_linenumber % 3) AS hash, l_returnflag AS restorer FROM lineitem),
pa AS (SELECT d.hash, d.restorer, min(b.hash) AS base_key FROM ru d JOIN ru b ON d.video = b.video AND b.component = 'baselines' WHERE d.component <> 'baselines' GROUP BY 1, 2),
er AS (SELECT l_returnflag || l_linestatus || (l_linenumber % 3) AS hash, CAST(l_orderkey % (CASE WHEN l_returnflag = 'R' THEN 4 ELSE 3 END) AS INT) AS frame, CAST(l_partkey % 6 AS INT) AS "by", CAST(l_suppkey % 5 AS INT) AS bx, round(avg(l_extendedprice) / 100, 6) AS mse, CAST(max(l_quantity) % 3 AS INT) AS level FROM lineitem GROUP BY 1, 2, 3, 4, l_returnflag),
nf AS (SELECT hash, max(frame) + 1 AS n FROM er GROUP BY 1), sz AS (SELECT pa.hash, base_key, restorer, least(a.n, b.n) AS frames FROM pa JOIN nf a ON a.hash = pa.hash JOIN nf b ON b.hash = base_key),
ay AS (SELECT *, unnest(range(("by" * 24) // 64, (least("by" * 24 + 24, 140) - 1) // 64 + 1)) AS sy FROM er WHERE "by" * 24 < 140), ax AS (SELECT *, unnest(range((bx * 24) // 64, (least(bx * 24 + 24, 120) - 1) // 64 + 1)) AS sx FROM ay WHERE bx * 24 < 120),
ar AS (SELECT *, (least("by" * 24 + 24, (sy + 1) * 64, 140) - greatest("by" * 24, sy * 64)) * (least(bx * 24 + 24, (sx + 1) * 64, 120) - greatest(bx * 24, sx * 64)) AS w FROM ax),
po AS (SELECT hash, frame, sy, sx, sum(w * mse) / sum(w) AS mse, sum(w * CASE WHEN level > 0 THEN 1 ELSE 0 END) / sum(w) AS share FROM ar GROUP BY 1, 2, 3, 4),
dm AS (SELECT sz.hash, restorer, a.frame, a.sy, a.sx, a.share, 10 * log10(65025 / greatest(b.mse, 1e-12)) - 10 * log10(65025 / greatest(a.mse, 1e-12)) AS damage FROM sz JOIN po a ON a.hash = sz.hash AND a.frame < sz.frames JOIN po b ON b.hash = base_key AND b.frame = a.frame AND b.sy = a.sy AND b.sx = a.sx)"""


def _mined(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    hash_ = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("hash")
    r = li.select(F.when(F.col("l_returnflag") == "A", "baselines").otherwise("fill").alias("component"), F.col("l_linestatus").alias("video"), hash_, F.col("l_returnflag").alias("restorer")).distinct()
    frame = (F.col("l_orderkey") % F.when(F.col("l_returnflag") == "R", 4).otherwise(3)).cast("int").alias("frame")
    e = li.groupBy(hash_, frame, (F.col("l_partkey") % 6).cast("int").alias("by"), (F.col("l_suppkey") % 5).cast("int").alias("bx")).agg(F.round(F.avg("l_extendedprice") / 100, 6).alias("mse"), (F.max("l_quantity") % 3).cast("int").alias("level"))
    pairs = audits.matched(r, "hash", "component", "baselines", ["video"], F.col("component") != "baselines")
    d = audits.block_damage(pairs, "hash", e.select("hash", "frame", "by", "bx", "mse"), e.select("hash", "frame", "by", "bx", "level"), 24, 64, 140, 120)
    return d.join(pairs.select("hash", "restorer"), "hash")


@query(f"WITH {MINED} SELECT hash, frame, CAST(sy AS INT) AS sy, CAST(sx AS INT) AS sx, round(share, 6) AS strength_share, round(damage, 6) AS damage FROM dm")
def m5_mined_damage(spark, sf_dir):
    """dB lost by each superblock of each restored run against the first baseline of its point, errors pooled by area before they become dB."""
    return _mined(spark, sf_dir).select("hash", "frame", "sy", "sx", F.round("strength_share", 6).alias("strength_share"), F.round("damage", 6).alias("damage"))


@query(f"WITH {MINED} SELECT restorer, count(*) FILTER (share > 0.5) AS n_degraded, round(median(damage) FILTER (share > 0.5), 6) AS degraded, round(median(damage) FILTER (share = 0), 6) AS clean, round(quantile_cont(damage, 0.9) FILTER (share > 0.5) - quantile_cont(damage, 0.1) FILTER (share > 0.5), 6) AS spread FROM dm GROUP BY 1 HAVING count(*) FILTER (share > 0.5) > 0")
def m5_damage_summary(spark, sf_dir):
    """Damage of degraded and of clean superblocks by restorer, and its spread."""
    s = audits.damage_summary(_mined(spark, sf_dir), "restorer")
    return s.select("restorer", "n_degraded", *[F.round(c, 6).alias(c) for c in ("degraded", "clean", "spread")])


SCORED = """t AS (SELECT p_brand AS video, l_linenumber AS qp, CASE l_returnflag WHEN 'A' THEN 'baselines' ELSE 'fill' END AS component, l_returnflag || (l_suppkey % 2) AS config, CASE (l_suppkey // 2) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'near' END AS fill, 
  round(sum(l_extendedprice) / 1000, 6) AS bits, round(avg(l_quantity), 6) AS fg, CASE WHEN l_linenumber < 6 THEN round(avg(l_discount), 9) END AS bg, round(sum(l_tax), 6) AS seconds, count(*) AS frames FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_linenumber, l_returnflag, l_suppkey % 2, (l_suppkey // 2) % 3),
b AS (SELECT video, qp, arg_max(bits, config || coalesce(fill, '')) AS b, arg_max(fg, config || coalesce(fill, '')) AS f FROM t WHERE component = 'baselines' GROUP BY 1, 2),
c AS (SELECT video, qp, config, arg_max({'x': bg}, config || coalesce(fill, ''))['x'] AS bg FROM t WHERE component <> 'baselines' AND coalesce(fill, 'none') = 'none' GROUP BY 1, 2, 3),
s AS (SELECT t.*, CASE WHEN b.b > 0 THEN (t.bits < b.b) AND t.fg - b.f >= -0.5 END AS red, CASE WHEN coalesce(t.fill, 'none') <> 'none' THEN c.bg - t.bg >= 0.002 - 1e-9 END AS res FROM t LEFT JOIN b USING (video, qp) LEFT JOIN c ON c.video = t.video AND c.qp = t.qp AND c.config = t.config WHERE t.component <> 'baselines')"""


def _scored(spark, sf_dir):
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    third = F.floor(F.col("l_suppkey") / 2) % 3
    flag = F.col("l_returnflag")
    t = li.join(part, li.l_partkey == part.p_partkey).groupBy(
        F.col("p_brand").alias("video"), F.col("l_linenumber").alias("qp"), F.when(flag == "A", "baselines").otherwise("fill").alias("component"), F.concat(flag, (F.col("l_suppkey") % 2).cast("string")).alias("config"),
        F.when(third == 0, "none").when(third == 1, "near").alias("fill"),
    ).agg(F.round(F.sum("l_extendedprice") / 1000, 6).alias("bits"), F.round(F.avg("l_quantity"), 6).alias("fg"), F.round(F.avg("l_discount"), 9).alias("_bg"), F.round(F.sum("l_tax"), 6).alias("seconds"), F.count("*").alias("frames"))
    t = t.withColumn("bg", F.when(F.col("qp") < 6, F.col("_bg"))).withColumn("_order", F.concat("config", F.coalesce("fill", F.lit(""))))
    return audits.goals(t, ["video", "qp"], "component", "baselines", "bits", "fg", "bg", "config", "fill", 0.5, 0.002, "_order")


@query(f"""WITH {SCORED}, w AS (SELECT video, config, fill, unnest(['reduction', 'restoration', 'both', 'reduction_only', 'restoration_only', 'neither']) AS goal, unnest([red, res, CASE WHEN red IS NOT NULL AND res IS NOT NULL THEN red AND res END, CASE WHEN red IS NOT NULL AND res IS NOT NULL THEN red AND NOT res END,
CASE WHEN red IS NOT NULL AND res IS NOT NULL THEN NOT red AND res END, CASE WHEN red IS NOT NULL AND res IS NOT NULL THEN NOT red AND NOT res END]) AS hit FROM s), d AS (SELECT goal, hit, unnest(['all', 'video', 'config', 'fill']) AS dimension, unnest(['all', video, config, fill]) AS value FROM w WHERE hit IS NOT NULL)
SELECT goal, dimension, value, count(*) FILTER (hit) AS hits, count(*) AS cells FROM d GROUP BY 1, 2, 3""")
def m4_goal_scopes(spark, sf_dir):
    """Both goals and their meeting over all runs, and by clip, transport and fill."""
    return audits.goal_scopes(_scored(spark, sf_dir), ["video", "config", "fill"])


@query(f"WITH {SCORED} SELECT fill, count(*) AS n, round(avg(seconds / frames), 9) AS seconds_per_frame FROM s WHERE red AND res AND seconds > 0 AND frames > 0 GROUP BY 1")
def m4_restoration_cost(spark, sf_dir):
    """Seconds a frame by fill, over the runs that meet both goals."""
    return audits.restoration_cost(_scored(spark, sf_dir), "fill", "seconds", "frames").select("fill", "n", F.round("seconds_per_frame", 9).alias("seconds_per_frame"))
