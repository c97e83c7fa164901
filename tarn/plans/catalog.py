"""Registered queries and their SQL. The generated tables stand in for runs, documents, blocks, trials and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import curves, frontier, grid, pairing, ranks, stats, suites, vectors
from tarn.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

F1 = """f1 AS (SELECT p_brand AS clip, l_returnflag AS arm, l_linenumber AS qp, round(sum(l_extendedprice) / 1000.0, 6) AS rate, round(avg(l_discount), 9) AS bg_q,
  round(avg(l_quantity), 6) AS fg_q, count(*) AS frames FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
F3 = """f3 AS (SELECT l_linenumber AS frame, CAST(l_partkey % 12 AS INT) AS "by", CAST(l_suppkey % 10 AS INT) AS bx, round(avg(l_extendedprice), 6) AS v, round(avg(l_discount), 9) AS w,
  CASE WHEN round(avg(l_discount), 9) > 0.05 THEN 1 ELSE 0 END AS fg FROM lineitem GROUP BY 1, 2, 3)"""
SIGN_P = """CASE WHEN n_pos + n_neg = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(n_pos, n_neg) + 1),
  lambda i: exp(lgamma(n_pos + n_neg + 1) - lgamma(i + 1) - lgamma(n_pos + n_neg - i + 1) - (n_pos + n_neg) * ln(2.0))))) END"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer splits than there are cores dealt to all, before work that costs more than moving them; others stay where they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("clip"), F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("qp")).agg(
        F.round(F.sum("l_extendedprice") / 1000.0, 6).alias("rate"), F.round(F.avg("l_discount"), 9).alias("bg_q"), F.round(F.avg("l_quantity"), 6).alias("fg_q"), F.count("*").alias("frames")
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    by = li.groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 12).cast("int").alias("by"), (F.col("l_suppkey") % 10).cast("int").alias("bx"))
    return by.agg(F.round(F.avg("l_extendedprice"), 6).alias("v"), F.round(F.avg("l_discount"), 9).alias("w")).withColumn("fg", (F.col("w") > 0.05).cast("int"))


def clip_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delta of arm R over arm A for each clip and rung, for three metrics in long form."""
    long = runs(spark, sf_dir).select("clip", "arm", "qp", F.explode(F.create_map(F.lit("bg_q"), F.col("bg_q"), F.lit("fg_q"), F.col("fg_q"), F.lit("rate"), F.col("rate"))).alias("metric", "value"))
    return pairing.two_arms(long, ["metric", "clip", "qp"], "arm", "A", "R", "value", "qp")


CLIP_DELTAS = f"""{F1}, long AS (SELECT clip, arm, qp, 'bg_q' AS metric, bg_q AS value FROM f1 UNION ALL SELECT clip, arm, qp, 'fg_q', fg_q FROM f1 UNION ALL SELECT clip, arm, qp, 'rate', rate FROM f1),
d AS (SELECT a.metric, a.clip, a.qp, b.value - a.value AS delta FROM long a JOIN long b USING (metric, clip, qp) WHERE a.arm = 'A' AND b.arm = 'R'),
c AS (SELECT metric, clip, round(avg(delta), 6) AS delta FROM d GROUP BY 1, 2)"""
DELTAS = f"""{CLIP_DELTAS},
s AS (SELECT metric, count(*) FILTER (delta > 0) AS n_pos, count(*) FILTER (delta < 0) AS n_neg, count(*) FILTER (delta = 0) AS n_zero, avg(delta) AS mean, stddev_samp(delta) AS sd, count(*) FILTER (abs(delta) >= 0.001) AS clearing FROM c GROUP BY 1),
p AS (SELECT *, {SIGN_P} AS p FROM s)"""


def _clips(spark, sf_dir):
    return clip_deltas(spark, sf_dir).groupBy("metric", "clip").agg(F.round(F.avg("delta"), 6).alias("delta"))


#: Fixed values of the stand-in metrics: threshold, and whether a lower value is better.
METRICS = {"bg_q": (0.005, True), "fg_q": (0.3, False), "rate": (5.0, True)}
JND = "jnd AS (SELECT * FROM (VALUES ('bg_q', 0.005, true), ('fg_q', 0.3, false), ('rate', 5.0, true)) v(metric, jnd, low))"


def assessed_sql(source: str, group: str, family: int) -> str:
    """SQL of suites.assess() over a relation with metric and delta: v, after jnd."""
    return f"""s AS (
  SELECT {group}, count(*) AS n, count(*) FILTER (delta > 0) AS n_pos, count(*) FILTER (delta < 0) AS n_neg, avg(delta) AS mean, median(delta) AS med, stddev_samp(delta) AS sd,
    count(*) FILTER (abs(delta) >= jnd) AS clearing, max(jnd) AS jnd, bool_or(low) AS low
  FROM {source} JOIN jnd USING (metric) GROUP BY ALL
), p AS (SELECT *, {SIGN_P} AS p FROM s),
a AS (
  SELECT *, least(1.0, {family} * p) AS p_corrected, n_pos + n_neg > 0 AND (n_pos = 0 OR n_neg = 0) AS one_way,
    CASE WHEN low THEN n_pos = 0 ELSE n_neg = 0 END AS better, abs(mean) >= jnd AND 2 * clearing >= n AS clears
  FROM p
), v AS (
  SELECT *, CASE WHEN n < 2 THEN 'insufficient_pairs' WHEN NOT one_way THEN 'no_consistent_direction'
    WHEN least(1.0, {family} * 2 / pow(2.0, n_pos + n_neg)) > 0.05 + 1e-12 THEN 'underpowered' WHEN p_corrected > 0.05 + 1e-12 THEN 'consistent_not_significant'
    WHEN clears AND better THEN 'perceptual_win' WHEN clears THEN 'perceptual_loss' ELSE 'sub_jnd_significant' END AS verdict,
    CASE WHEN one_way AND better THEN 'better' WHEN one_way THEN 'worse' END AS direction
  FROM a
)"""


def assess(df: DataFrame, group: list[str], family: int) -> DataFrame:
    """Verdicts on suites of (metric, delta), with the thresholds of METRICS."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[i])]), F.col("metric"))
    return suites.assess(df.withColumn("jnd", pick(0)).withColumn("low", pick(1)), group, "delta", "jnd", "low", family)


@query(f"""WITH {CLIP_DELTAS}, {JND}, {assessed_sql('c', 'metric', 3)}, r AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS k FROM v)
SELECT metric, n_pos, n_neg, round(mean, 6) AS mean_delta, round(mean / sd, 6) AS dz, round(p, 9) AS p, round(least(1.0, max((3 - k + 1) * p) OVER (ORDER BY k)), 9) AS p_holm, metric = 'rate' AS is_primary, direction, verdict FROM r""")
def t15_suite_comparison(spark, sf_dir):
    """Suite comparison: pair arms, one delta per clip and metric, exact sign test, Holm, and a verdict with its direction for the family."""
    c = _clips(spark, sf_dir)
    a = assess(c, ["metric"], len(METRICS)).join(stats.effect_size(c, ["metric"]).select("metric", "dz"), "metric")
    h = stats.holm(a.withColumn("_all", F.lit(1)).select("_all", "p", "metric", "n_pos", "n_neg", "mean", "dz", "direction", "verdict"), ["_all"])
    return h.select("metric", "n_pos", "n_neg", F.round("mean", 6).alias("mean_delta"), F.round("dz", 6).alias("dz"), F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), (F.col("metric") == "rate").alias("is_primary"), "direction", "verdict")


@query(f"WITH {DELTAS} SELECT metric, clip, delta FROM c")
def j8_paired_deltas(spark, sf_dir):
    return _clips(spark, sf_dir)


@query(f"WITH {F1} SELECT a.clip, a.qp, a.arm, round(100 * (a.rate - b.rate) / b.rate, 6) AS dbits_pct, round(a.fg_q - b.fg_q, 6) AS dfg FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND b.arm = 'A' WHERE a.arm <> 'A'")
def m1_scored_arms(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir), ["clip", "qp"], "arm", "A", ["rate", "fg_q"])
    return s.select("clip", "qp", "arm", F.round(100 * (F.col("rate") - F.col("base_rate")) / F.col("base_rate"), 6).alias("dbits_pct"), F.round(F.col("fg_q") - F.col("base_fg_q"), 6).alias("dfg"))


@query(f"WITH {F1} SELECT a.clip, a.qp, a.arm AS a, b.arm AS b, round(b.rate - a.rate, 6) AS delta, abs(b.bg_q - a.bg_q) < 0.005 AS within FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND a.arm < b.arm")
def j5_all_pairs(spark, sf_dir):
    p = pairing.all_pairs(runs(spark, sf_dir), ["clip", "qp"], "arm", ["rate", "bg_q"])
    return p.select("clip", "qp", "a", "b", F.round(F.col("rate_b") - F.col("rate_a"), 6).alias("delta"), (F.abs(F.col("bg_q_b") - F.col("bg_q_a")) < 0.005).alias("within"))


@query(f"WITH {F1} SELECT clip, count(*) AS rows FROM f1 WHERE clip IN (SELECT clip FROM f1 GROUP BY clip HAVING count(DISTINCT arm || '|' || qp) = (SELECT count(DISTINCT arm || '|' || qp) FROM f1)) GROUP BY clip")
def j10_complete_clips(spark, sf_dir):
    return pairing.complete(runs(spark, sf_dir), "clip", ["arm", "qp"]).groupBy("clip").agg(F.count("*").alias("rows"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) GROUP BY 1")
def j7_runs_without_metric(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def q17_ambiguous_keys(spark, sf_dir):
    return pairing.refuse_ambiguous(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])[1]


@query(f"WITH {F1} SELECT clip, arm, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS sd, round(quantile_cont(rate, 0.1), 6) AS p10, round(quantile_cont(rate, 0.5), 6) AS p50, round(quantile_cont(rate, 0.9), 6) AS p90 FROM f1 GROUP BY 1, 2")
def a19_spread(spark, sf_dir):
    r = runs(spark, sf_dir)
    by = r.groupBy("clip", "arm").agg(F.round(F.avg("rate"), 6).alias("mean"), F.round(F.stddev_pop("rate"), 6).alias("sd"))
    q = ranks.quantiles(r, ["clip", "arm"], "rate", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).select("clip", "arm", *[F.round(n, 6).alias(n) for n in ("p10", "p50", "p90")])
    return ranks.same(by, q, ["clip", "arm"], "left")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 9) AS share FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def a10_success_by_sets(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"], []], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_totalprice") > 150000).cast("double")), 9).alias("share"))


@query("""SELECT o_orderpriority AS task, round(median(o_totalprice), 6) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most, round(stddev_samp(o_totalprice) / avg(o_totalprice), 9) AS cv, count(DISTINCT o_orderstatus) > 1 AS mixed FROM orders GROUP BY 1""")
def a14_trial_summary(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "task")
    by = o.groupBy("task").agg(
        F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"),
        F.round(F.stddev_samp("o_totalprice") / F.avg("o_totalprice"), 9).alias("cv"), (F.count_distinct("o_orderstatus") > 1).alias("mixed"),
    )
    return ranks.same(by, ranks.medians(o, ["task"], {"median": "o_totalprice"}), ["task"], "left").withColumn("median", F.round("median", 6))


@query(f"WITH {F1} SELECT clip, arm, count(*) AS n, round(regr_slope(fg_q, ln(rate)), 6) AS slope, round(regr_intercept(fg_q, ln(rate)), 6) AS intercept, round(regr_r2(fg_q, ln(rate)), 6) AS r2 FROM f1 GROUP BY 1, 2 HAVING count(*) >= 3")
def a22_least_squares(spark, sf_dir):
    y, x = F.col("fg_q"), F.log("rate")
    by = runs(spark, sf_dir).groupBy("clip", "arm").agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))
    return by.where("n >= 3")


@query("""WITH l AS (SELECT unnest(['quantity', 'discount', 'tax']) AS parameter, unnest([l_quantity, l_discount, l_tax]) AS x, l_extendedprice AS price, CAST(l_linenumber AS DOUBLE) AS line FROM lineitem),
m AS (SELECT parameter, x, unnest(['price', 'line']) AS metric, unnest([price, line]) AS y FROM l) SELECT parameter, metric, round(corr(x, y), 6) AS r FROM m GROUP BY 1, 2""")
def a23_correlations(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    xs, ys = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}, {"price": "l_extendedprice", "line": "l_linenumber"}
    one = li.agg(*[F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"{a}|{b}") for a, x in xs.items() for b, y in ys.items()])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("parameter"), F.lit(b).alias("metric"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a in xs for b in ys]))
    return one.select(each.alias("_e")).select("_e.*")


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderstatus, CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM orders, b GROUP BY 1, 2""")
def a26_histogram(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    b = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    bin_ = F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20)), F.lit(19)).cast("long")
    return o.select("o_orderstatus", "o_totalprice").join(F.broadcast(b)).groupBy("o_orderstatus", bin_.alias("bin")).agg(F.count("*").alias("n"))  # b is one row


@query(f"""WITH {F1}, r AS (SELECT clip, qp, arm, bg_q, lead(bg_q) OVER w - bg_q AS margin, row_number() OVER w AS rn, count(*) OVER (PARTITION BY clip, qp) AS n_arms FROM f1 WINDOW w AS (PARTITION BY clip, qp ORDER BY bg_q, arm))
SELECT clip, qp, arm AS winner, round(margin, 6) AS margin, n_arms, coalesce(margin >= 0.005 - 1e-9, false) AS separable FROM r WHERE rn = 1""")
def w1_decide_cells(spark, sf_dir):
    return frontier.decide(runs(spark, sf_dir), ["clip", "qp"], "arm", "bg_q", 0.005).withColumn("margin", F.round("margin", 6))


@query(f"""WITH {F1} SELECT a.clip, a.qp, a.arm FROM f1 a WHERE NOT EXISTS (SELECT 1 FROM f1 b WHERE a.clip = b.clip AND a.qp = b.qp AND a.arm <> b.arm AND b.rate <= a.rate AND b.bg_q <= a.bg_q AND b.fg_q >= a.fg_q
AND (b.rate < a.rate OR b.bg_q < a.bg_q OR b.fg_q > a.fg_q))""")
def j18_undominated(spark, sf_dir):
    return frontier.undominated(runs(spark, sf_dir), ["clip", "qp"], "arm", ["rate", "bg_q"], ["fg_q"]).select("clip", "qp", "arm")


@query(f"""WITH {F1}, r AS (SELECT clip, qp, lead(bg_q) OVER w - bg_q AS margin, row_number() OVER w AS rn FROM f1 WINDOW w AS (PARTITION BY clip, qp ORDER BY bg_q, arm))
SELECT threshold, count(*) AS cells, count(*) FILTER (margin >= threshold - 1e-9) AS separable FROM r, (SELECT unnest([0.001::DOUBLE, 0.003::DOUBLE, 0.005::DOUBLE, 0.008::DOUBLE]) AS threshold) WHERE rn = 1 GROUP BY 1""")
def t22_sensitivity(spark, sf_dir):
    return frontier.sensitivity(runs(spark, sf_dir), ["clip", "qp"], "arm", "bg_q", [0.001, 0.003, 0.005, 0.008])


@query(f"WITH {F1} SELECT a.clip, a.qp, a.arm, b.arm AS faster FROM f1 a JOIN f1 b ON a.clip = b.clip AND a.qp = b.qp AND a.arm <> b.arm AND abs(a.bg_q - b.bg_q) < 0.005 AND b.frames > 1.05 * a.frames")
def j17_faster_alternatives(spark, sf_dir):
    r = runs(spark, sf_dir)
    o = r.select("clip", "qp", F.col("arm").alias("faster"), F.col("bg_q").alias("q2"), F.col("frames").alias("f2"))
    return r.join(o, ["clip", "qp"]).where("arm <> faster AND abs(bg_q - q2) < 0.005 AND f2 > 1.05 * frames").select("clip", "qp", "arm", "faster")


def _curves(spark, sf_dir):
    w = Window.partitionBy("clip", "arm").orderBy(F.desc("qp"))
    return runs(spark, sf_dir).select("clip", "arm", "qp", F.sum("rate").over(w).alias("rate"), (0.05 * F.col("qp") + F.col("bg_q")).alias("q"))


@query()
def t17_bd_rate(spark, sf_dir):
    """Cubic fits have no short SQL; tests hold them against a least-squares solver."""
    b = curves.bd_rate(_curves(spark, sf_dir), ["clip"], "arm", "A", "N", "rate", "q")
    return b.select("clip", F.round("bd_rate", 4).alias("bd_rate"), F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {F1}, c AS (SELECT clip, arm, qp, sum(rate) OVER (PARTITION BY clip, arm ORDER BY qp DESC) AS rate, 0.05 * qp + bg_q AS q FROM f1),
s AS (SELECT clip, arm, q AS q0, ln(rate) AS r0, lead(q) OVER w AS q1, ln(lead(rate) OVER w) AS r1 FROM c WINDOW w AS (PARTITION BY clip, arm ORDER BY q, rate))
SELECT clip, arm, round(min(exp(r0 + (0.22 - q0) / (q1 - q0) * (r1 - r0))), 4) AS rate FROM s WHERE q0 <= 0.22 AND q1 >= 0.22 AND q1 > q0 GROUP BY 1, 2""")
def p28_rate_at_quality(spark, sf_dir):
    return curves.rate_at(_curves(spark, sf_dir), ["clip", "arm"], "rate", "q", 0.22).withColumn("rate", F.round("rate", 4))


@query(f"""WITH {F1}, c AS (SELECT clip, arm, rate >= lag(rate) OVER w OR bg_q <= lag(bg_q) OVER w AS bad FROM f1 WINDOW w AS (PARTITION BY clip, arm ORDER BY qp)) SELECT clip, arm, count(*) AS rungs, count(*) FILTER (bad) AS bad FROM c GROUP BY 1, 2""")
def q13_monotonic_ladders(spark, sf_dir):
    return curves.monotonic(runs(spark, sf_dir), ["clip", "arm"], "qp", "rate", "bg_q")


RANKED = "rank() OVER (PARTITION BY arm ORDER BY {0}) + (count(*) OVER (PARTITION BY arm, {0}) - 1) / 2.0"


@query(f"WITH {F1}, r AS (SELECT arm, {RANKED.format('rate')} AS x, {RANKED.format('bg_q')} AS y FROM f1) SELECT arm, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY arm")
def t9_spearman(spark, sf_dir):
    return stats.spearman(runs(spark, sf_dir), ["arm"], "rate", "bg_q").withColumn("rho", F.round("rho", 6))


DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS UBIGINT)"


@query(f"""WITH {F1}, n AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY clip || '|' || qp) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n, bg_q AS v FROM f1),
d AS (SELECT arm, rep, CAST({DRAW.format("'b|' || arm || '|' || rep || '|' || i")} % n AS BIGINT) AS i FROM n, range(200) t(rep)),
m AS (SELECT arm, rep, avg(v) AS m FROM d JOIN n USING (arm, i) GROUP BY 1, 2), s AS (SELECT arm, list_sort(list(m)) AS l FROM m GROUP BY arm) SELECT arm, round(l[6], 6) AS lo, round(l[196], 6) AS hi FROM s""")
def t6_bootstrap_mean(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("_key", F.concat_ws("|", "clip", "qp"))
    return stats.bootstrap(r, ["arm"], "_key", "bg_q").select("arm", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"""WITH {F1}, b AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY clip || '|' || qp) AS i, {RANKED.format('rate')} AS x, {RANKED.format('bg_q')} AS y FROM f1),
o AS (SELECT arm, corr(x, y) AS rho FROM b GROUP BY arm),
m AS (SELECT arm, rep, x, row_number() OVER (PARTITION BY arm, rep ORDER BY {DRAW.format("'p|' || arm || '|' || rep || '|' || i")}, i) AS i FROM b, range(1, 201) t(rep)),
r AS (SELECT m.arm, rep, corr(m.x, b.y) AS r FROM m JOIN b USING (arm, i) GROUP BY 1, 2)
SELECT arm, round(any_value(rho), 6) AS rho, round((count(*) FILTER (abs(r) >= abs(rho) - 1e-12) + 1) / 201.0, 9) AS p FROM r JOIN o USING (arm) GROUP BY arm""")
def t10_permutation(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("_key", F.concat_ws("|", "clip", "qp"))
    return stats.permutation(r, ["arm"], "_key", "rate", "bg_q").select("arm", F.round("rho", 6).alias("rho"), F.round("p", 9).alias("p"))


@query()
def t3_wilcoxon(spark, sf_dir):
    """Exact signed-rank p for each clip's rungs; tests hold it against enumeration."""
    return stats.wilcoxon(clip_deltas(spark, sf_dir), ["metric", "clip"]).select("metric", "clip", "n", "w_plus", F.round("p_exact", 9).alias("p_exact"), F.round("z", 6).alias("z"))


@query(f"""WITH {F3}, a AS (SELECT frame, v, "by", bx, unnest(range((CAST("by" AS BIGINT) * 20) // 64, (least(CAST("by" AS BIGINT) * 20 + 20, 230) - 1) // 64 + 1)) AS sy FROM f3 WHERE "by" * 20 < 230),
b AS (SELECT *, unnest(range((CAST(bx AS BIGINT) * 20) // 64, (least(CAST(bx AS BIGINT) * 20 + 20, 200) - 1) // 64 + 1)) AS sx FROM a),
c AS (SELECT frame, sy, sx, v, (least("by" * 20 + 20, (sy + 1) * 64, 230) - greatest("by" * 20, sy * 64)) * (least(bx * 20 + 20, (sx + 1) * 64, 200) - greatest(bx * 20, sx * 64)) AS w FROM b)
SELECT frame, CAST(sy AS INT) AS sy, CAST(sx AS INT) AS sx, round(sum(w * v) / sum(w), 4) AS v FROM c GROUP BY 1, 2, 3""")
def a33_superblocks(spark, sf_dir):
    return grid.pool(blocks(spark, sf_dir), ["frame"], "v", 20, 64, 230, 200).withColumn("v", F.round("v", 4))


@query(f"""WITH {F3} SELECT frame, "by", bx, round(coalesce(0.7 * v + 0.3 * lead(w) OVER (PARTITION BY "by", bx ORDER BY frame), v), 6) AS score FROM f3""")
def w4_next_frame_blend(spark, sf_dir):
    return grid.blend_next(blocks(spark, sf_dir), ["by", "bx"], "frame", "v", "w", 0.7).select("frame", "by", "bx", F.round("score", 6).alias("score"))


@query(f"""WITH {F3} SELECT frame, "by", bx, row_number() OVER (PARTITION BY frame ORDER BY v DESC, "by", bx) <= floor(0.25 * count(*) OVER (PARTITION BY frame)) AS selected FROM f3""")
def l1_top_blocks(spark, sf_dir):
    return grid.select_top(blocks(spark, sf_dir), ["frame"], "v", ["by", "bx"], 0.25).select("frame", "by", "bx", "selected")


@query(f"""WITH {F3} SELECT a.frame, a."by", a.bx, a.fg, a.fg = 1 AND bool_or(coalesce(b.fg = 0, false)) AS seam FROM f3 a LEFT JOIN f3 b ON a.frame = b.frame AND abs(a."by" - b."by") + abs(a.bx - b.bx) = 1 GROUP BY 1, 2, 3, 4""")
def k8_seams(spark, sf_dir):
    return grid.seams(blocks(spark, sf_dir).select("frame", "by", "bx", "fg"), ["frame"], "fg")


@query(f"""WITH {F3} SELECT a.frame, a."by", a.bx, max(b.fg) AS v FROM f3 a JOIN f3 b ON a.frame = b.frame AND abs(a."by" - b."by") <= 1 AND abs(a.bx - b.bx) <= 1 GROUP BY 1, 2, 3""")
def k5_dilate(spark, sf_dir):
    b = blocks(spark, sf_dir).select("frame", "by", "bx", F.col("fg").alias("v"))
    return grid.dilate(b, ["frame"], [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)])


@query(f"""WITH {F3}, m AS (SELECT *, CASE WHEN fg = 0 OR row_number() OVER (PARTITION BY "by", bx ORDER BY frame) = 1 THEN v END AS k FROM f3) SELECT frame, "by", bx, last_value(k IGNORE NULLS) OVER (PARTITION BY "by", bx ORDER BY frame) AS held FROM m""")
def k13_freeze(spark, sf_dir):
    return grid.hold_last(blocks(spark, sf_dir).withColumn("sel", F.col("fg") == 1), ["by", "bx"], "frame", "v", "sel").select("frame", "by", "bx", "held")


@query(f"WITH {F3} SELECT frame, round(avg(CASE WHEN fg = 1 THEN v END), 3) AS fg, round(avg(CASE WHEN fg = 0 THEN v END), 3) AS bg, round(avg(v), 3) AS overall, round(10 * log10(65025.0 / greatest(avg(w), 1e-12)), 6) AS psnr FROM f3 GROUP BY 1")
def a30_region_error(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("frame").agg(*[F.round(F.avg(e), 3).alias(n) for n, e in (("fg", F.when(F.col("fg") == 1, F.col("v"))), ("bg", F.when(F.col("fg") == 0, F.col("v"))), ("overall", F.col("v")))], F.round(scalar.psnr(F.avg("w")), 6).alias("psnr"))


@query("SELECT event_id, '' AS region, 'k' AS metric, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, 'overall', 'value', value FROM events WHERE value IS NOT NULL")
def p1_metric_rows(spark, sf_dir):
    e = spread(load(spark, sf_dir, "events"))
    raw = F.concat(F.lit('{"metrics":{"overall":{"value":'), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit("},"), F.expr("substring(props, 2)"), F.lit("}"))
    return store.metric_rows(store.parsed(e.select("event_id", raw.alias("doc_raw")))[0], "event_id")


@query("SELECT user_id, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def s6_keep_latest(spark, sf_dir):
    return store.keep_latest(load(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(max(CASE WHEN value > 50 THEN value END), 6) AS high FROM events GROUP BY 1")
def a1_coverage(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.max(F.when(F.col("value") > 50, F.col("value"))), 6).alias("high"))


@query("""WITH p AS (SELECT p_brand, p_type, p_size FROM part), g AS (SELECT p_brand, p_type, count(DISTINCT p_size) AS settings, min(p_size) AS least, max(p_size) AS most FROM p GROUP BY 1, 2) SELECT * FROM g WHERE settings >= 2""")
def g1_parameter_sweeps(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count_distinct("p_size").alias("settings"), F.min("p_size").alias("least"), F.max("p_size").alias("most")).where("settings >= 2")


@query("""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) SELECT a.label AS a, b.label AS b, round(sum((a.m - b.m) ** 2), 6) AS mean_term FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def t31_mean_term(spark, sf_dir):
    return vectors.mean_distance(load(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean_term", F.round("mean_term", 6))


@query("""SELECT n_nationkey, n_name, round(avg(c_acctbal), 6) AS mean, round((avg(c_acctbal) - avg(avg(c_acctbal)) OVER ()) / nullif(stddev_pop(avg(c_acctbal)) OVER (), 0), 6) AS z FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def p20_z_score(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    m = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).join(n, F.col("c_nationkey") == n.n_nationkey)
    s = m.agg(F.avg("m").alias("_a"), F.stddev_pop("m").alias("_s"))
    return m.join(F.broadcast(s)).select("n_nationkey", "n_name", F.round("m", 6).alias("mean"), F.round((F.col("m") - F.col("_a")) / F.nullif(F.col("_s"), F.lit(0.0)), 6).alias("z"))  # s is one row


from tarn.plans import decisions, documents, fields, files, measures, products, reports, stencils, studies, verdicts  # noqa: E402, F401 - they register their queries here
