"""Queries of decided cells, linked baselines, rate-damage ladders, dominance with missing axes, clusters and validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import clusters, frontier, pairing, summaries, vectors
from tarn.plans.catalog import F1, load, query, runs

#: Runs of nine arms for each clip and rung; the time axis is unknown for some.
F9 = """f9 AS (SELECT p_brand AS clip, l_returnflag || (l_suppkey % 3) AS arm, l_linenumber AS qp, round(sum(l_extendedprice) / 1000.0, 6) AS rate, round(avg(l_discount), 9) AS bg_q, round(avg(l_quantity), 6) AS fg_q,
  CASE WHEN (l_linenumber + l_suppkey % 3) % 3 > 0 THEN round(count(*) / sum(l_quantity), 9) END AS fps FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag, l_suppkey % 3, l_linenumber)"""


def runs9(spark, sf_dir):
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    by = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("clip"), F.concat("l_returnflag", (F.col("l_suppkey") % 3).cast("string")).alias("arm"), F.col("l_linenumber").alias("qp")).agg(
        F.round(F.sum("l_extendedprice") / 1000.0, 6).alias("rate"), F.round(F.avg("l_discount"), 9).alias("bg_q"), F.round(F.avg("l_quantity"), 6).alias("fg_q"), F.round(F.count("*") / F.sum("l_quantity"), 9).alias("_fps"),
    )
    return by.withColumn("fps", F.when((F.col("qp") + F.substring("arm", 2, 1).cast("int")) % 3 > 0, F.col("_fps"))).drop("_fps")


@query(f"""WITH {F9} SELECT a.clip, a.qp, a.arm FROM f9 a WHERE NOT EXISTS (SELECT 1 FROM f9 b WHERE a.clip = b.clip AND a.qp = b.qp AND b.rate <= a.rate AND b.bg_q <= a.bg_q AND (a.fps IS NULL OR b.fps IS NULL OR b.fps >= a.fps)
AND (b.rate < a.rate OR b.bg_q < a.bg_q OR coalesce(b.fps > a.fps, false)))""")
def j18_missing_axes(spark, sf_dir):
    """The front on rate, quality and speed, where speed is not known for all: such an arm is compared on the other two axes."""
    return frontier.undominated(runs9(spark, sf_dir), ["clip", "qp"], "arm", ["rate", "bg_q"], ["fps"]).select("clip", "qp", "arm")


@query(f"""WITH {F9}, a AS (SELECT x.*, x.rate < b.rate AND x.fg_q - b.fg_q >= -1.5 AS ok FROM f9 x JOIN f9 b ON x.clip = b.clip AND x.qp = b.qp AND b.arm = 'A0' WHERE x.arm <> 'A0'),
c AS (SELECT clip, qp, count(*) AS n_arms, count(*) FILTER (ok) AS n_eligible FROM a GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY clip, qp ORDER BY bg_q, arm) AS k, bg_q - first_value(bg_q) OVER (PARTITION BY clip, qp ORDER BY bg_q, arm) AS gap FROM a WHERE ok),
g AS (SELECT clip, qp, max(arm) FILTER (k = 1) AS leader, max(arm) FILTER (k = 2) AS runner_up, max(gap) FILTER (k = 2) AS margin, string_agg(arm, ',' ORDER BY k) FILTER (gap < 0.002 - 1e-9) AS near FROM r GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN n_eligible = 0 THEN 'no_eligible_arm' WHEN n_eligible = 1 THEN 'single_eligible_arm' WHEN margin >= 0.002 - 1e-9 THEN 'separable' ELSE 'tie_within_threshold' END AS verdict FROM c LEFT JOIN g USING (clip, qp))
SELECT clip, qp, n_arms, n_eligible, verdict, CASE WHEN verdict IN ('separable', 'single_eligible_arm') THEN leader END AS winner, leader, runner_up, round(margin, 6) AS margin, CASE WHEN verdict = 'tie_within_threshold' THEN near ELSE '' END AS tied FROM v""")
def w1_decided_cells(spark, sf_dir):
    """Cells decided among the arms that save bits and keep the foreground, with the arms that tie."""
    s = pairing.star(runs9(spark, sf_dir), ["clip", "qp"], "arm", "A0", ["rate", "fg_q"])
    ok = (F.col("rate") < F.col("base_rate")) & (F.col("fg_q") - F.col("base_fg_q") >= -1.5)
    d = frontier.decided(s, ["clip", "qp"], "arm", "bg_q", 0.002, ok)
    return d.withColumn("margin", F.round("margin", 6)).withColumn("tied", F.array_join("tied", ","))


@query(f"""WITH {F9}, p AS (SELECT clip, qp, arg_min(rate, arm) AS x, arg_min(bg_q, arm) AS y FROM f9 GROUP BY 1, 2),
f AS (SELECT clip, count(*) AS points, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r2 FROM p GROUP BY 1 HAVING count(*) >= 3 AND regr_slope(y, x) < 0),
l AS (SELECT a.clip, a.qp, regr_slope(b.y, b.x) AS s FROM p a JOIN p b ON a.clip = b.clip AND a.qp <> b.qp GROUP BY 1, 2)
SELECT f9.clip, f9.qp, arm, points, round(f.s, 9) AS slope, round(r2, 6) AS r2, round((f.s * rate + i - bg_q) / 0.005, 4) AS residual, round(f.s - l.s, 9) AS influence FROM f9 JOIN f USING (clip) JOIN l ON l.clip = f9.clip AND l.qp = f9.qp""")
def t21_bitstream_ladders(spark, sf_dir):
    """Residuals of all fills from a line in which each bitstream (a clip's rung) votes once, and what the line owes to each."""
    found = frontier.ladders(runs9(spark, sf_dir), ["clip"], "qp", "rate", "bg_q", 0.005, ["arm"])
    return found.select("clip", "qp", "arm", "points", F.round("slope", 9).alias("slope"), F.round("r2", 6).alias("r2"), F.round("residual", 4).alias("residual"), F.round("influence", 9).alias("influence"))


LINKS = """t AS (SELECT o_orderstatus AS arm, o_custkey AS clip, CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS target, o_orderkey % 2 AS width, o_orderkey AS run, o_totalprice AS rate FROM orders)"""


def _linked(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderstatus").alias("arm"), F.col("o_custkey").alias("clip"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderpriority")).alias("target"), (F.col("o_orderkey") % 2).alias("width"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("rate"))
    return pairing.linked(t, ["clip", "target", "width"], "arm", "F", "O", ["run", "rate"], ["run"])


@query(f"""WITH {LINKS}, b AS (SELECT clip, target, width, min(run) AS base_run, arg_min(rate, run) AS base_rate FROM t WHERE arm = 'O' AND target IS NOT NULL GROUP BY 1, 2, 3)
SELECT run, base_run, round(rate - base_rate, 6) AS off FROM t JOIN b USING (clip, target, width) WHERE arm = 'F'""")
def j13_linked(spark, sf_dir):
    """Each run of an arm beside the first baseline of its clip, target and resolution."""
    return _linked(spark, sf_dir)[0].select("run", "base_run", F.round(F.col("rate") - F.col("base_rate"), 6).alias("off"))


@query(f"""WITH {LINKS}, b AS (SELECT DISTINCT clip, target, width, 1 AS has FROM t WHERE arm = 'O' AND target IS NOT NULL)
SELECT CASE WHEN target IS NULL THEN 'no_key' ELSE 'no_baseline' END AS reason, count(*) AS n FROM t LEFT JOIN b USING (clip, target, width) WHERE arm = 'F' AND has IS NULL GROUP BY 1""")
def j13_unlinked(spark, sf_dir):
    """Runs without a baseline, by reason."""
    return _linked(spark, sf_dir)[1]


@query(f"""WITH {F1}, b AS (SELECT clip, arg_max(rate, qp) AS rate, arg_max(bg_q, qp) AS bg_q FROM f1 WHERE arm = 'A' GROUP BY 1) SELECT f1.clip, f1.qp, f1.arm, round(f1.rate - b.rate, 6) AS drate, round(f1.bg_q - b.bg_q, 6) AS dq FROM f1 JOIN b USING (clip) WHERE arm <> 'A'""")
def j2_one_baseline(spark, sf_dir):
    """Of several baselines of a clip the last by rung: both values come from that run."""
    s = pairing.star(runs(spark, sf_dir), ["clip"], "arm", "A", ["rate", "bg_q"], ["qp"], last=True)
    return s.select("clip", "qp", "arm", F.round(F.col("rate") - F.col("base_rate"), 6).alias("drate"), F.round(F.col("bg_q") - F.col("base_bg_q"), 6).alias("dq"))


@query("""WITH c AS (SELECT p_partkey % 4 AS op, p_brand, p_type, p_size FROM part), s AS (SELECT op, 'size' AS key, '{"brand":"' || p_brand || '","type":"' || p_type || '"}' AS rest, CAST(p_size AS VARCHAR) AS v FROM c UNION ALL SELECT op, 'type', '{"brand":"' || p_brand || '","size":"' || p_size || '"}', p_type FROM c)
SELECT op, key, rest, count(DISTINCT v) AS settings, count(*) AS runs FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT v) > 1""")
def g1_sweeps_of_arms(spark, sf_dir):
    """Sweeps inside an operating point; the brand says which arm a run is and is never swept."""
    config = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    p = load(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("op"), config.alias("config"))
    return summaries.single_key_sweeps(p, "config", ["op"], ["brand"])


@query()
def t35_probe_clusters(spark, sf_dir):
    """Four clusters of parts by their lines' z-scored means, a probe of each and how far all parts are from one. Tests hold it against all distances."""
    li = load(spark, sf_dir, "lineitem")
    by = li.groupBy("l_partkey").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")])
    return clusters.covered(by, "l_partkey", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 4).withColumn("radius", F.round("radius", 6)).withColumn("worst", F.round("worst", 6))


def _pairs(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    # a stand-in for vectors of restored clips: each group moves its references by a share of its own
    group = F.explode(F.array(*[F.struct(F.lit(n).alias("set"), F.lit(s).alias("share")) for n, s in (("near", 0.05), ("middle", 0.2), ("far", 0.8))]))
    moved = lambda x, i: x.cast("double") + F.col("g.share") * (F.pmod(F.xxhash64("g.set", "vec_id", i), F.lit(2001)) / 1000.0 - 1.0) * 0.1
    return e.where("embedding IS NOT NULL").select("vec_id", "label", "embedding", group.alias("g")).select("vec_id", F.col("label").alias("source"), F.col("g.set").alias("set"), "embedding", F.transform("embedding", moved).alias("moved"))


@query()
def t33_validity(spark, sf_dir):
    """Scores of three groups of moved vectors, identity, halvings of the references, and each score without one source. Tests hold it against matrices."""
    v = vectors.validity(_pairs(spark, sf_dir), "set", "source", "vec_id", "embedding", "moved")
    return v.select("set", "kind", "part", "n", *[F.round(c, 6).alias(c) for c in ("mean_term", "covariance_term", "distance")])


@query()
def t33_jackknife(spark, sf_dir):
    """Whether the scores' gaps pass their spread over the sources left out."""
    s = vectors.jackknife_summary(vectors.validity(_pairs(spark, sf_dir), "set", "source", "vec_id", "embedding", "moved"), "set")
    return s.select("set", "n_sources", *[F.round(c, 6).alias(c) for c in ("score", "mean", "sd", "least", "most")], "separated")
