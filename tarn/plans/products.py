"""Whole products: operating maps, errors over frames, content attributes from all sources, composites of two tables, normalised values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import frontier, grid, pairing, summaries
from tarn.plans.catalog import F3, blocks, load, query
from tarn.plans.decisions import F9, runs9

MAP = f"""WITH {F9}, a AS (SELECT x.*, x.rate < b.rate AND x.fg_q - b.fg_q >= -1.5 AS ok FROM f9 x JOIN f9 b ON x.clip = b.clip AND x.qp = b.qp AND b.arm = 'A0' WHERE x.arm <> 'A0'),
o AS (SELECT clip, qp, arm, ok, unnest(['quality', 'bits']) AS objective, unnest([bg_q, rate]) AS score, unnest([0.002, 20.0]) AS t FROM a),
c AS (SELECT objective, clip, qp, count(*) FILTER (ok) AS n_eligible FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w - score AS margin FROM o WHERE ok WINDOW w AS (PARTITION BY objective, clip, qp ORDER BY score, arm)),
v AS (SELECT c.*, r.arm AS leader, CASE WHEN n_eligible = 0 THEN 'no_eligible_arm' WHEN n_eligible = 1 THEN 'single_eligible_arm' WHEN margin >= t - 1e-9 THEN 'separable' ELSE 'tie_within_threshold' END AS verdict FROM c LEFT JOIN r ON r.objective = c.objective AND r.clip = c.clip AND r.qp = c.qp AND r.k = 1),
d AS (SELECT *, CASE WHEN verdict IN ('separable', 'single_eligible_arm') THEN leader END AS winner FROM v)"""


def _map(spark, sf_dir):
    s = pairing.star(runs9(spark, sf_dir), ["clip", "qp"], "arm", "A0", ["rate", "fg_q"])
    ok = (F.col("rate") < F.col("base_rate")) & (F.col("fg_q") - F.col("base_fg_q") >= -1.5)
    return frontier.operating_map(s, ["clip", "qp"], "arm", ok, {"quality": ("bg_q", 0.002), "bits": ("rate", 20.0)})


@query(f"{MAP} SELECT objective, count(*) AS cells, count(*) FILTER (n_eligible > 1) AS contested, count(*) FILTER (verdict = 'separable') AS separable, count(*) FILTER (verdict = 'tie_within_threshold') AS ties, count(*) FILTER (verdict = 'single_eligible_arm') AS single, count(*) FILTER (verdict = 'no_eligible_arm') AS none, count(DISTINCT CASE WHEN verdict = 'separable' THEN winner END) AS winners, round(100.0 * count(*) FILTER (verdict = 'separable') / nullif(count(*) FILTER (n_eligible > 1), 0), 6) AS separable_pct FROM d GROUP BY 1")
def m2_map_summary(spark, sf_dir):
    """The operating map under two objectives: how many cells each lets name a winner."""
    return frontier.map_summary(_map(spark, sf_dir)).withColumn("separable_pct", F.round("separable_pct", 6))


@query(f"{MAP} SELECT clip, qp, a.leader AS leader_a, b.leader AS leader_b, a.winner AS winner_a, b.winner AS winner_b, CASE WHEN a.winner IS NULL OR b.winner IS NULL THEN 'undecided' WHEN a.winner = b.winner THEN 'same' ELSE 'different' END AS agreement FROM (SELECT * FROM d WHERE objective = 'quality') a JOIN (SELECT * FROM d WHERE objective = 'bits') b USING (clip, qp)")
def j19_side_by_side(spark, sf_dir):
    """Leaders of each cell under quality and under bits."""
    return frontier.side_by_side(_map(spark, sf_dir), ["clip", "qp"], "quality", "bits")


@query(f"""WITH {F3}, e AS (SELECT "by" % 3 AS clip, frame, unnest(['fg', 'bg', 'overall']) AS region, unnest([CASE WHEN fg = 1 THEN w END, CASE WHEN fg = 0 THEN w END, w]) AS e FROM f3), m AS (SELECT clip, region, frame, avg(e) AS m FROM e WHERE e IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT *, 10 * log10(65025 / greatest(m, 1e-12)) AS p FROM m)
SELECT clip, region, count(*) AS frames, round(avg(m), 9) AS mse_mean, round(stddev_pop(m), 9) AS mse_sd, round(avg(p), 6) AS psnr_mean, round(stddev_pop(p), 6) AS psnr_sd FROM p GROUP BY 1, 2""")
def a30_errors_over_frames(spark, sf_dir):
    """Error and dB of each region, mean and deviation over frames."""
    e = grid.region_errors(blocks(spark, sf_dir).withColumn("clip", F.col("by") % 3), ["clip"], "frame", "w", "fg")
    return e.select("clip", "region", "frames", *[F.round(f"mse_{x}", 9).alias(f"mse_{x}") for x in ("mean", "sd")], *[F.round(f"psnr_{x}", 6).alias(f"psnr_{x}") for x in ("mean", "sd")])


@query("""WITH b AS (SELECT CAST(l_suppkey % 40 AS INT) AS clip, l_discount AS tc, l_extendedprice AS sc, CASE WHEN l_suppkey % 40 <> 7 THEN CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END END AS fg FROM lineitem WHERE l_suppkey % 40 < 30),
x AS (SELECT clip, avg(tc) AS a1, avg(tc) FILTER (fg = 1) AS a2, avg(sc) FILTER (fg = 0) AS a3, avg(tc) FILTER (fg = 0) AS a5, avg(CAST(fg AS DOUBLE)) AS a7 FROM b GROUP BY 1), y AS (SELECT CAST(c_custkey % 35 AS INT) AS clip, avg(c_acctbal) AS a4 FROM customer GROUP BY 1),
z AS (SELECT CAST(p_partkey % 40 AS INT) AS clip, CAST(max(p_size) AS DOUBLE) AS a6 FROM part WHERE p_size > 0 GROUP BY 1)
SELECT clip, round(a1, 9) AS A1_motion, round(a2, 9) AS A2_hole_instability, round(a3, 4) AS A3_bg_texture, round(a4, 6) AS A4_residual_info, round(a5, 9) AS A5_bg_motion, a6 AS A6_duration, round(a7, 9) AS A7_fg_fraction FROM x FULL JOIN y USING (clip) FULL JOIN z USING (clip)""")
def a42_seven_attributes(spark, sf_dir):
    """Content attributes of clips from blocks, frame log and runs; each source knows some clips only."""
    li, c, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "customer"), load(spark, sf_dir, "part")
    clip = (F.col("l_suppkey") % 40).cast("int")
    b = li.where(clip < 30).select(clip.alias("clip"), F.col("l_discount").alias("tc"), F.col("l_extendedprice").alias("sc"), F.when(clip != 7, (F.col("l_tax") > 0.04).cast("int")).alias("fg"))
    log = c.select((F.col("c_custkey") % 35).cast("int").alias("clip"), F.col("c_acctbal").alias("info"))
    r = p.select((F.col("p_partkey") % 40).cast("int").alias("clip"), F.col("p_size").alias("frames"))
    a = grid.clip_attributes(b, log, r, "clip", "sc", "tc", "fg", "info", "frames")
    return a.select("clip", *[F.round(n, d).alias(n) for n, d in (("A1_motion", 9), ("A2_hole_instability", 9), ("A3_bg_texture", 4), ("A4_residual_info", 6), ("A5_bg_motion", 9))], "A6_duration", F.round("A7_fg_fraction", 9).alias("A7_fg_fraction"))


@query(f"""WITH {F3}, g AS (SELECT l_linenumber AS frame, CAST(l_partkey % 12 AS INT) AS "by", CAST(l_suppkey % 10 AS INT) AS bx, round(avg(l_quantity), 6) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
SELECT f3.frame, f3."by", f3.bx, CASE WHEN fg = 1 AND f3.frame < 6 AND g.v IS NOT NULL THEN g.v ELSE f3.v END AS v FROM f3 LEFT JOIN g USING (frame, "by", bx)""")
def k7_composite(spark, sf_dir):
    """Generated values of one table set into the transmitted ones of another, by a third that has no rows for some frames."""
    b = blocks(spark, sf_dir)
    g = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 12).cast("int").alias("by"), (F.col("l_suppkey") % 10).cast("int").alias("bx")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    place = ["frame", "by", "bx"]
    return grid.composite(g, b.select(*place, "v"), b.where("frame < 6").select(*place, "fg"), place, "v", "fg")


@query("""WITH s AS (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer GROUP BY 1)
SELECT c_custkey, round(coalesce((c_acctbal - lo) / nullif(hi - lo, 0), 0), 6) AS unit, round(CASE WHEN hi = lo THEN 0 ELSE coalesce((c_acctbal - m) / nullif(s, 0), 0) END, 6) AS z FROM customer JOIN s USING (c_nationkey)""")
def p20_normalised(spark, sf_dir):
    """Min-max and z of each balance inside its nation."""
    return summaries.normalised(load(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal").select("c_custkey", F.round("unit", 6).alias("unit"), F.round("z", 6).alias("z"))
