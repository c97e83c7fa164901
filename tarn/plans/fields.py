"""Queries of block fields: foreground flags, removability, superblocks, damage, oracles, sweeps, histograms, vectors of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import frontier, grid, pairing, ranks, stats, summaries, vectors
from tarn.plans.catalog import F1, F3, blocks, load, query, runs


@query(f"""WITH {F3}, i AS (SELECT unnest(range(20)) AS i), j AS (SELECT unnest(range(12)) AS j)
SELECT frame, CAST(i // 4 AS INT) AS "by", CAST(j // 4 AS INT) AS bx, avg(CAST(fg AS DOUBLE)) > 0.5 AS foreground FROM i, j, f3 WHERE f3."by" = i * 12 // 20 AND f3.bx = j * 10 // 12 GROUP BY 1, 2, 3""")
def k1_foreground_coverage(spark, sf_dir):
    return grid.block_coverage(blocks(spark, sf_dir), ["frame"], "fg", (12, 10), (5, 3), 4, 0.5)


@query(f"""WITH {F3}, i AS (SELECT unnest(range(5)) AS i), j AS (SELECT unnest(range(4)) AS j) SELECT frame, CAST(i AS INT) AS "by", CAST(j AS INT) AS bx, fg FROM i, j, f3 WHERE f3."by" = i * 12 // 5 AND f3.bx = j * 10 // 4""")
def k2_foreground_sample(spark, sf_dir):
    return grid.nearest_sample(blocks(spark, sf_dir), ["frame"], "fg", (12, 10), (5, 4))


@query(f"""WITH {F3}, a AS (SELECT *, CASE WHEN lead(w) OVER p IS NULL THEN v / 100000 ELSE 0.7 * v / 100000 + 0.3 * lead(w) OVER p END AS s FROM f3 WINDOW p AS (PARTITION BY "by", bx ORDER BY frame)),
b AS (SELECT *, CASE WHEN fg = 0 THEN s * 10.0 ELSE s END AS s10 FROM a), c AS (SELECT *, coalesce(0.6 * s10 + 0.4 * lag(s10) OVER (PARTITION BY "by", bx ORDER BY frame), s10) AS x FROM b)
SELECT frame, "by", bx, round((x - (SELECT min(x) FROM c)) / (SELECT max(x) - min(x) FROM c), 6) AS score FROM c""")
def k3_removability(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("spatial", F.col("v") / 100000)
    return grid.removability(b, ["by", "bx"], "frame", "spatial", "w", "fg", 0.7, 0.6).select("frame", "by", "bx", F.round("score", 6).alias("score"))


@query("""SELECT l_linenumber AS frame, CAST(l_partkey % 12 AS INT) AS "by", CAST(l_suppkey % 10 AS INT) AS bx, CAST(max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS INT) AS mask FROM lineitem GROUP BY 1, 2, 3""")
def k11_mask_union(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 12).cast("int").alias("by"), (F.col("l_suppkey") % 10).cast("int").alias("bx"), F.when(F.col("l_quantity") > 45, F.col("l_orderkey") + 1).otherwise(0).alias("instance"))
    return grid.mask_union(li, ["frame", "by", "bx"], "instance")


@query(f"""WITH {F3} SELECT f.frame, f."by", f.bx, min(n.fg) AS v FROM f3 f JOIN f3 n ON f.frame = n.frame AND ((abs(n."by" - f."by") <= 1 AND n.bx = f.bx) OR (n."by" = f."by" AND abs(n.bx - f.bx) <= 1)) GROUP BY 1, 2, 3""")
def k5_erode(spark, sf_dir):
    """The smallest value under an ellipse of radius 1; what lies outside does not count."""
    b = blocks(spark, sf_dir).withColumn("v", F.col("fg"))
    return grid.erode(b, ["frame"], grid.ellipse(1))


@query(f"""WITH {F3}, o AS (SELECT frame, (('0x' || substr(md5('shift|' || frame || '|y'), 1, 6))::BIGINT % 5)::INT - 2 AS dy, (('0x' || substr(md5('shift|' || frame || '|x'), 1, 6))::BIGINT % 5)::INT - 2 AS dx FROM f3 GROUP BY 1)
SELECT f.frame, f."by" + dy AS "by", f.bx + dx AS bx, fg FROM f3 f JOIN o USING (frame) WHERE f."by" + dy BETWEEN 0 AND 11 AND f.bx + dx BETWEEN 0 AND 9""")
def k5_seeded_shift(spark, sf_dir):
    """Masks moved by a step drawn for each frame; what leaves the frame is lost."""
    return grid.seeded_shift(blocks(spark, sf_dir), "frame", 2, 12, 10, "shift").select("frame", "by", "bx", "fg")


@query(f"""WITH {F3} SELECT frame, CAST("by" // 4 AS INT) AS sy, CAST(bx // 4 AS INT) AS sx, round(avg((v / 1000 - w * 1000) ** 2), 4) AS mse, count(*) AS n FROM f3 GROUP BY 1, 2, 3""")
def a32_superblock_error(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("d", (F.col("v") / 1000 - F.col("w") * 1000) ** 2)
    return grid.superblocks(b, ["frame"], 4).agg(F.round(F.avg("d"), 4).alias("mse"), F.count("*").alias("n"))


@query(f"""WITH {F3} SELECT frame, round(avg(w), 9) AS motion, round(avg(w) FILTER (fg = 1), 9) AS fg_motion, round(avg(w) FILTER (fg = 0), 9) AS bg_motion, round(avg(v) FILTER (fg = 0), 4) AS bg_texture, round(avg(CAST(fg AS DOUBLE)), 9) AS fg_fraction FROM f3 GROUP BY 1""")
def a42_content_attributes(spark, sf_dir):
    a = grid.content_attributes(blocks(spark, sf_dir), ["frame"], "v", "w", "fg")
    return a.select("frame", *[F.round(c, 9).alias(c) for c in ("motion", "fg_motion", "bg_motion", "fg_fraction")], F.round("bg_texture", 4).alias("bg_texture"))


_DAMAGE = """d AS (SELECT l_linenumber AS frame, CAST(l_partkey % 14 AS INT) AS "by", CAST(l_suppkey % 10 AS INT) AS bx, round(avg(l_tax), 9) AS damage FROM lineitem GROUP BY 1, 2, 3)"""


@query(f"""WITH {F3}, {_DAMAGE} SELECT frame, count(*) AS n, round(corr(f.v, d.damage), 6) AS r, round(avg(d.damage), 6) AS damage FROM f3 f JOIN d USING (frame, "by", bx) WHERE f.fg = 1 GROUP BY 1 HAVING count(*) >= 30""")
def j24_score_and_damage(spark, sf_dir):
    """Scores, strengths and damage of the same places; damage outside of the score's grid and blocks that were not degraded are left out."""
    damage = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 14).cast("int").alias("by"), (F.col("l_suppkey") % 10).cast("int").alias("bx")).agg(F.round(F.avg("l_tax"), 9).alias("damage"))
    both = grid.on_places(blocks(spark, sf_dir), damage, ["frame", "by", "bx"]).where("fg = 1")
    return both.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.corr("v", "damage"), 6).alias("r"), F.round(F.avg("damage"), 6).alias("damage")).where("n >= 30")


_ARMS = """g AS (SELECT l_returnflag AS arm, l_linenumber AS frame, CAST(l_partkey % 6 AS INT) AS "by", CAST(l_suppkey % 5 AS INT) AS bx, round(avg(l_extendedprice), 6) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
p AS (SELECT arm, frame, CAST("by" // 2 AS INT) AS sy, CAST(bx // 2 AS INT) AS sx, avg(v) AS v FROM g GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_ARMS}, d AS (SELECT r.frame, r.v - a.v AS damage FROM p r JOIN p a ON r.frame = a.frame AND r.sy = a.sy AND r.sx = a.sx AND a.arm = 'A' WHERE r.arm = 'R')
SELECT frame, count(*) AS n, round(quantile_cont(damage, 0.1), 4) AS p10, round(quantile_cont(damage, 0.5), 4) AS p50, round(quantile_cont(damage, 0.9), 4) AS p90 FROM d GROUP BY 1""")
def m5_block_damage(spark, sf_dir):
    """Superblock damage of an arm against the baseline on their common frames, and its spread in each frame."""
    li = load(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 6).cast("int").alias("by"), (F.col("l_suppkey") % 5).cast("int").alias("bx")).agg(F.round(F.avg("l_extendedprice"), 6).alias("v"))
    damage = grid.block_damage(g, "arm", "R", "A", ["frame"], "v", 2)
    q = F.percentile("damage", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return damage.groupBy("frame").agg(F.count("*").alias("n"), q.alias("q")).select("frame", "n", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


@query(f"""WITH {F3}, k AS (SELECT frame, v, w, row_number() OVER (PARTITION BY frame ORDER BY w DESC, "by", bx) AS kw, row_number() OVER (PARTITION BY frame ORDER BY v DESC, "by", bx) AS kv, count(*) OVER (PARTITION BY frame) AS n,
rank() OVER (PARTITION BY frame ORDER BY v) + (count(*) OVER (PARTITION BY frame, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY frame ORDER BY w) + (count(*) OVER (PARTITION BY frame, w) - 1) / 2.0 AS rw FROM f3)
SELECT frame, round(corr(rv, rw), 6) AS rho, round(sum(v) FILTER (kw <= floor(0.3 * n)) / sum(v) FILTER (kv <= floor(0.3 * n)), 6) AS capture, round(0.3 * sum(v) / sum(v) FILTER (kv <= floor(0.3 * n)), 6) AS by_chance FROM k GROUP BY 1""")
def m6_bit_oracle(spark, sf_dir):
    """How well a score finds the blocks that cost most bits: its rank correlation, and its share of what the oracle's choice saves."""
    b = blocks(spark, sf_dir)
    rho = stats.spearman(b, ["frame"], "w", "v").select("frame", F.round("rho", 6).alias("rho"))
    return rho.join(grid.oracle_capture(b, ["frame"], "w", "v", ["by", "bx"], 0.3), "frame").select("frame", "rho", F.round("capture", 6).alias("capture"), F.round("by_chance", 6).alias("by_chance"))


@query(f"""WITH {F3}, r AS (SELECT unnest(range(40)) AS rep), k AS (SELECT frame, rep, v, row_number() OVER (PARTITION BY frame, rep ORDER BY md5('null|' || frame || '|' || "by" || '|' || bx || '|' || rep)) AS i, row_number() OVER (PARTITION BY frame, rep ORDER BY v DESC, "by", bx) AS o, count(*) OVER (PARTITION BY frame, rep) AS n FROM f3, r),
c AS (SELECT frame, rep, sum(v) FILTER (i <= floor(0.3 * n)) / sum(v) FILTER (o <= floor(0.3 * n)) AS capture FROM k GROUP BY 1, 2) SELECT frame, round(avg(capture), 6) AS mean, round(min(capture), 6) AS least, round(max(capture), 6) AS most FROM c GROUP BY 1""")
def t29_drawn_null(spark, sf_dir):
    """Capture of random choices of the same size, each drawn without replacement."""
    c = grid.random_capture(blocks(spark, sf_dir), ["frame"], "v", ["by", "bx"], 0.3, 40, "null")
    return c.groupBy("frame").agg(*[F.round(f("capture"), 6).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])


@query(f"""WITH {F3}, k AS (SELECT frame, "by", bx, row_number() OVER (PARTITION BY frame ORDER BY v DESC, "by", bx) AS i FROM f3 WHERE fg = 0) SELECT frame, "by", bx FROM k WHERE i <= CAST(floor(0.25 * 10) AS INT) * 12""")
def l1_budget_by_columns(spark, sf_dir):
    """int(amount * columns) * rows blocks of each frame, the excluded ones never among them."""
    return grid.select_budget(blocks(spark, sf_dir), ["frame"], "v", ["by", "bx"], 0.25, 12, 10, F.col("fg") == 1).select("frame", "by", "bx")


@query("""WITH c AS (SELECT p_partkey, 'brand' AS k, p_brand AS v, '{"size":"' || p_size || '","type":"' || p_type || '"}' AS rest FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), '{"brand":"' || p_brand || '","type":"' || p_type || '"}' FROM part UNION ALL SELECT p_partkey, 'type', p_type, '{"brand":"' || p_brand || '","size":"' || p_size || '"}' FROM part)
SELECT k AS key, rest, count(DISTINCT v) AS settings, count(*) AS runs FROM c GROUP BY 1, 2 HAVING count(DISTINCT v) > 1""")
def g1_single_key_sweeps(spark, sf_dir):
    """For every key of the configs: runs that agree in all others and differ in it."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type")).alias("config"))
    return summaries.single_key_sweeps(p, "config")


@query(f"WITH {F1}, b AS (SELECT clip, qp, rate AS base FROM f1 WHERE arm = 'A') SELECT arm, CAST(floor((rate - base) / base / 0.05) AS BIGINT) AS bin, count(*) AS n FROM f1 JOIN b USING (clip, qp) WHERE arm <> 'A' GROUP BY 1, 2")
def a26_offsets_from_baseline(spark, sf_dir):
    s = pairing.star(runs(spark, sf_dir), ["clip", "qp"], "arm", "A", ["rate"])
    return summaries.fixed_bins(s, ["arm"], (F.col("rate") - F.col("base_rate")) / F.col("base_rate"), 0.05)


@query(f"WITH {F1}, r AS (SELECT clip, qp, arm, lead(bg_q) OVER w - bg_q AS margin, row_number() OVER w AS rn FROM f1 WINDOW w AS (PARTITION BY clip, qp ORDER BY bg_q, arm)) SELECT clip, qp, arm AS winner, CASE WHEN margin >= 0.008 - 1e-9 THEN 'robust' WHEN margin >= 0.001 - 1e-9 THEN 'tight_only' ELSE 'never' END AS class, CAST(margin >= 0.001 - 1e-9 AS BIGINT) + CAST(margin >= 0.003 - 1e-9 AS BIGINT) + CAST(margin >= 0.005 - 1e-9 AS BIGINT) + CAST(margin >= 0.008 - 1e-9 AS BIGINT) AS held FROM r WHERE rn = 1 AND margin IS NOT NULL")
def t22_threshold_classes(spark, sf_dir):
    """A cell's winner is named at all thresholds, at the least but not at the largest, or at none; and at how many of them."""
    return frontier.threshold_classes(runs(spark, sf_dir), ["clip", "qp"], "arm", "bg_q", [0.001, 0.003, 0.005, 0.008])


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), d AS (SELECT a.vec_id, a.label, round(sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS d FROM e a JOIN e b USING (label) GROUP BY 1, 2),
c AS (SELECT label, arg_min(vec_id, (d, vec_id)) AS medoid FROM d GROUP BY 1), r AS (SELECT c.label, c.medoid, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS r FROM c JOIN e a ON a.vec_id = c.medoid JOIN e b ON b.label = c.label)
SELECT label, medoid, round(max(r), 4) AS radius, count(*) AS n FROM r GROUP BY 1, 2""")
def t35_medoids(spark, sf_dir):
    """The member with the least sum of distances to its label's vectors, and the distance of its farthest member."""
    return vectors.medoids(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("radius", F.round("radius", 4))


@query(None)
def t31_frechet(spark, sf_dir):
    """Both terms of the distance of each two labels over all vectors."""
    return vectors.frechet_pairs(load(spark, sf_dir, "embeddings"), "label", "embedding")


@query(None)
def t32_set_frechet(spark, sf_dir):
    """Distance of pooled sets of sources from the pooled reference, each vector counted once in it."""
    e = load(spark, sf_dir, "embeddings")
    sets = e.select("vec_id", "embedding", F.explode(F.array(F.lit("reference"), F.concat(F.lit("set "), (F.col("label") % 3).cast("string")))).alias("set"))
    return vectors.frechet_pairs(sets.dropDuplicates(["set", "vec_id"]), "set", "embedding").where("a = 'reference' OR b = 'reference'")


@query(None)
def t34_noise_ladder(spark, sf_dir):
    """Vectors with drawn noise of 1, 5 and 20 percent: the distance from the clean ones must rise with the noise."""
    return vectors.noise_ladder(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", [0.01, 0.05, 0.2])


@query("SELECT p_name AS name, CASE WHEN p_size % 3 = 0 THEN (p_size * 16) || 'x' || (p_size * 9) ELSE 'unknown' END AS resolution, count(*) AS runs, round(median(CASE WHEN p_size % 7 > 0 THEN p_retailprice / (p_size % 7) END), 6) AS fps FROM part GROUP BY 1, 2")
def m7_grid_report(spark, sf_dir):
    """Runs by clip and resolution with their median throughput."""
    s = F.col("p_size")
    table = load(spark, sf_dir, "part").select(scalar.clip_name(F.concat("p_brand", F.lit("/"), "p_name", F.lit(".mp4"))).alias("name"), scalar.resolution_label((F.when(s % 3 == 0, s * 16), F.when(s % 3 == 0, s * 9))).alias("resolution"), scalar.throughput(F.col("p_retailprice"), (s % 7).cast("double")).alias("fps"))
    by = table.groupBy("name", "resolution").agg(F.count("*").alias("runs"))
    return ranks.same(by, ranks.medians(table, ["name", "resolution"], {"fps": "fps"}), ["name", "resolution"], "left").withColumn("fps", F.round("fps", 6))
