"""Queries of the block grids: selection, masks, stencils, regions, attributes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import curves, grid, ranks, summaries
from tarn.plans.catalog import F3, blocks, query
from tarn.sources.store import written


@query(f"""WITH {F3}, t AS (SELECT d, w FROM (VALUES (-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)) v(d, w)),
p AS (SELECT frame, "by", bx, ty.d AS dy, tx.d AS dx, ty.w * tx.w AS w, CASE WHEN "by" + ty.d < 0 THEN -("by" + ty.d) WHEN "by" + ty.d > 11 THEN 22 - "by" - ty.d ELSE "by" + ty.d END AS y, CASE WHEN bx + tx.d < 0 THEN -(bx + tx.d) WHEN bx + tx.d > 9 THEN 18 - bx - tx.d ELSE bx + tx.d END AS x FROM f3, t ty, t tx)
SELECT p.frame, p."by", p.bx, round(sum(p.w * n.v), 4) AS smooth FROM p JOIN f3 n ON p.frame = n.frame AND p.y = n."by" AND p.x = n.bx GROUP BY 1, 2, 3""")
def k4_smooth(spark, sf_dir):
    return grid.smooth(blocks(spark, sf_dir), ["frame"], "v", 12, 10).select("frame", "by", "bx", F.round("smooth", 4).alias("smooth"))


@query(f"""WITH {F3}, o AS (SELECT a.frame, a."by", a.bx, b.v, b."by" - a."by" AS dy, b.bx - a.bx AS dx FROM f3 a JOIN f3 b ON a.frame = b.frame AND abs(a."by" - b."by") <= 1 AND abs(a.bx - b.bx) <= 1)
SELECT frame, "by", bx, round(sqrt(pow(sum(dx * (2 - abs(dy)) * v), 2) + pow(sum(dy * (2 - abs(dx)) * v), 2)), 3) AS gradient FROM o GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def k10_gradient(spark, sf_dir):
    return grid.gradient(blocks(spark, sf_dir), ["frame"]).withColumn("gradient", F.round("gradient", 3))


@query(f"""WITH RECURSIVE {F3}, p AS (SELECT frame, "by" * 10 + bx AS k, "by", bx FROM f3 WHERE v > 56000), r(frame, k, s) AS (SELECT frame, k, k FROM p UNION
SELECT r.frame, b.k, r.s FROM r JOIN p a ON r.frame = a.frame AND r.k = a.k JOIN p b ON a.frame = b.frame AND abs(a."by" - b."by") <= 1 AND abs(a.bx - b.bx) <= 1), m AS (SELECT frame, k, min(s) AS s FROM r GROUP BY 1, 2)
SELECT frame, CAST(s // 10 AS INT) AS y, CAST(s % 10 AS INT) AS x, count(*) AS size FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def k9_components(spark, sf_dir):
    found = grid.components(blocks(spark, sf_dir).withColumn("fg", F.col("v") > 56000), ["frame"], "fg", written)
    return found.groupBy("frame", F.col("component.by").alias("y"), F.col("component.bx").alias("x")).agg(F.count("*").alias("size")).where("size >= 2")


@query()
def k9_all_components(spark, sf_dir):
    """The same query, held against a flood fill."""
    return k9_components(spark, sf_dir)


@query(f"""WITH {F3}, y AS (SELECT frame, bx, unnest(range("by" * 8, "by" * 8 + 8)) AS y FROM f3 WHERE fg = 1), x AS (SELECT frame, y, unnest(range(bx * 8, bx * 8 + 8)) AS x FROM y) SELECT frame, count(*) AS marked, CAST(sum(y * 100 + x) AS BIGINT) AS places FROM x WHERE y < 90 AND x < 77 GROUP BY 1""")
def k6_exact_mask(spark, sf_dir):
    m = grid.exact_mask(blocks(spark, sf_dir).where("fg = 1"), ["frame"], 8, 90, 77)
    return m.groupBy("frame").agg(F.count("*").alias("marked"), F.sum(F.col("y") * 100 + F.col("x")).alias("places"))


@query(f"""WITH {F3} SELECT frame, "by", bx, CASE WHEN fg = 1 THEN v ELSE v * 0.5 END AS shown, CASE WHEN fg = 1 THEN floor(avg(v) OVER (PARTITION BY frame, "by")) ELSE v END AS filled FROM f3""")
def k7_k12_composite_fill(spark, sf_dir):
    """Generated values inside the mask and transmitted ones outside; selected blocks filled with their row's truncated mean."""
    mean = F.floor(F.avg("v").over(Window.partitionBy("frame", "by"))).cast("double")
    return blocks(spark, sf_dir).select("frame", "by", "bx", F.when(F.col("fg") == 1, F.col("v")).otherwise(F.col("v") * 0.5).alias("shown"), F.when(F.col("fg") == 1, mean).otherwise(F.col("v")).alias("filled"))


@query(f"""WITH {F3}, e AS (SELECT DISTINCT "by", bx FROM f3 WHERE frame % 3 = 1), g AS (SELECT "by", bx, t.frame, fg FROM e CROSS JOIN range(8) t(frame) LEFT JOIN (SELECT * FROM f3 WHERE frame % 3 = 1) s USING ("by", bx, frame))
SELECT CAST(frame AS INT) AS frame, "by", bx, coalesce(last_value(fg IGNORE NULLS) OVER (PARTITION BY "by", bx ORDER BY frame), 1) AS fg FROM g""")
def k14_fill_frames(spark, sf_dir):
    return grid.fill_frames(blocks(spark, sf_dir).where("frame % 3 = 1"), ["by", "bx"], "frame", "fg", 8, 1).select("frame", "by", "bx", "fg")


@query(f"""WITH {F3} SELECT frame, "by", bx, row_number() OVER (PARTITION BY frame, "by" ORDER BY v DESC, bx) <= floor(0.3 * count(*) OVER (PARTITION BY frame, "by")) AS selected FROM f3""")
def l2_top_of_rows(spark, sf_dir):
    return grid.select_top(blocks(spark, sf_dir), ["frame", "by"], "v", ["bx"], 0.3).select("frame", "by", "bx", "selected")


@query(f"""WITH {F3} SELECT frame, "by", bx, row_number() OVER (PARTITION BY frame ORDER BY md5('r|' || frame || '|' || "by" || '|' || bx)) <= floor(0.25 * count(*) OVER (PARTITION BY frame)) AS selected FROM f3""")
def l3_random_top(spark, sf_dir):
    return grid.random_top(blocks(spark, sf_dir), ["frame"], ["by", "bx"], 0.25, "r").select("frame", "by", "bx", "selected")


@query(f"""WITH {F3}, l AS (SELECT *, CAST(floor(w * 40) AS INT) AS level FROM f3), c AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v, "by", bx) AS k FROM l), g AS (SELECT frame, level AS new_level, row_number() OVER (PARTITION BY frame ORDER BY level DESC, "by", bx) AS k FROM l)
SELECT frame, "by", bx, level, new_level FROM c JOIN g USING (frame, k)""")
def l4_reassign_levels(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("level", F.floor(F.col("w") * 40).cast("int"))
    return grid.reassign_levels(b, ["frame"], "level", "v", ["by", "bx"]).select("frame", "by", "bx", "level", "new_level")


@query(f"""WITH {F3}, c AS (SELECT *, v - avg(v) OVER (PARTITION BY frame) AS d FROM f3) SELECT frame, "by", bx, round(d / max(abs(d)) OVER () * 6, 5) AS "offset" FROM c""")
def p31_qp_offsets(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("clip", F.lit("c"))
    return grid.qp_offsets(b, ["clip"], ["frame"], "v", 6.0).select("frame", "by", "bx", F.round("offset", 5).alias("offset"))


@query(f"""WITH {F3} SELECT frame, "by", bx, max(v) OVER p AS pooled, round(var_pop(w) OVER p, 9) AS variance FROM f3 WINDOW p AS (PARTITION BY "by", bx)""")
def w9_w11_over_frames(spark, sf_dir):
    w = Window.partitionBy("by", "bx")
    return blocks(spark, sf_dir).select("frame", "by", "bx", F.max("v").over(w).alias("pooled"), F.round(F.var_pop("w").over(w), 9).alias("variance"))


@query(f"""WITH {F3}, b AS (SELECT frame, min("by") AS ya, max("by") AS yb, min(bx) AS xa, max(bx) AS xb FROM f3 WHERE v > 57000 GROUP BY 1), e AS (SELECT frame, greatest(ya - 1, 0) // 2 * 2 AS y0, least((least(yb + 2, 12) + 1) // 2 * 2, 12) AS y1, greatest(xa - 1, 0) // 2 * 2 AS x0, least((least(xb + 2, 10) + 1) // 2 * 2, 10) AS x1 FROM b)
SELECT *, round((y1 - y0) * (x1 - x0) / 120, 6) AS share FROM e""")
def a35_boxes(spark, sf_dir):
    return summaries.boxes(blocks(spark, sf_dir), ["frame"], F.col("v") > 57000, 1, 12, 10).withColumn("share", F.round("share", 6))


@query(f"""WITH {F3}, l AS (SELECT *, lag(fg) OVER p AS fg0, lag(v) OVER p AS v0 FROM f3 WINDOW p AS (PARTITION BY "by", bx ORDER BY frame)) SELECT frame, round(avg(fg), 6) AS fg_share, round(avg(abs(fg - fg0)), 6) AS churn, round(avg(abs(v - v0)) FILTER (fg = 0), 4) AS residual FROM l GROUP BY 1""")
def a36_clip_attributes(spark, sf_dir):
    w = Window.partitionBy("by", "bx").orderBy("frame")
    b = blocks(spark, sf_dir).withColumn("fg0", F.lag("fg").over(w)).withColumn("v0", F.lag("v").over(w))
    return b.groupBy("frame").agg(F.round(F.avg("fg"), 6).alias("fg_share"), F.round(F.avg(F.abs(F.col("fg") - F.col("fg0"))), 6).alias("churn"), F.round(F.avg(F.when(F.col("fg") == 0, F.abs(F.col("v") - F.col("v0")))), 4).alias("residual"))


@query(f"""WITH {F3} SELECT CAST(floor("by" / 4) AS INT) AS sy, CAST(floor(bx / 4) AS INT) AS sx, frame, round(avg(w * w), 9) AS mse, round(10 * log10(65025.0 / greatest(avg(w * w), 1e-12)), 5) AS psnr, round(avg(CASE WHEN w <= 0.02 OR w >= 0.08 THEN 1.0 ELSE 0.0 END), 6) AS clipped FROM f3 WHERE "by" < 12 AND bx < 8 GROUP BY 1, 2, 3""")
def a31_a34_block_error(spark, sf_dir):
    """Error and clipped share of whole blocks of 4 x 4; what is left over at the edge is cropped."""
    from tarn.functions.scalar import psnr

    b = grid.whole_blocks(blocks(spark, sf_dir), 4, 12, 10).withColumn("e", F.col("w") * F.col("w"))
    by = b.groupBy(F.floor(F.col("by") / 4).cast("int").alias("sy"), F.floor(F.col("bx") / 4).cast("int").alias("sx"), "frame")
    clipped = F.avg(((F.col("w") <= 0.02) | (F.col("w") >= 0.08)).cast("double"))
    return by.agg(F.round(F.avg("e"), 9).alias("mse"), F.round(psnr(F.avg("e")), 5).alias("psnr"), F.round(clipped, 6).alias("clipped"))


@query(f"""WITH {F3}, f AS (SELECT frame, sum(CASE WHEN fg = 0 THEN v END) / sum(v) AS share, avg(CASE WHEN fg = 0 THEN v END) / avg(CASE WHEN fg = 1 THEN v END) AS ratio, stddev_pop(v) / avg(v) AS cv, avg(CASE WHEN fg = 1 THEN v END) AS m FROM f3 GROUP BY 1)
SELECT round(avg(share), 6) AS share, round(avg(ratio), 6) AS ratio, round(avg(cv), 6) AS cv, round(avg(m), 3) AS region_mean FROM f""")
def a40_a46_region_content(spark, sf_dir):
    """Per-frame region ratios, then their mean; frames without the region are null and skipped."""
    bg, fg = F.when(F.col("fg") == 0, F.col("v")), F.when(F.col("fg") == 1, F.col("v"))
    by = blocks(spark, sf_dir).groupBy("frame").agg(F.try_divide(F.sum(bg), F.sum("v")).alias("share"), F.try_divide(F.avg(bg), F.avg(fg)).alias("ratio"), F.try_divide(F.stddev_pop("v"), F.avg("v")).alias("cv"), F.avg(fg).alias("m"))
    return by.agg(F.round(F.avg("share"), 6).alias("share"), F.round(F.avg("ratio"), 6).alias("ratio"), F.round(F.avg("cv"), 6).alias("cv"), F.round(F.avg("m"), 3).alias("region_mean"))


@query(f"""WITH {F3}, s AS (SELECT a.frame, a."by", a.bx, a.v, bool_or(coalesce(b.fg = 0, false)) AS seam FROM f3 a LEFT JOIN f3 b ON a.frame = b.frame AND abs(a."by" - b."by") + abs(a.bx - b.bx) = 1 WHERE a.fg = 1 GROUP BY 1, 2, 3, 4)
SELECT frame, count(*) FILTER (seam) AS seams, count(*) FILTER (NOT seam) AS interior, round(median(v) FILTER (seam), 4) AS seam_median, round(median(v) FILTER (NOT seam), 4) AS interior_median FROM s GROUP BY 1 HAVING count(*) FILTER (seam) >= 5 AND count(*) FILTER (NOT seam) >= 1""")
def a43_seam_interior(spark, sf_dir):
    b = blocks(spark, sf_dir)
    s = grid.seams(b.select("frame", "by", "bx", "fg"), ["frame"], "fg").join(b.select("frame", "by", "bx", "v"), ["frame", "by", "bx"]).where("fg = 1")
    by = s.groupBy("frame").agg(F.count_if("seam").alias("seams"), F.count_if(~F.col("seam")).alias("interior")).where("seams >= 5 AND interior >= 1")
    middle = ranks.medians(s, ["frame"], {"seam_median": F.when(F.col("seam"), F.col("v")), "interior_median": F.when(~F.col("seam"), F.col("v"))})
    return ranks.same(by, middle, ["frame"], "left").withColumn("seam_median", F.round("seam_median", 4)).withColumn("interior_median", F.round("interior_median", 4))


@query(f"""WITH {F3}, r AS (SELECT *, ceil(0.2 * count(*) OVER (PARTITION BY frame)) AS k, row_number() OVER (PARTITION BY frame ORDER BY w DESC, "by", bx) AS s, row_number() OVER (PARTITION BY frame ORDER BY v DESC, "by", bx) AS g FROM f3)
SELECT frame, round(sum(v) FILTER (s <= k) / sum(v) FILTER (g <= k), 6) AS ratio, round(max(k) * avg(v) / sum(v) FILTER (g <= k), 6) AS random FROM r GROUP BY 1""")
def t28_t29_capture(spark, sf_dir):
    c = summaries.capture(blocks(spark, sf_dir), ["frame"], "w", "v", ["by", "bx"], 0.2)
    return c.select("frame", F.round("ratio", 6).alias("ratio"), F.round("random", 6).alias("random"))


@query(f"""WITH {F3} SELECT a.frame, count(*) AS places, round(avg(a.v - b.v), 4) AS delta FROM f3 a JOIN f3 b ON a."by" = b."by" AND a.bx = b.bx AND b.frame = a.frame + 1 AND a.frame < 6 WHERE a."by" < 11 GROUP BY 1""")
def j15_common_frames(spark, sf_dir):
    b = blocks(spark, sf_dir)
    o = b.select((F.col("frame") - 1).alias("frame"), "by", "bx", F.col("v").alias("v2"))
    return b.where("frame < 6 AND `by` < 11").join(o, ["frame", "by", "bx"]).groupBy("frame").agg(F.count("*").alias("places"), F.round(F.avg(F.col("v") - F.col("v2")), 4).alias("delta"))


@query(f"""WITH {F3}, m AS (SELECT CAST(floor("by" / 4) AS INT) AS sy, CAST(floor(bx / 4) AS INT) AS sx, frame, avg(v) FILTER (fg = 1) AS l3, avg(v) FILTER (fg = 0) AS l2 FROM f3 GROUP BY 1, 2, 3) SELECT f3.frame, "by", bx, round(l3 - l2, 4) AS marginal FROM f3 LEFT JOIN m ON f3.frame = m.frame AND floor("by" / 4) = sy AND floor(bx / 4) = sx""")
def j25_marginal(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("sy", F.floor(F.col("by") / 4)).withColumn("sx", F.floor(F.col("bx") / 4))
    side = lambda flag, name: b.where(F.col("fg") == flag).groupBy("frame", "sy", "sx").agg(F.avg("v").alias(name))
    m = side(1, "l3").join(side(0, "l2"), ["frame", "sy", "sx"], "full")
    return b.join(m, ["frame", "sy", "sx"], "left").select("frame", "by", "bx", F.round(F.col("l3") - F.col("l2"), 4).alias("marginal"))


@query()
def t18_bd_quality(spark, sf_dir):
    """Mean quality difference at equal rate; tests hold it against a least-squares solver."""
    from tarn.plans.catalog import _curves

    return curves.bd_quality(_curves(spark, sf_dir), ["clip"], "arm", "A", "N", "rate", "q").withColumn("bd_quality", F.round("bd_quality", 6))
