"""Block and frame grids: interval pooling, temporal and spatial stencils, selection under a budget, seams, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool(df: DataFrame, keys: list[str], value: str, block: int, cell: int, height: int, width: int) -> DataFrame:
    """Blocks (by, bx) pooled onto cells (sy, sx), weighted by the area they share; edges may be partial.

    An interval overlap join as equi keys: each block names the cells it covers.
    """
    axis = lambda c, n: F.transform(
        F.sequence(F.floor(F.col(c) * block / cell).cast("int"), F.floor((F.least(F.col(c) * block + block, F.lit(n)) - 1) / cell).cast("int")),
        lambda s: F.struct(s.alias("s"), (F.least(F.col(c) * block + block, (s + 1) * cell, F.lit(n)) - F.greatest(F.col(c) * block, s * cell)).alias("w")),
    )
    inside = df.where((F.col("by") * block < height) & (F.col("bx") * block < width))
    cells = inside.select(*keys, value, F.explode(axis("by", height)).alias("_y"), "bx").select(*keys, value, "_y", F.explode(axis("bx", width)).alias("_x"))
    w = F.col("_y.w") * F.col("_x.w")
    return cells.groupBy(*keys, F.col("_y.s").alias("sy"), F.col("_x.s").alias("sx")).agg((F.sum(w * F.col(value)) / F.greatest(F.sum(w), F.lit(1e-12))).alias(value))


def blend_next(df: DataFrame, place: list[str], frame: str, spatial: str, temporal: str, alpha: float) -> DataFrame:
    """score: alpha of the spatial and the rest of the next frame's temporal value; the last frame is spatial alone."""
    nxt = F.lead(temporal).over(Window.partitionBy(*place).orderBy(frame))
    return df.withColumn("score", F.coalesce(alpha * F.col(spatial) + (1 - alpha) * nxt, F.col(spatial)))


def smooth_time(df: DataFrame, place: list[str], frame: str, value: str, beta: float) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*place).orderBy(frame))
    return df.withColumn("smooth", F.coalesce(beta * F.col(value) + (1 - beta) * before, F.col(value)))


def select_top(df: DataFrame, frame: list[str], value: str, place: list[str], share: float) -> DataFrame:
    """The highest floor(share * n) blocks of each frame; ties go by place."""
    w = Window.partitionBy(*frame)
    return df.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(value), *place))).withColumn("_k", F.floor(share * F.count("*").over(w))).withColumn("selected", F.col("_rn") <= F.col("_k")).drop("_rn", "_k")


def neighbours(df: DataFrame, frame: list[str], offsets: list[tuple[int, int, float]]) -> DataFrame:
    """A row for each block and offset with the neighbour's value (v2; null outside) and the offset's weight."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("weight")) for dy, dx, w in offsets])
    asked = df.select("*", F.explode(steps).alias("_o")).select("*", (F.col("by") + F.col("_o.dy")).alias("_y"), (F.col("bx") + F.col("_o.dx")).alias("_x"), "_o.weight").drop("_o")
    other = df.select(*frame, F.col("by").alias("_y"), F.col("bx").alias("_x"), F.col("v").alias("v2"))
    return asked.join(other, [*frame, "_y", "_x"], "left").drop("_y", "_x")


def seams(df: DataFrame, frame: list[str], flag: str) -> DataFrame:
    """seam: a flagged block with a neighbour that is not (outside counts as flagged)."""
    four = neighbours(df.withColumn("v", F.col(flag)), frame, [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)])
    return four.groupBy(*frame, "by", "bx", flag).agg((F.bool_or(F.coalesce(F.col("v2") == 0, F.lit(False))) & (F.col(flag) == 1)).alias("seam"))


def dilate(df: DataFrame, frame: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    return neighbours(df, frame, [(y, x, 1.0) for y, x in offsets]).groupBy(*frame, "by", "bx").agg(F.max(F.coalesce("v2", F.lit(0))).alias("v"))


def hold_last(df: DataFrame, place: list[str], frame: str, value: str, selected: str) -> DataFrame:
    """Selected blocks show the last kept value before them; a first frame is always kept."""
    w = Window.partitionBy(*place).orderBy(frame)
    kept = F.when(~F.col(selected) | (F.row_number().over(w) == 1), F.col(value))
    marked = df.withColumn("_k", kept)
    return marked.withColumn("held", F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_k")


def smooth(df: DataFrame, frame: list[str], value: str, height: int, width: int) -> DataFrame:
    """smooth: 5 x 5 binomial taps (1 4 6 4 1 over 16 on each axis), the border mirrored without repeating the edge.

    Each block gives its weighted value to the places that see it, mirrored places included: one aggregation, no join.
    """
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / 16).alias("w")) for d, w in zip(range(-2, 3), (1, 4, 6, 4, 1))])

    def seen_from(c: str, n: int):
        # places p whose tap p + d, mirrored at 0 and n - 1, is c
        spots = F.flatten(F.transform(taps, lambda t: F.transform(F.array(F.col(c), -F.col(c), 2 * (n - 1) - F.col(c)), lambda at: F.struct((at - t["d"]).alias("p"), at.alias("at"), t["w"].alias("w")))))
        return F.array_distinct(F.filter(spots, lambda s: (s["p"] >= 0) & (s["p"] < n)))

    y = df.select(*frame, value, "bx", F.explode(seen_from("by", height)).alias("_y"))
    both = y.select(*frame, value, "_y", F.explode(seen_from("bx", width)).alias("_x"))
    return both.groupBy(*frame, F.col("_y.p").alias("by"), F.col("_x.p").alias("bx")).agg(F.sum(F.col("_y.w") * F.col("_x.w") * F.col(value)).alias("smooth"))


def gradient(df: DataFrame, frame: list[str]) -> DataFrame:
    """size of the 3 x 3 Sobel gradient of v for the blocks that have all neighbours: each block gives its v to the nine around it."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(dx * (2 - abs(dy)))).alias("wx"), F.lit(float(dy * (2 - abs(dx)))).alias("wy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    given = df.select(*frame, "by", "bx", "v", F.explode(steps).alias("_o")).select(*frame, (F.col("by") - F.col("_o.dy")).alias("by"), (F.col("bx") - F.col("_o.dx")).alias("bx"), "v", "_o.wx", "_o.wy")
    by = given.groupBy(*frame, "by", "bx").agg(F.count("v").alias("_n"), F.sum(F.col("wx") * F.col("v")).alias("_gx"), F.sum(F.col("wy") * F.col("v")).alias("_gy"))
    return by.where("_n = 9").select(*frame, "by", "bx", F.hypot("_gx", "_gy").alias("gradient"))


def components(df: DataFrame, frame: list[str], flag: str, write) -> DataFrame:
    """component (its smallest place) of each flagged block, neighbours in eight directions joined.

    Labels fall to the smallest around them, then to their label's label, until none moves; write(df) stores each
    round in shared storage and gives it back.
    """
    here = F.struct("by", "bx")
    labels = write(df.where(flag).select(*frame, "by", "bx", here.alias("component")))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    while True:
        given = labels.select(*frame, F.explode(steps).alias("_o"), "by", "bx", "component").select(*frame, (F.col("by") + F.col("_o.dy")).alias("by"), (F.col("bx") + F.col("_o.dx")).alias("bx"), "component")
        least = labels.select(*frame, "by", "bx", F.col("component").alias("_old")).join(given.groupBy(*frame, "by", "bx").agg(F.min("component").alias("_new")), [*frame, "by", "bx"])
        tops = labels.select(*frame, here.alias("_new"), F.col("component").alias("_top"))
        after = write(least.join(tops, [*frame, "_new"]).select(*frame, "by", "bx", "_old", F.least("_new", "_top").alias("component")))
        moved = after.where("component <> _old").limit(1).count()
        labels = after.drop("_old")
        if not moved:
            return labels


def exact_mask(df: DataFrame, frame: list[str], block: int, height: int, width: int) -> DataFrame:
    """A row for each place inside the frame that a marked block covers."""
    y = df.select(*frame, "bx", F.explode(F.sequence(F.col("by") * block, F.col("by") * block + block - 1)).alias("y"))
    return y.select(*frame, "y", F.explode(F.sequence(F.col("bx") * block, F.col("bx") * block + block - 1)).alias("x")).where((F.col("y") < height) & (F.col("x") < width))


def fill_frames(df: DataFrame, place: list[str], frame: str, value: str, frames: int, default: int) -> DataFrame:
    """A row for each place and frame 0 to frames - 1: a missing value repeats the last one, or the default before any."""
    every = df.select(*place).distinct().select(*place, F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias(frame))
    w = Window.partitionBy(*place).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return every.join(df.select(*place, frame, value), [*place, frame], "left").withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def random_top(df: DataFrame, frame: list[str], place: list[str], share: float, seed: str) -> DataFrame:
    """As many blocks as select_top takes, in an order drawn from the seed, the frame and the place."""
    drawn = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in [*frame, *place]]).cast("binary"))
    w = Window.partitionBy(*frame)
    return df.withColumn("selected", F.row_number().over(w.orderBy(drawn)) <= F.floor(share * F.count("*").over(w)))


def reassign_levels(df: DataFrame, frame: list[str], level: str, cost: str, place: list[str]) -> DataFrame:
    """new_level: each frame keeps its count of every level, the highest levels going to the cheapest blocks, unknown costs last."""
    w = Window.partitionBy(*frame)
    cheap = df.withColumn("_k", F.row_number().over(w.orderBy(F.col(cost).asc_nulls_last(), *place)))
    given = df.select(*frame, F.col(level).alias("new_level"), F.row_number().over(w.orderBy(F.desc(level), *place)).alias("_k"))
    return cheap.join(given, [*frame, "_k"]).drop("_k")


def qp_offsets(df: DataFrame, clip: list[str], frame: list[str], score: str, most: float) -> DataFrame:
    """offset: the score centred in each frame, scaled by the clip's largest deviation, so that offsets cancel out."""
    c = df.withColumn("_c", F.col(score) - F.avg(score).over(Window.partitionBy(*clip, *frame)))
    top = F.max(F.abs("_c")).over(Window.partitionBy(*clip))
    return c.withColumn("offset", F.when(top < 1e-6, 0.0).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), F.col("_c") / top * most)))).drop("_c")


def _sampled(c: str, source: int, samples: int):
    """Samples of an axis that read place c when `samples` are taken nearest from `source` places."""
    first = F.ceil(F.col(c) * samples / source).cast("int")
    last = F.ceil((F.col(c) + 1) * samples / source).cast("int") - 1
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def block_coverage(mask: DataFrame, frame: list[str], flag: str, source: tuple[int, int], blocks: tuple[int, int], block: int, coverage: float) -> DataFrame:
    """foreground of each block: the mask, sampled nearest onto blocks of block x block places, covers more than coverage of it."""
    y = mask.select(*frame, flag, "bx", F.explode(_sampled("by", source[0], blocks[0] * block)).alias("_y"))
    both = y.select(*frame, flag, "_y", F.explode(_sampled("bx", source[1], blocks[1] * block)).alias("_x"))
    by = both.groupBy(*frame, F.floor(F.col("_y") / block).cast("int").alias("by"), F.floor(F.col("_x") / block).cast("int").alias("bx"))
    return by.agg((F.avg((F.col(flag) > 0).cast("double")) > coverage).alias("foreground"))


def nearest_sample(df: DataFrame, frame: list[str], value: str, source: tuple[int, int], blocks: tuple[int, int]) -> DataFrame:
    """value of each block of a coarser grid: that of the one place nearest sampling reads, which names its blocks itself."""
    y = df.select(*frame, value, "bx", F.explode(_sampled("by", source[0], blocks[0])).alias("_y"))
    return y.select(*frame, F.col("_y").alias("by"), F.explode(_sampled("bx", source[1], blocks[1])).alias("_x"), value).withColumnRenamed("_x", "bx")


def removability(df: DataFrame, place: list[str], frame: str, spatial: str, temporal: str, flag: str, alpha: float, beta: float) -> DataFrame:
    """score from 0 to 1: spatial blended with the next frame's temporal value, ten times as much in the background, smoothed with
    the frame before, and scaled by the least and the largest of all."""
    blended = blend_next(df, place, frame, spatial, temporal, alpha)
    boosted = blended.withColumn("score", F.when(F.col(flag) == 0, F.col("score") * 10.0).otherwise(F.col("score")))
    smoothed = smooth_time(boosted, place, frame, "score", beta) if beta < 1 else boosted.withColumn("smooth", F.col("score"))
    ends = smoothed.agg(F.min("smooth").alias("_lo"), F.max("smooth").alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col("smooth") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return smoothed.join(F.broadcast(ends)).withColumn("score", scaled).drop("smooth", "_lo", "_hi")  # ends is one row


def mask_union(df: DataFrame, place: list[str], instance: str) -> DataFrame:
    """mask: 1 where any instance covers the place."""
    return df.groupBy(*place).agg(F.max((F.col(instance) > 0).cast("int")).alias("mask"))


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptical neighbourhood."""
    return [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]


def erode(df: DataFrame, frame: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """The smallest value under the offsets; places outside do not count."""
    return neighbours(df, frame, [(y, x, 1.0) for y, x in offsets]).groupBy(*frame, "by", "bx").agg(F.min("v2").alias("v"))


def seeded_shift(df: DataFrame, frame: str, most: int, height: int, width: int, seed: str) -> DataFrame:
    """Blocks moved by up to `most` places on each axis, a step that the seed and the frame draw; what leaves the frame is lost."""
    def drawn(axis: str):
        text = F.concat_ws("|", F.lit(seed), F.col(frame).cast("string"), F.lit(axis))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long") % (2 * most + 1)).cast("int") - most

    moved = df.withColumn("by", F.col("by") + drawn("y")).withColumn("bx", F.col("bx") + drawn("x"))
    return moved.where(F.col("by").between(0, height - 1) & F.col("bx").between(0, width - 1))


def superblocks(df: DataFrame, frame: list[str], size: int):
    """Blocks grouped into superblocks (sy, sx); those at the edge have fewer."""
    return df.groupBy(*frame, F.floor(F.col("by") / size).cast("int").alias("sy"), F.floor(F.col("bx") / size).cast("int").alias("sx"))


def content_attributes(df: DataFrame, clip: list[str], texture: str, motion: str, flag: str) -> DataFrame:
    """Motion in all, in the foreground and in the background, the background's texture and the foreground's share; null where a side is empty."""
    fg = F.col(flag) == 1
    return df.groupBy(*clip).agg(
        F.avg(motion).alias("motion"), F.avg(F.when(fg, F.col(motion))).alias("fg_motion"), F.avg(F.when(~fg, F.col(motion))).alias("bg_motion"),
        F.avg(F.when(~fg, F.col(texture))).alias("bg_texture"), F.avg(fg.cast("double")).alias("fg_fraction"),
    )


def clip_attributes(blocks: DataFrame, log: DataFrame, runs: DataFrame, clip: str, texture: str, motion: str, flag: str, residual: str, frames: str) -> DataFrame:
    """The seven content attributes of each clip that any source knows; what a source lacks is null.

    A1_motion: mean motion of all blocks; A2_hole_instability and A5_bg_motion: of foreground and of background blocks; A3_bg_texture: mean texture of background blocks;
    A4_residual_info: mean of the frame log; A6_duration: most frames of its runs; A7_fg_fraction: share of foreground among the blocks whose flag is known.
    """
    fg = F.col(flag) == 1
    a = blocks.groupBy(clip).agg(
        F.avg(motion).alias("A1_motion"), F.avg(F.when(fg, F.col(motion))).alias("A2_hole_instability"), F.avg(F.when(~fg, F.col(texture))).alias("A3_bg_texture"),
        F.avg(F.when(~fg, F.col(motion))).alias("A5_bg_motion"), F.avg(fg.cast("double")).alias("A7_fg_fraction"),
    )
    b = log.groupBy(clip).agg(F.avg(residual).alias("A4_residual_info"))
    c = runs.where(F.col(frames) > 0).groupBy(clip).agg(F.max(frames).cast("double").alias("A6_duration"))
    return a.join(b, clip, "full").join(c, clip, "full").where(F.col(clip).isNotNull()).select(clip, "A1_motion", "A2_hole_instability", "A3_bg_texture", "A4_residual_info", "A5_bg_motion", "A6_duration", "A7_fg_fraction")


def region_errors(df: DataFrame, clip: list[str], frame: str, error: str, flag: str, peak: float = 255.0) -> DataFrame:
    """(clip, region, frames, mse_mean, mse_sd, psnr_mean, psnr_sd): each frame's error and its dB in foreground, background and overall, then mean and population
    deviation over the frames that have the region. An error of 0 counts as 1e-12."""
    fg = F.col(flag) == 1
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("region"), c.alias("_e")) for n, c in (("fg", F.when(fg, F.col(error))), ("bg", F.when(~fg, F.col(error))), ("overall", F.col(error)))]))
    one = df.select(*clip, frame, each).where("_e IS NOT NULL").groupBy(*clip, "region", frame).agg(F.avg("_e").alias("_m")).withColumn("_p", 10 * F.log10(peak * peak / F.greatest(F.col("_m"), F.lit(1e-12))))
    return one.groupBy(*clip, "region").agg(F.count("*").alias("frames"), *[f(c).alias(f"{n}_{w}") for n, c in (("mse", "_m"), ("psnr", "_p")) for w, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def composite(generated: DataFrame, transmitted: DataFrame, mask: DataFrame, place: list[str], value: str, flag: str) -> DataFrame:
    """Transmitted values with the generated ones in their place where the mask is set and there is one; a place without a mask row is not masked."""
    g = generated.select(*place, F.col(value).alias("_g"))
    m = mask.select(*place, (F.col(flag) > 0).alias("_m"))
    both = transmitted.join(m, place, "left").join(g, place, "left")
    return both.withColumn(value, F.when(F.coalesce("_m", F.lit(False)) & F.col("_g").isNotNull(), F.col("_g")).otherwise(F.col(value))).drop("_g", "_m")


def whole_blocks(df: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Places (by, bx) of a grid of height x width that lie in whole blocks of size x size; what is left over at the edges is cropped."""
    return df.where((F.col("by") < height // size * size) & (F.col("bx") < width // size * size))


def on_places(scores: DataFrame, values: DataFrame, place: list[str]) -> DataFrame:
    """Both sides of the places that both have: values outside of the score's grid are dropped."""
    return scores.join(values, place)


def block_damage(df: DataFrame, arm: str, asking: str, baseline: str, frame: list[str], value: str, size: int) -> DataFrame:
    """damage of each superblock of the asking arm: its mean less the baseline's, on the frames that both have. One pass over both arms."""
    pooled = superblocks(df.where(F.col(arm).isin(asking, baseline)), [arm, *frame], size).agg(F.avg(value).alias("_v"))
    side = lambda a: F.max(F.when(F.col(arm) == a, F.col("_v")))
    both = pooled.groupBy(*frame, "sy", "sx").agg(side(asking).alias("_a"), side(baseline).alias("_b"))
    return both.where("_a IS NOT NULL AND _b IS NOT NULL").withColumn("damage", F.col("_a") - F.col("_b")).drop("_a", "_b")


def select_budget(df: DataFrame, frame: list[str], value: str, place: list[str], amount: float, height: int, width: int, excluded) -> DataFrame:
    """The highest int(amount * width) * height blocks of each frame that are not excluded; ties go by place."""
    w = Window.partitionBy(*frame).orderBy(F.desc(value), *place)
    return df.where(~excluded).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= int(amount * width) * height).drop("_k")


def _captured(df: DataFrame, group: list[str], chosen, best, share: float, gain: str, up: bool = False) -> DataFrame:
    k = F.ceil(share * F.col("_n")) if up else F.floor(share * F.col("_n"))
    by = df.groupBy(*group).agg(F.sum(F.when(chosen <= k, F.col(gain))).alias("_got"), F.sum(F.when(best <= k, F.col(gain))).alias("_best"), F.sum(gain).alias("_all"), F.avg(gain).alias("_mean"), F.max(k).alias("_k"))
    whole = F.nullif(F.col("_best"), F.lit(0.0))
    chance = F.col("_k") * F.col("_mean") if up else share * F.col("_all")
    return by.withColumn("capture", F.try_divide(F.col("_got"), whole)).withColumn("by_chance", F.try_divide(chance, whole)).drop("_got", "_best", "_all", "_mean", "_k")


def oracle_capture(df: DataFrame, frame: list[str], score: str, gain: str, place: list[str], share: float, up: bool = False) -> DataFrame:
    """capture: the gain of the blocks that the score puts first, as a share of what the best choice of as many gives; by_chance: of a random one.

    As many are floor(share * blocks), and by_chance takes the share itself; with up they are rounded up and by_chance takes as many. Negative gains
    stay; both are null where the best choice gains nothing.
    """
    w = Window.partitionBy(*frame)
    ranked = df.withColumn("_s", F.row_number().over(w.orderBy(F.desc(score), *place))).withColumn("_b", F.row_number().over(w.orderBy(F.desc(gain), *place))).withColumn("_n", F.count("*").over(w))
    return _captured(ranked, frame, F.col("_s"), F.col("_b"), share, gain, up)


def random_capture(df: DataFrame, frame: list[str], gain: str, place: list[str], share: float, draws: int, seed: str) -> DataFrame:
    """capture of each draw: as many blocks as the share takes, in an order that the seed, the block and the draw's number give."""
    reps = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(*frame, "_rep")
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in [*frame, *place, "_rep"]]).cast("binary"))
    ranked = reps.withColumn("_s", F.row_number().over(w.orderBy(order))).withColumn("_b", F.row_number().over(w.orderBy(F.desc(gain), *place))).withColumn("_n", F.count("*").over(w))
    return _captured(ranked, [*frame, "_rep"], F.col("_s"), F.col("_b"), share, gain)
