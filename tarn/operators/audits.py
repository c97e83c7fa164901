"""Audits over runs: which goals hold where, and what degrading and restoring did to each superblock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import grid, pairing, ranks


def goals(df: DataFrame, key: list[str], arm: str, baseline: str, bits: str, fg: str, bg: str, config: str, fill: str, fg_jnd: float, bg_jnd: float, order: str) -> DataFrame:
    """Treated runs with reduction and restoration: true, false, or null where a goal cannot be scored.

    Reduction: fewer bits than the baseline of the same key, and a foreground not worse by more than fg_jnd. Restoration: a background better (lower) than that of the run
    of the same key and config whose fill is none by bg_jnd or more; such control runs have none themselves. Of several baselines or controls the last by `order` counts.
    dbits (percent), dfg and gain say by how much.
    """
    base = df.where(F.col(arm) == baseline).groupBy(*key).agg(F.max_by(F.struct(F.col(bits).alias("b"), F.col(fg).alias("f")), order).alias("_base"))
    none = F.coalesce(F.col(fill), F.lit("none")) == "none"
    treated = df.where(F.col(arm) != baseline)
    control = treated.where(none).groupBy(*key, config).agg(F.max_by(bg, order).alias("_control"))
    both = ranks.same(ranks.same(treated, base, key, "left"), control, [*key, config], "left")
    dbits = F.when(F.col("_base.b") > 0, 100.0 * (F.col(bits) - F.col("_base.b")) / F.col("_base.b"))
    dfg, gain = F.col(fg) - F.col("_base.f"), F.when(~none, F.col("_control") - F.col(bg))
    out = both.withColumn("dbits", F.when(dfg.isNotNull(), dbits)).withColumn("dfg", F.when(F.col("dbits").isNotNull(), dfg)).withColumn("gain", gain)
    won = (F.col("dbits") < 0) & (F.col("dfg") >= -fg_jnd)
    return out.withColumn("reduction", won).withColumn("restoration", F.col("gain") >= bg_jnd - 1e-9).drop("_base", "_control")


def goal_scopes(scored: DataFrame, dimensions: list[str]) -> DataFrame:
    """(goal, dimension, value, hits, cells): each goal over all scored runs and by each dimension, and the runs scored on both goals by what they meet.

    Goals are reduction, restoration and, for runs scored on both, both, reduction_only, restoration_only and neither, of which a run is a hit of one.
    """
    a, b = F.col("reduction"), F.col("restoration")
    joint = a.isNotNull() & b.isNotNull()
    named = {"reduction": a, "restoration": b, "both": F.when(joint, a & b), "reduction_only": F.when(joint, a & ~b), "restoration_only": F.when(joint, ~a & b), "neither": F.when(joint, ~a & ~b)}
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("goal"), c.alias("hit")) for n, c in named.items()]))
    long = scored.select(*[F.col(d).cast("string").alias(d) for d in dimensions], each).where("hit IS NOT NULL")
    places = F.inline(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]))
    return long.select("goal", "hit", places).groupBy("goal", "dimension", "value").agg(F.count_if("hit").alias("hits"), F.count("*").alias("cells"))


def restoration_cost(scored: DataFrame, fill: str, seconds: str, frames: str) -> DataFrame:
    """(fill, n, seconds_per_frame, fps) over the timed runs that meet both goals."""
    timed = scored.where(F.col("reduction") & F.col("restoration") & (F.col(seconds) > 0) & (F.col(frames) > 0))
    by = timed.groupBy(fill).agg(F.count("*").alias("n"), F.avg(F.col(seconds) / F.col(frames)).alias("seconds_per_frame"))
    return by.withColumn("fps", 1 / F.col("seconds_per_frame"))


def matched(runs: DataFrame, key: str, component: str, baseline: str, point: list[str], treated: Column) -> DataFrame:
    """Treated runs with base_key, the first baseline (by key) of the same operating point; runs without one are left out."""
    found = pairing.star(runs.where(treated | (F.col(component) == baseline)), point, component, baseline, [key], [key])
    return found.withColumnRenamed(f"base_{key}", "base_key")


def block_damage(pairs: DataFrame, key: str, errors: DataFrame, strengths: DataFrame, block: int, cell: int, height: int, width: int) -> DataFrame:
    """(key, frame, sy, sx, strength_share, mse, mse_base, psnr, psnr_base, damage) of each superblock of each pair of key and base_key.

    errors is (key, frame, by, bx, mse), strengths (key, frame, by, bx, level). Only frames that the run, its baseline and its strengths all have count, by their numbers
    of frames. Errors are pooled by area and only then turned into dB; strength_share is the share of the area whose level is above 0; damage is the dB that the
    run lost against its baseline. Pairs whose baseline or strengths are missing give nothing.
    """
    frames = lambda d, name: d.groupBy(key).agg((F.max("frame") + 1).alias(name))
    p = pairs.select(key, "base_key")
    sized = p.join(frames(errors, "_a"), key).join(frames(strengths, "_c"), key)
    sized = sized.join(frames(errors, "_b").withColumnRenamed(key, "base_key"), "base_key").select(key, "base_key", F.least("_a", "_b", "_c").alias("_frames"))
    own = errors.join(sized.select(key, "_frames"), key).where("frame < _frames").select(key, "frame", "by", "bx", "mse")
    level = strengths.join(sized.select(key, "_frames"), key).where("frame < _frames").select(key, "frame", "by", "bx", (F.col("level") > 0).cast("double").alias("strength_share"))
    # a baseline is pooled once, whatever the number of runs that are held against it
    needed = sized.groupBy("base_key").agg(F.max("_frames").alias("_frames"))
    base = errors.withColumnRenamed(key, "base_key").join(needed, "base_key").where("frame < _frames").select("base_key", "frame", "by", "bx", F.col("mse").alias("mse_base"))
    pool = lambda d, k, v: grid.pool(d, [k, "frame"], v, block, cell, height, width)
    place = ["frame", "sy", "sx"]
    both = pool(own, key, "mse").join(pool(level, key, "strength_share"), [key, *place]).join(sized.select(key, "base_key"), key).join(pool(base, "base_key", "mse_base"), ["base_key", *place])
    both = both.withColumn("psnr", scalar.psnr(F.col("mse"))).withColumn("psnr_base", scalar.psnr(F.col("mse_base")))
    return both.select(key, *place, "strength_share", "mse", "mse_base", "psnr", "psnr_base", (F.col("psnr_base") - F.col("psnr")).alias("damage"))


def damage_summary(damage: DataFrame, group: str) -> DataFrame:
    """(group, n_degraded, degraded, clean, spread): medians of the damage of superblocks degraded by more than half and of those not at all, and the
    reach of the former from their tenth to their ninetieth percentile. Groups without a degraded superblock are left out; clean can be null."""
    hit = damage.where("strength_share > 0.5")
    q = ranks.quantiles(hit, [group], "damage", {"p10": 0.1, "degraded": 0.5, "p90": 0.9})
    clean = ranks.medians(damage.where("strength_share = 0"), [group], {"clean": "damage"})
    return ranks.same(q, clean, [group], "left").select(group, F.col("n").alias("n_degraded"), "degraded", "clean", (F.col("p90") - F.col("p10")).alias("spread"))
