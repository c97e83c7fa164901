"""Data-quality rules: each rule is a column that names the failure, or null; verdicts, audits, gates and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_number(c: Column) -> Column:
    """A finite number: null, NaN and infinities are not."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def verdict(*rules: Column) -> Column:
    """The failures of a row, in the order of the rules; empty if none."""
    return F.array_compact(F.array(*rules))


def metrics_present(regions: dict[str, Column]) -> list[Column]:
    """One rule for each region: its metric is a finite number above 0."""
    return [F.when(~is_number(c), f"{r} is not a finite number").when(c <= 0, f"{r} is not positive") for r, c in regions.items()]


def bitrate_accounting(actual: Column, sent_bytes: Column, frames: Column, fps: Column, tolerance: float = 0.01) -> Column:
    """The stated bitrate is that of the bytes sent; silent where the bytes or the duration are not known."""
    expected = F.try_divide(sent_bytes * 8.0, F.try_divide(frames.cast("double"), F.nullif(fps, F.lit(0.0))))
    off = F.try_divide(F.abs(actual - expected), F.nullif(expected, F.lit(0.0))) > tolerance
    return F.when(actual.isNull(), "bitrate is missing").when(~is_number(actual) | (actual <= 0), "bitrate is not positive").when(off, "bitrate disagrees with the bytes sent")


def fixed_quality(component: Column, degradation: Column, mode: Column, degrading: list[str], fixed_modes: list[str]) -> Column:
    """A degrading component ran at a fixed quality."""
    applies = component.isin(degrading) & degradation.isNotNull() & (degradation != "")
    return F.when(applies & mode.isNull(), "rate control is missing").when(applies & ~mode.isin(fixed_modes), "not at a fixed quality")


def restoration_did_not_hurt(restorer: Column, restored: Column, degraded: Column, slack: float = 0.05) -> Column:
    """The restored background is not worse than the transmitted one by more than slack; silent if either is no number."""
    known = restorer.isNotNull() & is_number(restored) & is_number(degraded)
    return F.when(known & (restored > degraded + slack), "restoration made the background worse")


def not_saturated(restorer: Column, output: Column, transmitted: Column, limit: float = 0.005) -> Column:
    """The share of clipped values does not exceed that of the input by more than limit; silent if either is no number."""
    known = restorer.isNotNull() & is_number(output) & is_number(transmitted)
    return F.when(known & (output - transmitted > limit), "restoration clipped the output")


def backfill(df: DataFrame, stored: str, now: Column, force: bool = False) -> DataFrame:
    """Verdicts where there is none; with force, everywhere."""
    return df.withColumn(stored, now if force else F.coalesce(F.col(stored), now))


def audit(df: DataFrame, stored: str, now: Column) -> DataFrame:
    """Rows whose stored verdict is missing or stale, with state."""
    state = F.when(F.col(stored).isNull(), "missing").when(~F.array_sort(F.col(stored)).eqNullSafe(F.array_sort(now)), "stale")
    return df.withColumn("state", state).where("state IS NOT NULL")


def costs_bits(quality: Column, dbits: Column) -> Column:
    """A pair at indistinguishable quality must not cost bits."""
    return F.when(quality == "distinguishable", None).when(dbits.isNull(), "bitrate is missing on one side").when(dbits > 0, "more bits at the same quality")


def band(value: Column, plausible: tuple[float, float], alarm: tuple[float, float] | None = None, alarm_above: float | None = None) -> Column:
    fired = F.lit(False)
    if alarm:
        fired |= ~value.between(*alarm)
    if alarm_above is not None:
        fired |= value > alarm_above
    return F.when(value.isNull(), "no data").when(value.between(*plausible), "in band").when(fired, "alarm").otherwise("outside plausible")


def gate(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: each aggregate condition, and passed if all hold (a null condition does not)."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()])
    every = F.lit(True)
    for n in conditions:
        every &= F.col(n)
    return one.withColumn("passed", every)


def completeness(planned: DataFrame, runs: DataFrame, key: list[str], group: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Planned rows of each group, those without a run, and those whose run meets each condition."""
    both = planned.join(runs.withColumn("_seen", F.lit(True)), key, "left")
    return both.groupBy(*group).agg(F.count("*").alias("planned"), F.count_if(F.col("_seen").isNull()).alias("missing"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def disjoint_ranges(df: DataFrame, group: list[str], arm: str, value: str) -> DataFrame:
    """disjoint: the arms' value ranges share nothing."""
    ends = df.groupBy(*group, arm).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return ends.groupBy(*group).agg((F.max("_lo") > F.min("_hi")).alias("disjoint"))


def reconcile(df: DataFrame, expected: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose value drifted from the expected one by more than tolerance, or that one side lacks."""
    both = df.select(*key, F.col(value).alias("now")).join(expected.select(*key, F.col(value).alias("expected")), key, "full")
    return both.where(F.coalesce(F.abs(F.col("now") - F.col("expected")) > tolerance, F.lit(True)))


def drops(df: DataFrame, reason: Column, key: str) -> DataFrame:
    """Rows by reason, with the smallest key as an example; rows without a reason are kept rows and not counted."""
    out = df.select(reason.alias("reason"), F.col(key).alias("_k")).where("reason IS NOT NULL")
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.min("_k").alias("first"))


def histogram_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Levels whose counts differ; none if the histogram was preserved."""
    a, b = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((before, "n_before"), (after, "n_after")))
    return a.join(b, keys, "full").na.fill(0, ["n_before", "n_after"]).where("n_before <> n_after")


def with_reason(df: DataFrame, mark: str, needs: list[str], reason: str) -> DataFrame:
    """df, refused when the query runs if a mark that needs a reason has none."""
    missing = F.col(mark).isin(needs) & (F.coalesce(F.trim(reason), F.lit("")) == "")
    return df.withColumn(mark, F.when(missing, F.raise_error(F.lit("a cell of this mark needs a reason"))).otherwise(F.col(mark)))


def count_matches(found: Column, expected: Column) -> Column:
    """Whether a log has as many rows as are expected of it; none found is no match."""
    return F.coalesce(found == expected, F.lit(False))
