"""Joins that pair runs: two arms, a baseline star, all pairs, complete ladders, missing partners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.ranks import same


def two_arms(df: DataFrame, pair_by: list[str], arm: str, a: str, b: str, value: str, order: str) -> DataFrame:
    """value_a, value_b and delta = b - a of each pair key that has both arms; of duplicate arms the first by `order` stays."""
    one = df.where(F.col(arm).isin(a, b)).dropna(subset=pair_by)
    first = one.groupBy(*pair_by, arm).agg(F.min_by(value, order).alias("_v"))
    sides = first.groupBy(*pair_by).agg(F.max(F.when(F.col(arm) == a, F.col("_v"))).alias("value_a"), F.max(F.when(F.col(arm) == b, F.col("_v"))).alias("value_b"))
    return sides.where("value_a IS NOT NULL AND value_b IS NOT NULL").withColumn("delta", F.col("value_b") - F.col("value_a"))


def star(df: DataFrame, group: list[str], arm: str, baseline: str, values: list[str], order: list[str] | None = None, last: bool = False) -> DataFrame:
    """Each other arm beside the group's baseline; groups without one are left out.

    The baseline is one row: of several the first by `order` (by its values where there is none), or the last. Its values are never taken from two rows.
    """
    pick = F.max_by if last else F.min_by
    base = df.where(F.col(arm) == baseline).groupBy(*group).agg(pick(F.struct(*values), F.struct(*(order or values))).alias("_base"))
    return df.where(F.col(arm) != baseline).join(base, group).select("*", *[F.col(f"_base.{v}").alias(f"base_{v}") for v in values]).drop("_base")


def all_pairs(df: DataFrame, group: list[str], key: str, values: list[str]) -> DataFrame:
    """Pairs a < b inside each group of named rows: as many as the question asks for."""
    left = df.select(*group, F.col(key).alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    right = df.select(*group, F.col(key).alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, group).where("a < b")


def complete(df: DataFrame, unit: str, parts: list[str]) -> DataFrame:
    """Rows of the units that have every combination of parts seen anywhere."""
    need = df.select(*parts).distinct().agg(F.count("*").alias("_need"))
    have = df.groupBy(unit).agg(F.count_distinct(*parts).alias("_have"))
    return df.join(have.join(F.broadcast(need), F.col("_have") == F.col("_need")).select(unit), unit, "left_semi")


def refuse_ambiguous(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is theirs alone, and the ambiguous keys with their counts."""
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    alone = same(df, counts.where("n = 1").drop("n"), key, "left_semi")
    return alone, counts.where("n > 1")


def nearest(df: DataFrame, group: list[str], arm: str, asking: str, baseline: str, key: str, value: str) -> DataFrame:
    """Each row of the asking arm with base_key of the baseline row of its group whose value is nearest, and off = value - its value.

    The baseline's rows of a group are a ladder of few rungs: one array in each asking row, no pairs are made.
    """
    ladder = df.where(F.col(arm) == baseline).groupBy(*group).agg(F.collect_list(F.struct(F.col(value).alias("v"), F.col(key).alias("k"))).alias("_l"))
    best = F.array_min(F.transform("_l", lambda x: F.struct(F.abs(x["v"] - F.col(value)).alias("d"), x["k"].alias("k"), x["v"].alias("v"))))
    return df.where(F.col(arm) == asking).join(ladder, group).withColumn("_b", best).withColumn(f"base_{key}", F.col("_b.k")).withColumn("off", F.col(value) - F.col("_b.v")).drop("_l", "_b")


def linked(df: DataFrame, key: list[str], arm: str, asking: str, baseline: str, values: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the asking arm beside the baseline of the same key, and (reason, n) of those without one.

    The key names the target the asking run aimed at and its resolution, so a run is held against the baseline at its own target. A key with null
    parts matches nothing and counts as no_key; one without a baseline as no_baseline. Of several baselines the first by `order` counts.
    """
    ask = df.where(F.col(arm) == asking)
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    base = df.where(F.col(arm) == baseline).groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_base"))
    both = ask.join(base, key, "left")
    reason = F.when(~whole, "no_key").when(F.col("_base").isNull(), "no_baseline")
    found = both.where(whole & F.col("_base").isNotNull()).select("*", *[F.col(f"_base.{v}").alias(f"base_{v}") for v in values]).drop("_base")
    return found, both.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def by_keys(docs: DataFrame, doc: str, pair: dict[str, str], arm: dict[str, str], value: dict[str, str]) -> DataFrame:
    """Columns named by dotted keys of documents: pair keys and the arm as text, values as numbers. Rows that lack a pair key are left out."""
    text = [F.try_variant_get(doc, f"$.{path}", "string").alias(n) for n, path in {**pair, **arm}.items()]
    return docs.select(*text, *[F.try_variant_get(doc, f"$.{path}", "double").alias(n) for n, path in value.items()]).dropna(subset=list(pair))
