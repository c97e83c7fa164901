"""Ranks and exact order statistics of groups of any size.

No task gets a whole group. The distinct values of all groups, with their counts, are dealt to tasks by range of (group, value) and
written as they lie, so that each part of the table holds a stretch of values of one group, or several small groups whole. The
counts of the parts add up to what stands before each part; a rank is then that plus a running count inside the part.
Order statistics count the parts first, locate the part of each rank asked for, and read values of those parts alone.

Null values have no rank and are counted nowhere; null group columns make groups of their own; -0.0 and 0.0 are one value, NaN is
above all numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources.store import written

#: Rows that a task gets at least, if there are as many: parts of small tables would cost more than their rows.
PART_ROWS = 20_000


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, null being equal to null; b's keys go."""
    other = b.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return a.join(other, on, how).drop(*[f"_same_{k}" for k in keys])


def parts(counted: DataFrame, group: list[str], order: list[str | Column], weight: str) -> tuple[DataFrame, DataFrame]:
    """counted as written by range of (group, order), with its part in _part; and (group, _part, _before, _rows, _all): the weights
    before a part of a group, in it, and of the whole group. The latter has a row for each group and one for each part at most.

    counted is written first: its rows give the number of parts, and with it how many rows Spark samples to the driver for their bounds."""
    spark = counted.sparkSession
    counted = written(counted)
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), counted.count() // PART_ROWS + 1)
    keys = [F.col(g) for g in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    laid = written(counted.repartitionByRange(tasks, *keys).withColumn("_part", F.spark_partition_id()))
    sums = laid.groupBy(*group, "_part").agg(F.sum(weight).alias("_rows"))
    by = sums.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_part", "_rows"))).alias("_p"), F.sum("_rows").alias("_all"))
    ahead = F.transform("_p", lambda x, i: F.struct(x["_part"].alias("_part"), F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["_rows"]).alias("_before"), x["_rows"].alias("_rows")))
    return laid, by.select(*group, "_all", F.inline(ahead)).select(*group, "_part", "_before", "_rows", "_all")


def midranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, ties, rank, of): a row for each distinct value of a group, with its rows, their mean rank from 1 on, and the group's rows."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("ties"))
    laid, before = parts(counted, group, [value], "ties")
    inside = F.sum("ties").over(Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = same(laid.withColumn("_in", inside), before, [*group, "_part"])
    return rows.select(*group, value, "ties", (F.col("_before") + F.col("_in") - (F.col("ties") - 1) / 2).alias("rank"), F.col("_all").alias("of"))


def ranked(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """df's rows whose value is known, with their midrank in `name`."""
    ranks = midranks(df, group, value).select(*group, value, F.col("rank").alias(name))
    return same(df.where(F.col(value).isNotNull()), ranks, [*group, value])


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with the number of each row in its group, from 1 on, and the group's rows in _all. Rows that order cannot tell apart are numbered as they lie."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    held = df.withColumns({f"_o{i}": c for i, c in enumerate(keys)}).withColumn("_one", F.lit(1).cast("long"))
    names = [f"_o{i}" for i in range(len(keys))]
    laid, before = parts(held, group, names, "_one")
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*names))
    rows = same(laid.withColumn("_in", inside), before, [*group, "_part"])
    return rows.withColumn(name, F.col("_before") + F.col("_in")).drop(*names, "_one", "_part", "_in", "_before", "_rows")


def spearman(df: DataFrame, group: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(group, n, rho) from midranks over the rows that have both; rho is null under `least` rows or for a constant side.

    Rows of the same pair of values count once with their number; the mean of the ranks, half of n + 1, is known beforehand.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, x, y).agg(F.count("*").alias("_c"))
    weighed = both.withColumns({"_vx": F.col(x), "_vy": F.col(y)}).select(*group, "_vx", "_vy", "_c")
    for side in ("_vx", "_vy"):
        counted = weighed.groupBy(*group, side).agg(F.sum("_c").alias("ties"))
        laid, before = parts(counted, group, [side], "ties")
        inside = F.sum("ties").over(Window.partitionBy(*group, "_part").orderBy(side).rowsBetween(Window.unboundedPreceding, 0))
        ranks = same(laid.withColumn("_in", inside), before, [*group, "_part"])
        rank = (F.col("_before") + F.col("_in") - (F.col("ties") - 1) / 2 - (F.col("_all") + 1) / 2).alias(f"_r{side}")
        weighed = same(weighed, ranks.select(*group, side, rank), [*group, side])
    a, b, c = F.col("_r_vx"), F.col("_r_vy"), F.col("_c")
    sums = weighed.groupBy(*group).agg(F.sum("_c").alias("n"), F.sum(c * a * b).alias("_ab"), F.sum(c * a * a).alias("_aa"), F.sum(c * b * b).alias("_bb"))
    rho = F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb")))
    return sums.select(*group, "n", F.when(F.col("n") >= least, rho).alias("rho"))


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], upper: bool = False) -> DataFrame:
    """(group, n, and a column for each share): exact order statistics of each group's known values.

    A share falls at (n - 1) * share from 0 on; between two values it is read on the line between them, or with `upper` is the later one.
    Groups without a known value are left out.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    laid, before = parts(counted, group, ["_v"], "_n")
    at = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    asked = [F.struct(F.lit(name).alias("_name"), k.cast("long").alias("_k"), F.lit(high).alias("_high")) for name, p in shares.items() for high, k in ((False, F.floor(at(p))), (True, F.ceil(at(p))))]
    # count: parts are small; locate: the part of each rank asked for
    located = before.select("*", F.explode(F.array(*asked)).alias("_q")).select("*", "_q.*").where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_rows"))).drop("_q")
    # refine: running counts in those parts alone
    needed = same(laid, located.select(*group, "_part").distinct(), [*group, "_part"], "left_semi")
    inside = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    running = needed.withColumn("_to", inside)
    # each value meets the few ranks of its own part
    wanted = located.groupBy(*group, "_part", "_before", "_all").agg(F.collect_list(F.struct("_name", "_k", "_high")).alias("_w"))
    found = same(running, wanted, [*group, "_part"]).withColumn("_first", F.col("_before") + F.col("_to") - F.col("_n"))
    hits = found.withColumn("_w", F.filter("_w", lambda w: (w["_k"] >= F.col("_first")) & (w["_k"] < F.col("_first") + F.col("_n")))).where(F.size("_w") > 0)
    each = hits.select(*group, "_all", "_v", F.inline("_w"))
    pick = lambda name, high: F.max(F.when((F.col("_name") == name) & (F.col("_high") == high), F.col("_v")))
    by = each.groupBy(*group, F.col("_all").alias("n")).agg(*[pick(name, high).alias(f"_{name}_{high}") for name in shares for high in (False, True)])
    share = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    low, high = lambda name: F.col(f"_{name}_False"), lambda name: F.col(f"_{name}_True")
    if upper:
        return by.select(*group, "n", *[high(name).alias(name) for name in shares])
    return by.select(*group, "n", *[F.when(low(name) == high(name), low(name).cast("double")).otherwise(low(name) * (1 - share(p)) + high(name) * share(p)).alias(name) for name, p in shares.items()])


def medians(df: DataFrame, group: list[str], values: dict[str, Column | str]) -> DataFrame:
    """(group, and the exact median of each named value): groups keep a row if one value is known; a value that a group lacks is null."""
    named = {n: F.col(v) if isinstance(v, str) else v for n, v in values.items()}
    one = df.select(*group, *[v.cast("double").alias(n) for n, v in named.items()])
    long = one.select(*group, F.inline(F.array(*[F.struct(F.lit(n).alias("_value"), F.col(n).alias("_of")) for n in named])))
    q = quantiles(long, [*group, "_value"], "_of", {"_m": 0.5})
    return q.groupBy(*group).agg(*[F.max(F.when(F.col("_value") == n, F.col("_m"))).alias(n) for n in named])
