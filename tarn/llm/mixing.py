"""Mixing sources to target weights by capped water-filling.

A source's target is least(cap, level * weight): sources whose share passes `max_epochs` times their size are
clamped there and the excess goes to the others by weight until none is above. A target is reached by whole
repetitions of all documents of the source and a fractional one: documents in a seeded hash order until the
remaining words are used up, the last of them in part.

Null texts have size 0; null sources are a source of their own, the last; rows that agree in doc_id and text get
the same words (the part of the last is shared among them); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED, written

#: Hash buckets of a source: only the bucket in which the words run out is sorted.
BUCKET_HEX = 3
#: Sources up to this number are broadcast.
BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """The columns that mixing needs: one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.col("source").alias("source"),
        F.regexp_count(text, F.lit(SPACED)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.md5(text))).alias("_order"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, source_size, weight, target: a row for each source.

    Weights go by the source's place in code-point order. The level is raised from the share of all sources until
    no more are clamped; each step is a sum over the sources of which one row reaches the driver.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = written(by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))))
    cap = F.col("source_size") * max_epochs
    level, total = 0.0, None
    while True:
        clamped = cap <= level * F.col("weight")
        r = by.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        total = r["all"] or 0
        new = (total - r["capped"]) / r["free"] if r["free"] else level
        if new <= level:
            break
        level = new
    return by.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, taken and _order (the row's seeded hash) of each row of docs."""
    sized = written(sizes(docs, seed))
    goal = targets(sized, weights, max_epochs).select(
        F.col("source").alias("_s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long").alias("_whole"),
    ).withColumn("_part", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    few = goal.count() <= BROADCAST_SOURCES
    # words of each hash bucket, and of those before it: tells which bucket the fractional repetition ends in
    bucket = F.substring("_order", 1, BUCKET_HEX)
    sums = sized.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")) - F.col("_n"))
    ends = (
        before.join(goal, F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("_before") < F.col("_part")) & (F.col("_part") <= F.col("_before") + F.col("_n")))
        .select(F.col("source").alias("_s"), F.col("_b").alias("_end"), (F.col("_part") - F.col("_before")).alias("_rest"))
    )
    plan = goal.join(ends.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2")
    # a source may hold a third of the rows: a small plan goes to all tasks, a large one is joined and its hot keys split
    rows = sized.withColumn("_b", bucket).join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.col("_whole") * F.col("size")
    inner = rows.where(~F.coalesce(F.col("_b") == F.col("_end"), F.lit(False))).withColumn(
        "taken", whole + F.when(F.col("_b") < F.col("_end"), F.col("size")).otherwise(0)
    )
    w = Window.partitionBy("source", "_b").orderBy("_order")
    edge = (
        rows.where(F.col("_b") == F.col("_end"))
        .withColumn("_alike", F.count("*").over(Window.partitionBy("source", "_b", "_order")))
        .withColumn("_ahead", F.sum("size").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") * F.col("_alike"))
        .withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), F.floor((F.col("_rest") - F.col("_ahead")) / F.col("_alike")))))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "_order"]
    return inner.select(*columns).unionByName(edge.select(*columns))


def repeat_documents(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """docs with each row repeated as mixing says, the last repetition cut to the words taken; rows without any go."""
    plan = mix(docs, seed=seed).select(F.col("_order").alias("_tarn_o"), F.col("taken").alias("_tarn_t"), F.col("size").alias("_tarn_n")).dropDuplicates(["_tarn_o"])
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.md5(text)))
    left = F.col("_tarn_t") - F.col("_tarn_k") * F.col("_tarn_n")
    # the first `left` words, a space between them
    cut = F.when(left >= F.col("_tarn_n"), F.col("text")).otherwise(F.call_function("substring_index", F.ltrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), F.lit(" "), left.cast("int")))
    return (
        docs.withColumn("_tarn_o", order)
        .join(plan.where("_tarn_t > 0"), "_tarn_o")
        .withColumn("_tarn_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_tarn_t") / F.col("_tarn_n")).cast("int") - 1)))
        .withColumn("text", cut)
        .select(*docs.columns)
    )
