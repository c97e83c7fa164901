"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of shingles (three words; fewer in a window of fewer) to be contained: a document span
matches a window only if it holds all its shingles, so one necessary shingle, the rarest over all documents, is the
window's whole prefix. Places of documents whose shingle is a prefix are joined with its windows; positional bounds
(the window must fit into the text at that offset) and the exact comparison of the words follow.

Windows of the same words are one, whose items are looked up after the match. Null and empty texts have no words;
items without words have no windows; an item of fewer than `window` words is one window; items that repeat an
item_id count once, those without an item_id as one, which n_items counts and items_sha256 does not name; rows of documents
that repeat each give a row; whole texts are compared, however long; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_array, written

SHINGLE = 3
#: Rows, and bytes of their strings, up to which the benchmark's shingles, its windows and the numbers of likely rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000


def small(df: DataFrame) -> DataFrame:
    """df with the hint how to join it. Left to itself Spark goes by the size of the written files, where repeated strings take a small part of what they take in the driver."""
    strings = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0).cast("long"))
    n, size = df.select(F.count(F.lit(1)), F.coalesce(F.sum(strings), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df.hint("merge")


def shingles(w: Column, k: int) -> Column:
    """pos, tok: each place of k words of an array, and a hash of them."""
    n = F.greatest(F.lit(0), F.size(w) - (k - 1))
    return F.transform(F.slice(w, 1, n), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), x, *[F.get(w, i + j) for j in range(1, k)]).alias("tok")))


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, g (the words, a space between them), w (the words): the distinct windows of each item."""
    words = benchmark.select("item_id", word_array(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    n = F.size("_w")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))).alias("_i")
    cut = words.select("item_id", "_w", at).select("item_id", F.slice("_w", F.col("_i"), window).alias("w"))
    return cut.select("item_id", F.concat_ws(" ", "w").alias("g"), "w").distinct()


def prefixes(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """g, size, tok (the rarest shingle by counts) and at (its first place, from 0) of each window of g, size, parts."""
    places = wins.select("g", "size", F.explode("parts").alias("_p")).select("g", "size", "_p.*").join(counts, "tok", "left")
    least = places.groupBy("g", "size").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "tok", "pos")).alias("_m"))
    return least.select("g", "size", "_m.tok", F.col("_m.pos").alias("at"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    # rows are numbered once, in a table: a number made again in another scan could be another one
    base = written(docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", word_array(F.col("text")).alias("_w")).withColumn("n_words", F.size("_w").cast("long")))
    of_items = written(windows(benchmark, window))
    sized = of_items.select("g", "w").distinct().withColumn("size", F.size("w"))
    parts = F.when(F.col("size") >= SHINGLE, shingles(F.col("w"), SHINGLE))
    for k in range(1, SHINGLE):
        parts = F.when(F.col("size") == k, shingles(F.col("w"), k)).otherwise(parts)
    wins = written(sized.select("g", "size", parts.alias("parts")))
    lengths = sorted(r[0] for r in wins.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE rows

    tokens = F.concat(*[shingles(F.col("_w"), k) for k in lengths]) if lengths else F.array().cast("array<struct<pos:int,tok:bigint>>")
    wanted = written(wins.select(F.explode("parts.tok").alias("tok")).distinct())
    hits = written(base.select("_rid", F.explode(tokens).alias("_t")).select("_rid", "_t.*").join(small(wanted), "tok", "left_semi"))
    chosen = written(prefixes(wins, hits.groupBy("tok").count()))
    cands = hits.join(small(chosen), "tok").select("_rid", (F.col("pos") - F.col("at")).alias("start"), "size", "g").where("start >= 0")
    per = written(cands.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "size", "g"))).alias("_c")))
    # the words of rows without a candidate stay where they are
    likely = base.join(small(per.select("_rid")), "_rid", "left_semi")

    fits = lambda c: (c["start"] + c["size"] <= F.col("n_words")) & (F.array_join(F.slice("_w", c["start"] + 1, c["size"]), " ") == c["g"])
    # words of a span that no earlier span covers
    cover = F.aggregate(
        "_m", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda s, c: F.struct(F.greatest(s["end"], c["start"] + c["size"]).alias("end"), (s["hit"] + F.greatest(F.lit(0), c["start"] + c["size"] - F.greatest(c["start"], s["end"]))).alias("hit")),
    )["hit"]
    # the candidates grow with docs and never go through the driver
    found = written(
        likely.join(per.hint("merge"), "_rid").select("_rid", F.filter("_c", fits).alias("_m")).where(F.size("_m") > 0).select("_rid", cover.cast("long").alias("n_hit"), F.array_distinct(F.transform("_m", lambda c: c["g"])).alias("_g"))
    )
    items = (
        found.select("_rid", "n_hit", F.explode("_g").alias("g")).join(small(of_items.select("g", "item_id")), "g").groupBy("_rid", "n_hit").agg(F.collect_set(F.struct(F.col("item_id").cast("string").alias("i"))).alias("_i"))
        .select("_rid", "n_hit", F.size("_i").cast("long").alias("n_items"), F.concat_ws(",", F.array_sort(F.array_compact(F.transform("_i", lambda x: x["i"])))).alias("_said"))
    )
    out = base.select("_rid", "doc_id", "n_words").join(items, "_rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("_said", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """docs without the contaminated rows. A row's verdict goes by its text, so the texts' hashes link both."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    judged = contamination(docs.select(F.struct("doc_id", th.alias("th")).alias("doc_id"), "text"), benchmark, window, share)
    bad = judged.where("contaminated").select(F.col("doc_id.doc_id").alias("_tarn_id"), F.col("doc_id.th").alias("_tarn_th")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_tarn_id")) & (th == F.col("_tarn_th")), "left_anti")
