"""Schemaless documents: tolerant parsing, flattening to narrow rows, keep-latest upserts, citability, a tree scan."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.scalar import percent_of

#: Foreground metrics that the citable view does not show.
VIEW_BANNED = ["lpips_mean", "dists_mean", "fid_fg_bbox", "fvmd"]


def scan_tree(spark: SparkSession, folder: str, name: str = "result.json") -> DataFrame:
    """key (the folder's name), doc_raw and modified of each document below folder.

    A tree of export_tree() is read back by the name part-*: there the key stands after key= in the folder's name, and
    the last line feed is none of the document. Keys that start with _ or . are skipped.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True)
    own = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    ours = own.startswith("key=")
    key, raw = F.when(ours, F.url_decode(F.substring(own, F.lit(5), F.length(own)))).otherwise(own), F.when(ours, F.regexp_replace("value", "\n\\z", "")).otherwise(F.col("value"))
    return found.select(key.alias("key"), raw.alias("doc_raw"), F.col("_metadata.file_modification_time").alias("modified")).where(~F.col("key").rlike("^[_.]"))


def list_tree(spark: SparkSession, folder: str, name: str = "result.json") -> DataFrame:
    """key (the folder's name), path, modified and length of each document below folder: from the listing alone, no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    own = F.url_decode(F.element_at(F.split("path", "/"), -2))
    key = F.when(own.startswith("key="), F.url_decode(F.substring(own, F.lit(5), F.length(own)))).otherwise(own)
    return found.select(key.alias("key"), "path", F.col("modificationTime").alias("modified"), "length").where(~F.col("key").rlike("^[_.]"))


def read_listed(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """key, doc_raw, modified and path of listed files; only these are opened. Their paths pass the driver, which has listed them for Spark before."""
    paths = [r["path"] for r in listed.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "key string, doc_raw string, modified timestamp, path string")
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc_raw"), F.col("_metadata.file_modification_time").alias("modified"))
    own = F.url_decode(F.element_at(F.split("path", "/"), -2))
    ours = own.startswith("key=")
    key = F.when(ours, F.url_decode(F.substring(own, F.lit(5), F.length(own)))).otherwise(own)
    return text.select(key.alias("key"), F.when(ours, F.regexp_replace("doc_raw", "\n\\z", "")).otherwise(F.col("doc_raw")).alias("doc_raw"), "modified", "path")


def refreshed(spark: SparkSession, folder: str, known: DataFrame, name: str = "result.json", key: str = "key", modified: str = "modified") -> DataFrame:
    """Documents below folder that `known` (key, modified) lacks or has an older version of: listed, held against it, and only then read."""
    return read_listed(spark, fresh(list_tree(spark, folder, name), known.select(F.col(key).alias("key"), F.col(modified).alias("modified"))))


def reports(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """place (the folder below root), name, doc_raw and modified of each file at any depth whose name fits the pattern, in the order of their paths."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    below = F.regexp_extract(path, "^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/(.*)$", 1)
    name = F.element_at(F.split(below, "/"), -1)
    return found.select(F.rtrim(F.substring(below, F.lit(1), F.length(below) - F.length(name)), F.lit("/")).alias("place"), name.alias("name"), F.col("value").alias("doc_raw"), F.col("_metadata.file_modification_time").alias("modified")).orderBy("place", "name")


def resolved(docs: DataFrame, field: str = "experiment_hash", key: str = "key", key_from: str = "document") -> DataFrame:
    """docs with their key resolved: the text that the parsed document has in `field`, else the folder's name; with key_from="folder" always the latter.

    A field that is empty or holds no text counts as none. Of documents that resolve to one key the last modified stays, of equals the one
    whose folder has that name, then the least folder; folder has the name it was found under.
    """
    if key_from not in ("document", "folder"):
        raise ValueError("key_from is document or folder")
    held = F.variant_get("doc", f"$.{field}", "variant")
    own = F.when(_kind(held) == "STRING", F.nullif(F.try_variant_get("doc", f"$.{field}", "string"), F.lit(""))) if key_from == "document" else F.lit(None).cast("string")
    named = docs.withColumnRenamed(key, "folder").withColumn(key, F.coalesce(own, "folder"))
    first = F.struct(F.col("modified"), F.col("folder") == F.col(key))
    best = named.groupBy(key).agg(F.max(first).alias("_best"))
    newest = named.join(best, key).where(first == F.col("_best"))
    least = newest.groupBy(key).agg(F.min("folder").alias("_least"))
    return newest.join(least, key).where(F.col("folder").eqNullSafe(F.col("_least"))).drop("_best", "_least")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed one time for each row: as the output of a generator it is not written into the filters and columns that use it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def parsed(docs: DataFrame, raw: str = "doc_raw") -> tuple[DataFrame, DataFrame]:
    """docs with doc (variant), and the corrupt ones. Bare non-finite numbers become null before parsing; strings stay as they are."""
    # what stands before a number outside of strings is matched without going back and put back: texts that are neither, whole strings, single characters
    token = r"(?<=[:\[,\s])(?:NaN|-?Infinity)(?=\s*[,}\]])"
    before = r'\G((?:[^"NI\-]++|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|(?!' + token + r')[NI\-"])*+)'
    text = F.col(raw)
    clean = F.regexp_replace(text, before + token, "$1null")
    all_ = once(docs, "doc", F.try_parse_json(F.when(F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity")), clean).otherwise(text)))
    return all_.where(F.col("doc").isNotNull()), all_.where(F.col("doc").isNull()).drop("doc")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _number_kind(kind: Column | str) -> Column:
    return F.coalesce((F.col(kind) if isinstance(kind, str) else kind).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def _fields(v: Column, path: str = "$") -> Column:
    """An object's fields as a map; of another value, none."""
    return F.try_variant_get(v, path, "map<string,variant>")


def _made(root: DataFrame, step: Callable[[DataFrame], DataFrame], levels: int = 5) -> DataFrame:
    """(_key, _row) of all that step makes of (_key, _at, _m, _row) over and over, _m the fields of an object still to be opened.

    Some levels are one pass over the documents, which is written with what is left; objects deeper than that go through it again.
    """
    level, out = root.where(F.col("_m").isNotNull()), None
    while True:
        for _ in range(levels):
            level = step(level)
        level = written(level)
        rows = level.where(F.col("_row").isNotNull()).select("_key", "_row")
        out = rows if out is None else out.unionByName(rows)
        level = level.where(F.col("_m").isNotNull())
        if level.isEmpty():
            return out


def metric_rows(docs: DataFrame, key: str, path: str = "$.metrics") -> DataFrame:
    """(key, region, metric, value) of the numbers under path.

    An object without objects in it is a region, named by its dotted path; a number beside objects has region '' and its
    dotted path as metric. Booleans are no numbers, block_level is left out; objects nest to any depth.
    """
    row = lambda region, metric, v: F.struct(region.alias("region"), metric.alias("metric"), v.cast("double").alias("value"))
    none = F.lit(None).cast("struct<region:string,metric:string,value:double>")
    no_fields = F.lit(None).cast("map<string,variant>")
    state = lambda at, m, r: F.struct(at.alias("_at"), m.alias("_m"), r.alias("_row"))

    def step(level: DataFrame) -> DataFrame:
        field = lambda at, v, m, r: F.struct(at.alias("_at"), v.alias("_v"), m.alias("_m"), r.alias("_row"))
        entries = F.filter(F.map_entries("_m"), lambda e: e["key"] != "block_level")
        opened = F.transform(entries, lambda e: field(F.concat("_at", e["key"]), e["value"], _fields(e["value"]), none))
        done = F.array(field(F.lit(None).cast("string"), F.lit(None).cast("variant"), no_fields, F.col("_row")))
        each = level.select("_key", F.inline(F.when(F.col("_m").isNotNull(), opened).otherwise(done)))
        deep = F.exists(F.map_values("_m"), lambda v: _fields(v).isNotNull())
        numbers = F.filter(F.map_entries("_m"), lambda e: _number_kind(_kind(e["value"])))
        gone = F.lit(None).cast("string")
        made = (
            F.when(F.col("_row").isNotNull(), F.array(state(gone, no_fields, F.col("_row"))))
            .when(F.col("_m").isNotNull(), F.when(deep, F.array(state(F.concat("_at", F.lit(".")), F.col("_m"), none))).otherwise(F.transform(numbers, lambda e: state(gone, no_fields, row(F.col("_at"), e["key"], e["value"])))))
            .when(_number_kind(_kind(F.col("_v"))), F.array(state(gone, no_fields, row(F.lit(""), F.col("_at"), F.col("_v")))))
        )
        return each.select("_key", F.inline(made))

    root = docs.select(F.col(key).alias("_key"), F.lit("").alias("_at"), F.explode(F.array(_fields(F.col("doc"), path))).alias("_m"), none.alias("_row"))
    return _made(root, step).select(F.col("_key").alias(key), "_row.*")


def artifact_rows(docs: DataFrame, key: str, videos: tuple[str, ...] = ("output_video", "transmitted_video")) -> DataFrame:
    """(key, kind, relpath, shape): the block matrices that metrics.block_level points to, and the named videos; empty paths are none."""
    row = lambda kind, relpath, shape: F.struct(kind.alias("kind"), relpath.alias("relpath"), shape.alias("shape"))
    blocks = F.transform(F.map_entries(_fields(F.col("doc"), "$.metrics.block_level")), lambda e: row(F.concat(F.lit("block_"), e["key"]), F.try_variant_get(e["value"], "$.path", "string"), F.to_json(F.try_variant_get(e["value"], "$.shape", "variant"))))
    named = F.array(*[row(F.lit(v), F.try_variant_get("doc", f"$.{v}", "string"), F.lit(None).cast("string")) for v in videos])
    return docs.select(F.col(key), F.inline(F.concat(F.coalesce(blocks, F.array().cast("array<struct<kind:string,relpath:string,shape:string>>")), named))).where("relpath <> ''")


def derived_levels(docs: DataFrame, key: str) -> DataFrame:
    """(key, level, name, value): the metric rows and the artifact rows of each document in one table."""
    metrics = metric_rows(docs, key).select(key, F.lit("metric").alias("level"), F.concat_ws(".", F.nullif("region", F.lit("")), "metric").alias("name"), F.col("value").cast("string").alias("value"))
    return metrics.unionByName(artifact_rows(docs, key).select(key, F.lit("artifact").alias("level"), F.col("kind").alias("name"), F.col("relpath").alias("value")))


def flat_rows(docs: DataFrame, key: str, whole: tuple[str, ...] = ("metrics_block_level",)) -> DataFrame:
    """(key, path, value, kind): every value of a document under its names joined by _; a list gives its length under _n
    and its text under _json, an object named in whole its text under _json."""
    none, no_fields, gone = F.lit(None).cast("struct<path:string,value:string,kind:string>"), F.lit(None).cast("map<string,variant>"), F.lit(None).cast("string")
    state = lambda at, m, r: F.struct(at.alias("_at"), m.alias("_m"), r.alias("_row"))
    done = lambda path, value, k: state(gone, no_fields, F.struct(path.alias("path"), value.alias("value"), k.alias("kind")))

    def step(level: DataFrame) -> DataFrame:
        field = lambda at, v, m, k, r: F.struct(at.alias("_at"), v.alias("_v"), m.alias("_m"), k.alias("_t"), r.alias("_row"))

        def opened(e: Column) -> Column:
            m = _fields(e["value"])
            return field(F.concat_ws("_", F.nullif(F.col("_at"), F.lit("")), e["key"]), e["value"], m, F.when(m.isNull(), _kind(e["value"])), none)

        kept = F.array(field(gone, F.lit(None).cast("variant"), no_fields, gone, F.col("_row")))
        each = level.select("_key", F.inline(F.when(F.col("_m").isNotNull(), F.transform(F.map_entries("_m"), opened)).otherwise(kept)))
        size = F.size(F.try_variant_get("_v", "$", "array<variant>")).cast("string")
        text = done(F.concat("_at", F.lit("_json")), F.to_json("_v"), F.lit("STRING"))
        made = (
            F.when(F.col("_row").isNotNull(), F.array(state(gone, no_fields, F.col("_row"))))
            .when(F.col("_at").isin(*whole), F.array(text))
            .when(F.col("_m").isNotNull(), F.array(state(F.col("_at"), F.col("_m"), none)))
            .when(F.coalesce(F.col("_t").startswith("ARRAY"), F.lit(False)), F.array(done(F.concat("_at", F.lit("_n")), size, F.lit("BIGINT")), text))
            .otherwise(F.array(done(F.col("_at"), F.try_variant_get("_v", "$", "string"), F.regexp_replace("_t", r"\(.*|VOID", ""))))
        )
        return each.select("_key", F.inline(made))

    root = docs.select(F.col(key).alias("_key"), F.lit("").alias("_at"), F.explode(F.array(_fields(F.col("doc")))).alias("_m"), none.alias("_row"))
    return _made(root, step).select(F.col("_key").alias(key), "_row.path", "_row.value", F.nullif("_row.kind", F.lit("")).alias("kind"))


def wide(flat: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """flat_rows() with a column for each of paths."""
    return flat.where(F.col("path").isin(*paths)).groupBy(key).agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(p) for p in paths])


def union_schema(flat: DataFrame, key: str) -> DataFrame:
    """path, kind: all columns, each typed by its first value that is not null in the order of the keys, STRING without one."""
    seen = flat.groupBy("path", "kind").agg(F.min(F.when(F.col("value").isNotNull(), F.col(key))).alias("_first"), F.count("value").alias("n"))
    by = seen.groupBy("path").agg(F.min_by(F.when(F.col("_first").isNotNull(), F.col("kind")), F.when(F.col("_first").isNotNull(), F.struct("_first", "kind"))).alias("kind"), F.sum("n").alias("n"))
    return by.withColumn("kind", F.coalesce("kind", F.lit("STRING")))


def canonical(doc: Column) -> Column:
    """One text for equal documents: keys of every object are sorted by the variant encoding itself."""
    return F.to_json(doc)


def matching(runs: DataFrame, where: str, key: str = "hash") -> DataFrame:
    """Runs that satisfy an expression, in the order of their key."""
    return runs.where(where).orderBy(key)


def provenance(result: DataFrame, runs: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """result with the identity of the run that each row's key names; found tells whether there is one."""
    known = runs.select(F.col(key).alias("_key"), F.struct(*identity).alias("run"))
    return result.join(known, F.col(key) == F.col("_key"), "left").withColumn("found", F.col("_key").isNotNull()).drop("_key")


def save(df: DataFrame, path: str, form: str) -> None:
    """Result sinks by name: csv, tsv (both with a header), json (a line for each row) or parquet."""
    if form in ("csv", "tsv"):
        df.write.option("header", True).option("sep", "," if form == "csv" else "\t").csv(path)
    elif form in ("json", "parquet"):
        getattr(df.write, form)(path)
    else:
        raise ValueError(f"unknown format {form}: use csv, tsv, json or parquet")


def payload(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def save_blocks(df: DataFrame, path: str, run: str) -> None:
    """Block table in columns, a folder for each run."""
    df.write.partitionBy(run).parquet(path)


def frame_log(spark: SparkSession, path: str, percents: list[str]) -> DataFrame:
    """Rows of a log whose header and cells are padded and whose percent columns end in %."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return named.select(*[(percent_of(F.col(c)) if c in percents else F.trim(c)).alias(c) for c in named.columns])


def first_of(runs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first run of each group."""
    return runs.groupBy(*group).agg(F.min_by(F.struct(*[c for c in runs.columns if c not in group]), F.struct(*order)).alias("_r")).select(*group, "_r.*")


def replayable(runs: DataFrame, artifacts: DataFrame, key: str, group: list[str], needs: list[str]) -> DataFrame:
    """Of each group the first run (by key) that has artifacts of all the needed kinds."""
    have = artifacts.where(F.col("kind").isin(*needs)).groupBy(key).agg(F.count_distinct("kind").alias("_n")).where(F.col("_n") == len(set(needs)))
    return first_of(runs.join(have.select(key), key, "left_semi"), group, [key])


def keep_latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last row of each key by version: max_by combines before the shuffle, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*key, "_r.*")


def citable(runs: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Runs without a recorded failure (none recorded counts as none) that have metrics."""
    clear = runs.where(F.coalesce(F.size("invariant_failures"), F.lit(0)) <= 0)
    return clear.join(metrics.select(key).distinct(), key, "left_semi")


def foreground(citable_metrics: DataFrame) -> DataFrame:
    return citable_metrics.where((F.col("region") == "foreground") & ~F.col("metric").isin(*VIEW_BANNED))


def by_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The one row whose key starts with prefix; none or several raise an error when the query runs."""
    found = df.where(F.col(key).startswith(prefix)).limit(2)
    rows = found.agg(F.collect_list(F.struct(*df.columns)).alias("_r"))
    said = F.when(F.size("_r") == 0, F.lit(f"nothing starts with {prefix}")).otherwise(F.lit(f"prefix {prefix} is ambiguous"))
    one = F.when(F.size("_r") == 1, F.get("_r", F.lit(0))).otherwise(F.raise_error(said).cast(found.select(F.struct(*df.columns)).schema[0].dataType))
    return rows.select(one.alias("_o")).select("_o.*")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder. A session of one machine that has none gets one here; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tarn-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the session's shared checkpoint folder: cuts the lineage, and a lost executor costs only its own task."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all in it, wherever Spark's file system is; one that is not there is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def export_tree(docs: DataFrame, folder: str, key: str = "key", raw: str = "doc_raw") -> None:
    """Writes each document's text and a line feed into a folder of its key."""
    docs.select(F.col(key).alias("key"), F.col(raw).alias("value")).write.partitionBy("key").text(folder)


def exported(spark: SparkSession, folder: str) -> DataFrame:
    """key and doc_raw of a written tree, byte for byte what was exported; scan_tree() reads it too, by name part-*."""
    found = spark.read.schema("value string, key string").text(folder, wholetext=True)
    return found.select("key", F.regexp_replace("value", "\n\\z", "").alias("doc_raw"))


def fresh(found: DataFrame, known: DataFrame, key: str = "key", modified: str = "modified") -> DataFrame:
    """Documents that the store does not have, or has an older version of."""
    old = known.groupBy(key).agg(F.max(modified).alias("_old"))
    return found.join(old, key, "left").where(F.col("_old").isNull() | (F.col(modified) > F.col("_old"))).drop("_old")


def block_matrix(spark: SparkSession, path: str, blocks_wide: int) -> DataFrame:
    """frame, by, bx, value of a matrix file: after a header a line for each block, a column for each frame."""
    line = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\r?\n")).alias("_b", "_line")).where("_b > 0")
    cell = line.select((F.col("_b") - 1).alias("_b"), F.posexplode(F.split("_line", ",")).alias("frame", "_v"))
    return cell.select("frame", F.floor(F.col("_b") / blocks_wide).cast("int").alias("by"), (F.col("_b") % blocks_wide).alias("bx"), F.trim("_v").try_cast("double").alias("value"))


def attributes(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows of status ok of an attribute file with a header; a missing column is an error."""
    df = spark.read.option("header", True).csv(path)
    missing = sorted({*required, "status"} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.where("status = 'ok'")


def sets_of(spark: SparkSession, path: str) -> DataFrame:
    """set, hash of a definition file: an object of named lists."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("set", "_h")).select("set", F.explode("_h").alias("hash"))


def specs(docs: DataFrame, filters: dict[str, str], doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Planned rows whose keys equal the filters as text and that are not retired, and the retired ones counted by reason."""
    kept = docs
    for k, v in filters.items():
        kept = kept.where(F.try_variant_get(doc, f"$.{k}", "string") == v)
    retired = F.try_variant_get(doc, "$.retired", "string")
    return kept.where(retired.isNull()), kept.where(retired.isNotNull()).groupBy(retired.alias("reason")).agg(F.count("*").alias("n"))
