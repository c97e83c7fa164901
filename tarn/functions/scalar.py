"""Column functions: exact tests on counts, unit conversions, names, hashes. Nulls in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_test_p(n_pos: Column, n_neg: Column) -> Column:
    """Exact two-tailed sign test: twice the lower binomial tail, 1 at most; 1 without informative pairs.

    Terms go from one to the next in logarithms, so large counts do not underflow.
    """
    n, k = (n_pos + n_neg).cast("int"), F.least(n_pos, n_neg).cast("int")
    start = F.struct((n * -F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        log = F.when(i == 0, s["log"]).otherwise(s["log"] + F.log(((n - i + 1) / F.greatest(i, F.lit(1))).cast("double")))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), k), start, add)["sum"]))


def sign_test_floor(n: Column) -> Column:
    """The least p that n informative pairs can reach."""
    return F.least(F.lit(1.0), 2 / F.pow(F.lit(2.0), n))


def pairs_needed(alpha: float, family: int = 1, most: int = 64) -> int:
    """Fewest unanimous pairs whose corrected p is at most alpha, or most + 1."""
    return next((n for n in range(1, most + 1) if min(1.0, 2 / 2**n) * family <= alpha + 1e-12), most + 1)


def psnr(mse: Column) -> Column:
    return 10 * F.log10(255.0**2 / F.greatest(mse, F.lit(1e-12)))


def throughput(frames: Column, seconds: Column) -> Column:
    return F.try_divide(frames, F.nullif(seconds, F.lit(0.0)))


def dataset_of(name: Column) -> Column:
    """What stands before the first slash, else davis."""
    return F.when(F.instr(name, "/") > 0, F.split_part(name, F.lit("/"), F.lit(1))).otherwise(F.lit("davis"))


def content_hash(pairs: Column) -> Column:
    """16 hex digits over sorted (key, value) structs, without the key hash and keys that start with an underscore."""
    kept = F.filter(pairs, lambda x: (x["key"] != "hash") & ~x["key"].startswith("_"))
    return F.substring(F.sha2(canonical(F.array_sort(kept)).cast("binary"), 256), 1, 16)


def shard_of(name: Column, shards: int) -> Column:
    """Stable shard of a key: every key is in one shard."""
    return F.pmod(F.crc32(name.cast("binary")), F.lit(shards))


def percent_of(text: Column) -> Column:
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double")


def slug(text: Column, most: int = 24) -> Column:
    """Lower-case token; a long one is cut and gets a hash of the whole."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9_.-]+", "-")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("-"), F.substring(F.sha1(s.cast("binary")), 1, 8)))


def identity(config: Column, fill: list[str]) -> Column:
    """Canonical text of a map without its fill keys: what two runs share that differ in the fill alone. Null values are told from texts."""
    return canonical(F.array_sort(F.filter(F.map_entries(config), lambda e: ~e["key"].isin(fill))))


def canonical(pairs: Column) -> Column:
    """JSON text of (key, value) structs of texts in the order given: different pairs never give one text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(quoted(e["value"]), F.lit("null")))), ","), F.lit("}"))


def quoted(text: Column) -> Column:
    """A text as a JSON string: backslashes, quotes and control characters escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), out, F.lit('"'))


def rate_control(codec: Column, has_qp: Column, mode: Column, roi: Column, fixed: dict[str, str], degrading: list[str], two_pass: list[str], by_qp: dict[str, str]) -> Column:
    """How an encode was steered. roi comes first: fixed names its modes, degrading ones depend on the codec; then a
    codec of by_qp runs at that mode with a base quantiser; two_pass codecs otherwise take two passes, the rest one."""
    codec, roi = F.lower(F.coalesce(codec, F.lit(""))), F.lower(roi)
    passes = F.when(codec.isin(two_pass), "vbr_2pass").when(codec.isin(list(by_qp)), "vbr_1pass")
    out = F.when(roi.isNull(), None)
    for name, m in fixed.items():
        out = out.when(roi == name, m)
    out = out.when(roi.isin(degrading), F.when(codec == "kvazaar", "vbr_1pass").otherwise("vbr_2pass")).when(roi.isNotNull(), "n/a")
    plain = F.when((codec == "kvazaar") & (has_qp | F.coalesce(mode == "cqp", F.lit(False))), "cqp")
    for name, m in by_qp.items():
        plain = plain.when((codec == name) & has_qp, m)
    return F.coalesce(out, plain, passes, F.lit("n/a"))


def matches(arm: dict[str, list], defaults: dict) -> Column:
    """Every pinned key holds one of its values; a key that is missing has its default."""
    ok = F.lit(True)
    for k, allowed in arm.items():
        c = F.coalesce(F.col(k), F.lit(defaults[k])) if k in defaults else F.col(k)
        ok &= F.coalesce(c.isin(allowed), F.lit(False))
    return ok


def number_of(text: Column) -> Column:
    """true and false as 1 and 0, a list's first number, else the number or null."""
    t = F.lower(F.trim(text))
    first = F.nullif(F.regexp_extract(t, r"^\[[^\]0-9.-]*(-?[0-9.]+)", 1), F.lit(""))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).when(t.startswith("["), first.try_cast("double")).otherwise(t.try_cast("double"))


def classified(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Name of the first rule whose pattern is found."""
    out = F.when(F.lit(False), other)
    for pattern, name in rules:
        out = out.when(F.lower(text).rlike(pattern), name)
    return out.otherwise(other)


def level_of(score: Column, levels: int, selected: Column) -> Column:
    """score in steps, half to even; a selected block has 1 at least, another one 0."""
    return F.when(selected, F.greatest(F.lit(1), F.least(F.lit(levels), F.bround(score * levels).cast("int")))).otherwise(F.lit(0))


def frame_count(length: Column, rate: Column) -> Column:
    return F.when((length > 0) & (rate > 0), length * rate)


def bitrate(sent_bytes: Column, frames: Column, fps: Column) -> Column:
    return F.try_divide(sent_bytes * 8.0, F.try_divide(frames.cast("double"), F.nullif(fps, F.lit(0.0))))


def arm_label(transport: Column, fill: Column) -> Column:
    """transport+fill; a run without a fill is none's."""
    return F.concat_ws("+", transport, F.coalesce(fill, F.lit("none")))


def first_known(*sources: Column) -> Column:
    """The first source with a value, in their order."""
    return F.coalesce(*sources)


def clip_name(path: Column) -> Column:
    """A file's name without its folders, ending and resolution."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(_[0-9]+x[0-9]+)?(\.[a-z0-9]+)?$", "")


def resolution_label(*sizes: tuple[Column, Column], tag: Column | None = None) -> Column:
    """WxH of the first (width, height) that is known, else the tag, else unknown."""
    made = [F.when(w.isNotNull() & h.isNotNull(), F.concat(w.cast("int").cast("string"), F.lit("x"), h.cast("int").cast("string"))) for w, h in sizes]
    return F.coalesce(*made, *([tag] if tag is not None else []), F.lit("unknown"))


def strength(score: Column, unit: float, restorer: Column, caps: dict[str, int], most: int = 1000) -> Column:
    """A score in a restorer's own unit, half to even, at most its cap."""
    cap = F.lit(most)
    for name, c in caps.items():
        cap = F.when(restorer == name, c).otherwise(cap)
    return F.least(F.bround(score * unit).cast("int"), cap)
