"""Personal data by weak-supervision aggregation, in DataFrame functions alone.

Candidate spans come from regexes. Labelers (the pattern's own check, gazetteers, words to the left, the
characters around, the length) vote for, against or not at all. Expectation-maximisation over the counts of vote
patterns, a table whose size the labelers bound, estimates their reliabilities; its posteriors train a
log-linear classifier over span features, which decides on the spans the method adds. Base spans stay.

Null and empty texts have no spans; rows that repeat each give a row; an empty table gives no rows. Offsets are
code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BASE = ("email", "ip", "card", "phone")
#: Candidate patterns. A search never starts inside a run that an earlier start has tried, and runs are possessive:
#: matches are those of the plain patterns, in linear time and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = tuple(PATTERNS)
#: What must stand in a text for its pattern to be tried.
_DIGIT = "[0-9]"
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "person": r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? [A-Z]", "secret": r"(?:[0-9a-f]{32}|[0-9A-F]{32})", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: Country codes of account numbers, first names, ends of mail hosts, country calling codes.
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
FIRST_NAMES = "Adam Alan Albert Alice Amy Andrea Andrew Angela Anna Anne Antonio Barbara Benjamin Bernd Brian Carla Carlos Carmen Caroline Charles Charlotte Chris Christian Christine Claire Claudia Daniel David Diego Dieter Elena Elizabeth Emily Emma Eric Eva Fernando Francisco Frank Gabriel George Hans Helen Helga Henry Isabel Jack Jacques James Jan Jane Javier Jean Jennifer Jessica John Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Laura Linda Lisa Louis Lucia Luis Manuel Marc Maria Marie Mark Martin Mary Matthew Michael Michel Miguel Monika Nancy Nicole Olivia Oliver Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Raul Richard Robert Rosa Ruth Samuel Sandra Sarah Sofia Sophie Stefan Stephen Steven Susan Teresa Thomas Ursula Walter William Wolfgang".split()
MAIL_ENDS = "at au be biz br ca ch cn com cz de dk edu es eu example fi fr gov gr hu ie in info int io it jp kr lu mil mx net nl no nz org pl pt ro ru se test uk us".split()
CALLING_CODES = "1 7 20 27 3[0-469] 35[0-9] 37[0-8] 38[0-9] 4[0-13-9] 42[013] 5[1-8] 50[0-9] 59[0-9] 6[0-6] 67[0-9] 68[0-9] 69[0-2] 8[1-46] 85[0-6] 88[0-8] 9[0-58] 96[0-8] 97[0-7] 99[2-8] 21[1-8] 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] 29[0-9]".split()
#: Gazetteers: what real values of a kind begin with, end in or hold.
GAZETTEER = {
    "email": rf"\.(?:{'|'.join(MAIL_ENDS)})$", "ip": r"^(?!0\.|127\.|255\.)", "card": r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])", "phone": rf"^\+(?:{'|'.join(CALLING_CODES)})",
    "iban": rf"^(?:{'|'.join(IBAN_COUNTRIES)})", "person": rf" (?:{'|'.join(FIRST_NAMES)})\b", "secret": r"(?i)^(?=.*[0-9])(?=.*[a-f])", "ssn": r"^(?!000|666|9)",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|correo|courriel)", "ip": r"(?i)(?:\bip\b|addr|host|server)", "card": r"(?i)(?:card|visa|karte|carte|tarjeta|credit)", "phone": r"(?i)(?:tel|phone|call|fax|mobil)",
    "iban": r"(?i)(?:iban|konto|account|compte|cuenta)", "person": r"(?i)(?:dear|name|by|von|de)\s*$", "secret": r"(?i)(?:token|secret|key|passw|auth|api)\W*$", "ssn": r"(?i)(?:ssn|social)",
}
LENGTHS = {"email": (6, 64), "ip": (7, 15), "card": (13, 23), "phone": (10, 22), "iban": (15, 34), "person": (5, 40), "secret": (32, 128), "ssn": (11, 11)}
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
VOTES = ("check", "gazetteer", "context", "around", "length")
#: Reliabilities to start from, on true and on false spans, and the votes they count for: a checksum knows both; clean
#: sides and a usual length say little, for most false spans have them too.
START = {"check": (0.995, 0.9), "gazetteer": (0.9, 0.5), "context": (0.8, 0.7), "around": (0.95, 0.3), "length": (0.95, 0.3)}
PRIOR_VOTES = 10
#: Known beforehand and not estimated: a true number passes its checksum. Else a kind of many true spans would teach the
#: others to overrule it.
HELD = {("check", 0)}
#: Kinds whose matches can prove themselves; of the others the check says nothing.
CHECKED = ("ip", "card", "phone", "iban", "secret", "ssn")


def _by_kind(make) -> Column:
    """make(kind) of the row's kind."""
    c = F.when(F.col("kind") == KINDS[0], make(KINDS[0]))
    for k in KINDS[1:]:
        c = c.when(F.col("kind") == k, make(k))
    return c


def _matches(text: Column, kind: str) -> Column:
    """Parts of the text from match to match: what comes before the first, then each match with what follows it.

    Matches are put between marks that no pattern takes; a part's plain length gives the offsets.
    """
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{OPEN}$0{CLOSE}"), OPEN)

    def part(p: Column, i: Column) -> Column:
        m = F.when(i > 0, F.substring_index(p, CLOSE, 1))
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), (F.char_length(p) - F.when(i > 0, 1).otherwise(0)).alias("len"), m.alias("m"),
            F.when(i > 0, F.substring(p, F.char_length(m) + 2, F.lit(8))).alias("right"), F.substring(p, F.lit(-24), F.lit(24)).alias("tail"),
        )

    return F.when(text.rlike(GATES[kind]), F.transform(parts, part)).otherwise(F.array().cast("array<struct<kind:string,i:int,len:int,m:string,right:string,tail:string>>"))


def candidates(docs: DataFrame) -> DataFrame:
    """_rid, doc_id and a row for each match of a pattern, or one of null kind: kind, m, start, end, left, right."""
    text = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, OTHER + OTHER)).otherwise(text)
    base = docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", text.alias("_t"))
    found = base.select("_rid", "doc_id", F.explode_outer(F.concat(*[_matches(F.col("_t"), k) for k in KINDS])).alias("_p")).select("_rid", "doc_id", "_p.*")
    w = Window.partitionBy("_rid", "doc_id", "kind").orderBy("i")
    start = F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = found.withColumn("start", start).withColumn("left", F.lag("tail").over(w))
    # rows of i = 0 only carry a length; one per text is kept, for texts without a match
    return placed.where(F.col("kind").isNull() | (F.col("i") >= 0)).select(
        "_rid", "doc_id", F.when(F.col("i") > 0, F.col("kind")).alias("kind"), "m", F.col("start").cast("long").alias("start"), (F.col("start") + F.char_length("m")).cast("long").alias("end"),
        F.coalesce(F.translate("left", OPEN + CLOSE, ""), F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"),
    )


def _digits() -> Column:
    return F.regexp_replace("m", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _iban_rest() -> Column:
    """Rest modulo 97 of the account number: its first four characters moved to the end, letters as 10 to 35."""
    moved = F.split(F.concat(F.substring("m", 5, 64), F.substring("m", 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _check(kind: str) -> Column:
    """The kind's own test of a match."""
    n = F.length(_digits())
    if kind == "ip":
        return F.forall(F.split("m", r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits())).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return _iban_rest() == 1
    if kind == "ssn":
        return ~F.col("m").rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Fa-f]")
    return F.lit(True)


def voted(cands: DataFrame) -> DataFrame:
    """cands with ok (the pattern's check) and a column v_... of -1, 0 or 1 for each labeler."""
    n = F.length("m")
    side = F.substring("left", -1, 1).rlike("[A-Za-z0-9]") | F.substring("right", 1, 1).rlike("[A-Za-z0-9@]")
    return cands.withColumn("ok", _by_kind(_check)).select(
        "*",
        F.when(~F.col("kind").isin(*CHECKED), 0).when(F.col("ok"), 1).otherwise(-1).alias("v_check"),
        F.when(_by_kind(lambda k: F.col("m").rlike(GAZETTEER[k])), 1).otherwise(-1).alias("v_gazetteer"),
        F.when(_by_kind(lambda k: F.col("left").rlike(CONTEXT[k])), 1).otherwise(0).alias("v_context"),
        F.when(side, -1).otherwise(1).alias("v_around"),
        F.when(_by_kind(lambda k: n.between(*LENGTHS[k])), 1).otherwise(-1).alias("v_length"),
    )


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 25) -> tuple[dict, dict, dict]:
    """Posteriors by (kind, votes), each labeler's reliabilities (vote right when true, when false), and each kind's share.

    patterns: (kind, votes, count), at most 3 ** labelers for each kind.
    """
    right = {v: list(START[v]) for v in VOTES}
    share = {k: 0.5 for k, _, _ in patterns}
    post: dict = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            for v, x in zip(VOTES, votes):
                t, f = right[v]
                odds += math.log(t / (1 - f)) if x > 0 else math.log((1 - t) / f) if x < 0 else 0.0
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for i, v in enumerate(VOTES):
            for y in (0, 1):
                if (v, y) in HELD:
                    continue
                told = sum(n * (post[k, p] if y == 0 else 1 - post[k, p]) for k, p, n in patterns if p[i])
                good = sum(n * (post[k, p] if y == 0 else 1 - post[k, p]) for k, p, n in patterns if p[i] == (1 if y == 0 else -1))
                right[v][y] = min(0.99, max(0.05, (good + PRIOR_VOTES * START[v][y]) / (told + PRIOR_VOTES)))
        for k in share:
            n = sum(c for kk, _, c in patterns if kk == k)
            share[k] = min(0.98, max(0.02, (sum(c * post[kk, p] for kk, p, c in patterns if kk == k) + 1) / (n + 2)))
    return post, right, share


def _features() -> Column:
    """Span features, each with its kind: the length, the sides, the digits, the word before."""
    cls = lambda c: F.when(c == "", "none").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")
    digits = F.length(_digits()) / F.greatest(F.length("m"), F.lit(1))
    made = [("length", F.least(F.lit(12), F.floor(F.length("m") / 4)).cast("string")), ("left", cls(F.substring("left", -1, 1))), ("right", cls(F.substring("right", 1, 1))), ("digits", F.floor(digits * 4).cast("string")), ("context", F.col("v_context").cast("string")), ("gazetteer", F.col("v_gazetteer").cast("string")), ("check", F.col("v_check").cast("string"))]
    return F.array(*[F.concat_ws("|", "kind", F.lit(n), c) for n, c in made])


def spans(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """_rid, doc_id and a row for each span, or one of null kind: kind, start, end, m, base, p (of the classifier)."""
    cands = written(voted(candidates(docs)))
    real = cands.where(F.col("kind").isNotNull())
    names = [f"v_{v}" for v in VOTES]
    counted = real.groupBy("kind", *names).count().collect()  # at most 3 ** labelers rows for each kind
    post, _, share = estimate([(r["kind"], tuple(r[n] for n in names), r["count"]) for r in counted])
    key = F.concat_ws("|", "kind", *names)
    table = [x for (k, p), v in post.items() for x in (F.lit("|".join([k, *map(str, p)])), F.lit(v))]
    p = F.coalesce(F.element_at(F.create_map(*table), key), F.lit(0.5)) if table else F.lit(0.5)
    sums = real.select(F.explode(_features()).alias("f"), p.alias("p")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = {k: (sum(r["yes"] for r in sums if r["f"].startswith(f"{k}|check|")), sum(r["no"] for r in sums if r["f"].startswith(f"{k}|check|"))) for k in share}
    weights = []
    for r in sums:
        yes, no = total[r["f"].split("|")[0]]
        weights += [F.lit(r["f"]), F.lit(math.log((r["yes"] + 1) / (yes + 4)) - math.log((r["no"] + 1) / (no + 4)))]
    priors = [x for k, s in share.items() for x in (F.lit(k), F.lit(math.log(s / (1 - s))))]
    if weights:
        w = F.create_map(*weights)
        odds = F.element_at(F.create_map(*priors), F.col("kind")) + F.aggregate(_features(), F.lit(0.0), lambda s, f: s + F.coalesce(F.element_at(w, f), F.lit(0.0)))
        score = 1 / (1 + F.exp(-odds))
    else:
        score = F.lit(0.0)
    base = F.col("kind").isin(*BASE) & F.col("ok")
    scored = cands.withColumn("p", score).withColumn("base", F.coalesce(base, F.lit(False)))
    added = ~F.col("kind").isin(*BASE) & (F.col("p") >= keep)
    return scored.withColumn("kind", F.when(F.col("base") | added, F.col("kind"))).select("_rid", "doc_id", "kind", "start", "end", "m", "base", "p")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added (by the method) and has_personal_data of each row of docs."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.when(F.col("kind").isNotNull(), F.struct(rank.alias("o"), "start", "end", "kind", "base"))
    per = spans(docs).groupBy("_rid", "doc_id").agg(F.array_sort(F.collect_list(one)).alias("_s"))
    said = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("_s", lambda x: x["base"])
    count = lambda k: F.size(F.filter("_s", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return per.select(
        "doc_id", *map(count, BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("_s")).alias("spans"),
        F.size("_s").cast("long").alias("n_spans"), F.size(F.filter("_s", lambda x: ~x["base"])).cast("long").alias("n_added"), (F.size("_s") > 0).alias("has_personal_data"),
    )
