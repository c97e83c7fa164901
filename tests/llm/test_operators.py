"""Corpus operators against brute force on the smallest table and on edge cases: nulls, empty and long texts, repeats, clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontam, licenses, minhash, mixing, pii, quality_classifier, quality_rules, store, tokens, toxicity
from tarn.llm.common import py_words, tokenizer_path

SF = "/root/testdata/sf0.001"
BPE = tokenizer_path("byte_bpe_50k.json")
S_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "x", None), (4, BASE, "b"), (5, BASE, "b"), (6, BASE + " end", "b"), (6, BASE + " end", "b"), (None, "Released under the MIT License. CC BY cc by", "c"),
    (8, "word " * 9000 + "mail bob.smith@mail.example.com or +1 (469) 555-3334, card 4539 1488 0343 6467, host 10.0.0.256 and 10.0.0.25", "c"),
    (9, "a\x1fb  c\t<|endoftext|>\n\nÉté 😀 日本語 x²'s don't", "d"), (10, "9" * 30_000, "d"), (11, "a_b@c.de_f@g.hi ... 1.2.3.4.5.6.7.8 +12 34-56.789(0)1", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    edge = spark.createDataFrame(EDGE, "doc_id long, text string, source string").withColumn("key", F.lit("clash")).withColumn("th", F.lit(1)).withColumn("n", F.lit(2))
    return edge


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    return collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))


@pytest.mark.parametrize("which", ["docs", "real"])
def test_licenses(which, request):
    df = request.getfixturevalue(which)
    want = []
    for d, t in rows_of(df):
        w, at, names = py_words(t), [], set()
        for p, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
            p = p.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            names |= {label} if hits else set()
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))))
    got = licenses.scan_licenses(df).collect()
    assert same([tuple(r[:6]) for r in got], want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_suppression():
    labels = licenses.scan_text("Licensed under the GNU Lesser General Public License, version 2.1 or later")[5]
    assert labels == "lgpl" and len(licenses.RULES) > 200


@pytest.mark.parametrize("which", ["docs", "real"])
@pytest.mark.parametrize("chunk", [65_536, 300])
def test_token_counts(which, chunk, request):
    from tokenizers import Tokenizer

    t, df = Tokenizer.from_file(BPE), request.getfixturevalue(which)
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x in rows_of(df)]
    assert same([tuple(r)[:4] for r in tokens.count_tokens(df, BPE, chunk_chars=chunk, overlap=40).collect()], want)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_store_round_trip(which, request):
    from tokenizers import Tokenizer

    t, df = Tokenizer.from_file(BPE), request.getfixturevalue(which)
    got = sorted(store.store_documents(df, BPE).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = [(d, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, x in rows_of(df) for i in [t.encode(x or "", add_special_tokens=False).ids]]
    assert same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: (x is not None, x or 0))


def test_store_finds_damage(spark, real, tmp_path):
    store.write_store(real.limit(20), str(tmp_path / "s"), BPE)
    bad = tmp_path / "s" / "manifest"
    m = spark.read.parquet(str(bad)).withColumn("root", F.lit("0")).collect()
    spark.createDataFrame(m).write.parquet(str(tmp_path / "m"))
    bad.rename(tmp_path / "old")
    (tmp_path / "m").rename(bad)
    with pytest.raises(ValueError):
        store.read_store(spark, str(tmp_path / "s"))


def edits(a, b):
    """Plain dynamic programming, a row at a time."""
    d = np.arange(len(b) + 1)
    b = np.array(b, dtype=object)
    for i, x in enumerate(a, 1):
        e = np.minimum(d[1:] + 1, d[:-1] + (b != x)) if len(b) else d[1:]
        e = np.r_[i, e]
        d = np.minimum.accumulate(e - np.arange(len(e))) + np.arange(len(e))
    return int(d[-1])


def edit_similar(a, b):
    longest = max(len(a), len(b), 1)
    if abs(len(a) - len(b)) > 0.2 * longest or sum((collections.Counter(a) & collections.Counter(b)).values()) < 0.8 * longest - 1e-9:
        return False
    return 1 - edits(a, b) / longest >= 0.8 - 1e-9


@pytest.mark.parametrize("which", ["docs", "real"])
def test_near_duplicates(which, request):
    rows = rows_of(request.getfixturevalue(which))
    words = [py_words(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and (words[i] == words[j] or edit_similar(words[i], words[j])):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    got = minhash.near_duplicates(request.getfixturevalue(which)).collect()
    assert same([(r.doc_id, r.class_id) for r in got], [(d, least.get(find(i))) for i, (d, _) in enumerate(rows)])


def test_near_duplicates_find_nine_links_in_ten(spark):
    """Recall against the alignment of all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cls = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    texts = {}
    for d, t in rows_of(df):
        texts.setdefault(tuple(py_words(t)), d)
    ordered = sorted(texts, key=len)
    links = []
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if len(a) < 0.8 * len(b):
                break
            if edit_similar(a, b):
                links.append((texts[a], texts[b]))
    assert len(links) > 50 and sum(cls[a] == cls[b] for a, b in links) >= 0.9 * len(links)


def test_scattered_edits_near_the_threshold_are_candidates():
    """Share of linked pairs that agree in a band, in steps of 0.02 from 0.80."""
    rng = np.random.default_rng(4)
    words = [f"w{i}".encode() for i in range(3000)]
    hits = collections.defaultdict(list)
    for n in (60, 200, 600):
        for _ in range(300):
            a = [words[i] for i in np.minimum(rng.zipf(1.6, n), 3000) - 1]
            b = list(a)
            for i in rng.choice(n, int(n * rng.uniform(0.06, 0.2)), replace=False):
                b[i] = b"x%d" % rng.integers(1 << 30)
            s = minhash.edit_similarity(a, b, 0.8)
            if s:
                x, y = (minhash.sketch(minhash.word_hashes(w)) for w in (a, b))
                agree = np.frombuffer(x[1], np.uint8) == np.frombuffer(y[1], np.uint8)
                hits[int((s - 0.8) / 0.02 + 1e-9)].append(not set(x[0]).isdisjoint(y[0]) and agree[: minhash.EARLY].sum() >= minhash.AGREE_EARLY and agree.sum() >= minhash.AGREE)
    assert all(len(v) > 30 and np.mean(v) >= 0.9 for k, v in hits.items() if k < 6), {k: np.mean(v) for k, v in hits.items()}


def test_scattered_edits_end_in_one_class(spark):
    rng = np.random.default_rng(5)
    rows, links = [], []
    for k in range(150):
        a = [f"w{i}" for i in rng.integers(0, 4000, 200)]
        b = list(a)
        for i in rng.choice(200, int(rng.integers(25, 41)), replace=False):
            b[i] = f"e{rng.integers(1 << 30)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        links.append(edit_similar(a, b))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(links) > 100 and all(got[2 * k] == 2 * k for k in range(150))
    assert np.mean([got[2 * k + 1] == 2 * k for k in range(150) if links[k]]) >= 0.9


def test_large_bucket_keeps_links(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))] + [(i, " ".join(x if rng.random() > 0.02 else f"e{i}x{k}" for k, x in enumerate(base))) for i in range(1, 700)]
    test_near_duplicates("near", type("R", (), {"getfixturevalue": lambda self, _: spark.createDataFrame(rows, "doc_id long, text string")})())


@pytest.mark.parametrize("masked", [0, 4096])
def test_alignment(masked, monkeypatch):
    monkeypatch.setattr(minhash.Aligner, "MASKED", masked)
    rng = np.random.default_rng(0)
    for k in range(400):
        a = rng.integers(0, [4, 40][k % 2], rng.integers(1, 60)).tolist()
        b = [x if rng.random() > 0.06 else 99 for x in a if rng.random() > 0.06] + [9] * int(rng.integers(0, 4))
        want = 1 - edits(a, b) / max(len(a), len(b))
        for least in (0.8, 0.5):
            got = minhash.edit_similarity(a, b, least)
            assert got == pytest.approx(want) if want >= least - 1e-9 else got == 0, (a, b)


def test_alignment_of_long_texts_takes_linear_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    a = [f"w{x}" for x in rng.zipf(1.3, 80_000) % 5000]
    b = [x if rng.random() > 0.02 else "new" for x in a]
    tracemalloc.start()
    got = minhash.edit_similarity(a, b, 0.8)
    assert 0.975 < got < 0.985 and tracemalloc.get_traced_memory()[1] < 100e6


def test_tallies_never_understate_shared_words():
    rng = np.random.default_rng(3)
    texts = [[f"w{x}".encode() for x in rng.zipf(1.4, n) % 300] for n in (1, 5, 100, 140, 500, 600, 2000, 3000, 30_000)]
    tallies = [minhash.tally(minhash.word_hashes(t)) for t in texts]
    i, j = map(np.array, zip(*[(i, j) for i in range(len(texts)) for j in range(len(texts))]))
    true = [sum((collections.Counter(texts[a]) & collections.Counter(texts[b])).values()) for a, b in zip(i, j)]
    got = minhash.shared_words(tallies, i, j)
    assert (got >= true).all() and (got[np.array(true) > 0] < 1.5 * np.array(true)[np.array(true) > 0] + 20).mean() > 0.7


def test_components_follow_long_chains(spark):
    pairs = [(bytes([k]), bytes([k + 1])) for k in range(40)] + [(bytes([100]), bytes([200])), (bytes([200]), bytes([150])), (bytes([100]), bytes([150]))]
    got = {r.node[0]: r.cls[0] for r in minhash.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 150, 200), 100)}


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


@pytest.mark.parametrize("which", ["docs", "real"])
def test_pii(which, request):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub("[^0-9]", "", m)
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    want = []
    for d, t in rows_of(request.getfixturevalue(which)):
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok[k](m.group())] for k, p in rx.items()}
        want.append((d, *[len(spans[k]) for k in rx], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in rx for a, b in spans[k]).encode()).hexdigest()))
    got = pii.find_pii(request.getfixturevalue(which)).collect()
    assert same([tuple(r)[:6] for r in got], want)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_contamination(which, request, spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    if which == "docs":
        items = [(1, BASE[:200]), (1, BASE[:200]), (2, "one Two"), (3, None), (4, "..."), (5, " ".join(BASE.split()[5:22])), (6, "mail bob")]
    df = request.getfixturevalue(which)
    wins = {}
    for i, t in items:
        w = py_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for d, t in rows_of(df):
        w, hit, found = py_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert same([tuple(r) for r in decontam.contamination(df, bench).collect()], want)
    kept = decontam.without_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not x[-1] for x in want)


def brute_rules(t):
    t = t or ""
    w, seen, dup = S_WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if S_WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_quality_rules(which, request, labels):
    df = request.getfixturevalue(which)
    got = quality_rules.judge(df, labels).collect()
    assert same([tuple(r)[:7] for r in got], [(d, *brute_rules(t)) for d, t in rows_of(df)])
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality_rules.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


def test_mixing(docs, real):
    for df in (docs, real):
        got = mixing.mix(df).collect()
        sizes = collections.Counter()
        for r in got:
            sizes[r.source] += r["size"]
        order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
        weight, left, target = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), {}
        free = list(order)
        while free:
            level = left / sum(weight[s] for s in free)
            over = [s for s in free if level * weight[s] >= 3 * sizes[s]]
            if not over:
                target |= {s: level * weight[s] for s in free}
                break
            for s in over:
                target[s] = 3 * sizes[s]
                left -= target[s]
                free.remove(s)
        taken = collections.Counter()
        for r in got:
            taken[r.source] += r.taken
            assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert all(abs(taken[s] - target[s]) <= 2 for s in order)
        assert same(got, mixing.mix(df.repartition(3)).collect())
        out = mixing.repeat_documents(df)
        assert out.columns == df.columns and sum(len(S_WORD.findall(r.text or "")) for r in out.collect()) == sum(taken.values())


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    df, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    tox = [r for r in toxicity.score_documents(df, lab).collect() if r.doc_id in truth]
    assert np.mean([truth[r.doc_id]["toxic"] == r.predicted for r in tox if r.held_out]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in tox)
    cls = [r for r in quality_classifier.classify(df, lab).collect() if r.doc_id in truth]
    assert np.mean([r.kept for r in cls if truth[r.doc_id]["quality"]]) > 0.97 and np.mean([not r.kept for r in cls if not truth[r.doc_id]["quality"]]) > 0.8


def test_models_on_edge_rows(spark, docs, labels):
    none = labels.where("1 = 0")
    for lab in (labels, none):
        assert toxicity.score_documents(docs, lab).count() == len(EDGE)
        assert quality_classifier.classify(docs, lab).count() == len(EDGE)


def test_empty_tables(spark, docs, labels):
    empty = docs.where("1 = 0")
    bench = spark.createDataFrame([], "item_id long, text string")
    for f in (licenses.scan_licenses, lambda d: tokens.count_tokens(d, BPE), minhash.near_duplicates, pii.find_pii, lambda d: decontam.contamination(d, bench), lambda d: store.store_documents(d, BPE), lambda d: quality_rules.judge(d, labels), mixing.mix, lambda d: quality_classifier.classify(d, labels), lambda d: toxicity.score_documents(d, labels)):
        assert f(empty).count() == 0
    assert decontam.contamination(docs, bench).where("n_hit > 0").count() == 0


def test_one_of_each_keeps_columns(docs):
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {1, 3, 4, None, 8, 9, 10, 11}


def test_second_round_gives_each_pair_of_classes_once_and_loses_none():
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 256, (5, minhash.SIGNATURE), dtype=np.uint8)
    n = 30
    own = [sig[k % 5].tobytes() for k in range(n)]
    bands = [[int(x) for x in rng.integers(0, 3, minhash.BANDS) + 10 * np.arange(minhash.BANDS)] for _ in range(n)]
    cls = [bytes([k // 4]) for k in range(n)]
    rows = [(b, bytes([k]), 9, own[k], bytes([9] + [0] * 255), bands[k], cls[k], role, 0, 0) for k in range(n) for b in bands[k] for role in (0, 1)]
    pdf = pd.DataFrame(rows, columns=["band", "key", "n", "sig", "tally", "bands", "cls", "role", "block", "odd"]).sort_values(["band", "block", "odd"], ignore_index=True)
    pdf["bands"] = pdf["bands"].map(lambda x: np.array(x, np.int64))
    groups = [g.reset_index(drop=True) for _, g in pdf.groupby("band")]
    got = [tuple(x) for g in groups for out in minhash._between(0.8)(iter([g])) for x in out.itertuples(index=False)]
    want = {(bytes([a]), bytes([b])) for a in range(n) for b in range(a + 1, n) if own[a] == own[b] and cls[a] != cls[b] and set(bands[a]) & set(bands[b])}
    assert len(got) == len(set(got)) and set(got) == want and want
