"""Sketches of many texts against those of each by the definition; what the operator leaves on disk."""

import glob

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash

from tarn.llm import minhash as m


def plain(h):
    """Band keys by the definition, one text and one band at a time."""
    keys = []
    for size, most, bands in m.FAMILIES:
        marked = m.labelled(m.shingles(h, size))
        for b in range(len(keys), len(keys) + bands):
            with np.errstate(over="ignore"):
                x = (marked ^ m._SEEDS[b]) * m._ODD[b]
            at = np.sort(np.argsort(x, kind="stable")[:most])
            keys.append(xxhash.xxh64_intdigest(marked[at].tobytes(), seed=b) - (1 << 63))
    return keys


def test_sketches_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, n)) for n in (1, 2, 3, 4, 5, 6, 7, 30, 400, 3, 20_000, 1, 90)] + ["a a a a a a a", "a a a"]
    hashed = [m.word_hashes(m.byte_words(t)) for t in texts]
    got = m.sketches(hashed)
    assert [k for k, _ in got] == [plain(h) for h in hashed]
    assert got == [m.sketch(h) for h in hashed]
    marks = m._marks(pd.Series([None, *texts, ""]))
    assert list(zip(marks["bands"], marks["sig"])) == [([], b""), *got, ([], b"")]


def test_sketches_are_written_once(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 120)) for _ in range(20)]
    rows = [(10 * i + c, t.rsplit(" ", c)[0]) for i, t in enumerate(base) for c in range(4)]
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/tarn-*"))
    found = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == sorted((d, d // 10 * 10) for d, _ in rows)
    # the sketches of all rows are gone, those of the representatives are in one table and beside no bucket
    held = [f for f in set(glob.glob(f"{folder}/tarn-*")) - before if any("sig" in pq.read_schema(p).names for p in glob.glob(f"{f}/*.parquet"))]
    assert len(held) == 1


def test_workers_keep_no_words_after_a_task():
    """A worker serves later stages too: texts are sketched a few at a time, and the remembered words go with the task."""
    texts = [f"w{i} w{i % 7} w{i % 11} x y z" for i in range(2 * m.HELD + 5)] + [None]
    got = list(m._marked(iter([pd.Series(texts[:3]), pd.Series(texts[3:])])))
    assert max(map(len, got)) <= m.HELD and not m._WORDS
    want = m._marks(pd.Series(texts))
    assert pd.concat(got, ignore_index=True).equals(want)
