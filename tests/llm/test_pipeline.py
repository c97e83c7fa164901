"""The pipeline's rows against its parts, and its second and third stage against brute force."""

import zlib

import numpy as np

import corpus_pipeline
from tarn.llm import minhash, mixing, quality_rules
from tarn.llm.common import py_words, table, tokenizer_path

from .test_operators import edit_similar

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tokenizers import Tokenizer

    out = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    docs = table(spark, SF, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before = kept.count()
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before
    assert minhash.near_duplicates(kept).select("class_id").distinct().count() == kept.count()
    assert quality_rules.keep_good(kept, table(spark, SF, "labels")).count() > 0.95 * kept.count()
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = [(r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixing.repeat_documents(kept).collect()]
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == sorted(want)


def test_stages_by_brute_force(spark):
    """One document of each component of links stays, that of the least id; then those whose words are hit by too many benchmark windows go."""
    docs = corpus_pipeline.good(spark, table(spark, SF, "documents"), SF).cache()
    rows = [(r.doc_id, py_words(r.text)) for r in docs.collect()]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and (rows[i][1] == rows[j][1] or edit_similar(rows[i][1], rows[j][1])):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    distinct = corpus_pipeline.distinct(spark, docs, SF).cache()
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(least.values())

    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = py_words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes, kept = {len(w) for w in windows}, []
    for r in distinct.collect():
        w, hit = py_words(r.text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r.doc_id)
    clean = corpus_pipeline.clean(spark, distinct, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(kept) and 0 < len(kept) <= len(least) < len(rows)
