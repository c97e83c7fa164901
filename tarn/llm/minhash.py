"""Near-duplicate classes by Order MinHash.

Texts of the same words are one class from the start. For the others, each of BANDS hash functions samples the
smallest occurrence-labelled shingles of a text, of five words or of three, and keeps their text order; texts that
agree in a band's sample are candidates. One changed word spoils every shingle that holds it: at 20 scattered changes
in 100 words a third of the five-word shingles stay and half of those of three, so the latter carry pairs close to
the threshold (of pairs at an edit similarity of 0.80 to 0.82 about 0.95 agree in a band, from 0.82 on 0.97 and more;
with 16 bands of five words alone it was 0.51), the former those that share a long passage. A pair is linked if a banded alignment of its words finds an edit similarity
(1 - edits / words of the longer text) of at least `least`. Classes are the connected components of the links.
Before the alignment a MinHash signature of occurrence-labelled words, which any linked pair shares to two thirds
at 0.8, rules out pairs that no alignment can link.

Candidates are found twice. First, each bucket is dealt into blocks of bounded size with a few common hubs, and
of a block only a spanning forest of the likeliest pairs is verified: linear in the bucket, and enough for most.
Then the buckets that still hold several classes are compared in full between the classes, members outside the
largest class against all, in blocks too, and every likely pair not verified before is: all pairs that a band brings together are looked at.

Texts of fewer words than a shingle are one; long texts are marked and aligned in linear memory; other columns are not read; texts without words (null too) are copies of each other; null
doc_ids never name a class unless all its rows have none (then class_id is null); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.store import delete_folder

from .common import byte_words, shared_folder, written

#: Words of a shingle, shingles of a sample, and bands of each family.
FAMILIES = ((5, 2, 8), (3, 2, 20))
BANDS, SIGNATURE = sum(f[2] for f in FAMILIES), 128
#: Signature places that must agree for a pair to be aligned, of the first EARLY and of all. An edit similarity of 0.8
#: leaves at least 0.8 n of n words in common, out of at most 1.2 n: of 10,000 pairs at the threshold, about 1 has fewer.
EARLY, AGREE_EARLY, AGREE = 32, 10, 64
#: Places that agree in pairs likely enough to be linked for any of them to serve in a spanning forest.
SURE = 104
#: Counters of a text's word counts: the least that its number of words fits into, or the last.
COUNTERS = (128, 512, 2048)
#: Members of a block of a bucket, hubs that all of its blocks see, and pairs of one text that a task gets together.
BLOCK, HUBS, PAIRS = 256, 24, 256
#: Words that are sketched together, about, and cells of a block of hash functions by words.
TOGETHER, CELLS = 16_384, 16_384
#: Texts whose sketches a worker holds at once.
HELD = 1000
_LAST = np.uint64((1 << 64) - 1)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 1 + BANDS + SIGNATURE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)
_SEEDS32, _ODD32 = (_SEEDS >> np.uint64(32)).astype(np.uint32), (_ODD & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class _Hashes(dict):
    """Hash of each word, emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of `size` hashed words in text order."""
    k = min(size, len(h))
    n = len(h) - k + 1 if k else 0
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def labelled(h: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the values with their occurrence: the first, the second ... of each, in each text where several lie one after another."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = s[1:] != s[:-1]
    if text is not None:
        t = text[order]
        new |= t[1:] != t[:-1]
    first = np.flatnonzero(np.r_[True, new])
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    out = np.empty_like(h)
    with np.errstate(over="ignore"):
        out[order] = mix(s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _band_keys(marked: np.ndarray, most: int, low: int, end: int) -> list[int]:
    """Keys of bands low to end from a text's marked shingles."""
    keys, pick, step = [], min(most, len(marked)), max(1, CELLS // len(marked))
    with np.errstate(over="ignore"):
        for k in range(low, end, step):
            seeds = slice(k, min(k + step, end))
            x = marked[None, :] ^ _SEEDS[seeds, None]
            x *= _ODD[seeds, None]
            at, row = np.empty((len(x), pick), np.int64), np.arange(len(x))
            for p in range(pick):
                at[:, p] = x.argmin(axis=1)
                x[row, at[:, p]] = _LAST
            at.sort(axis=1)
            keys += [xxhash.xxh64_intdigest(m.tobytes(), seed=k + i) - (1 << 63) for i, m in enumerate(marked[at])]
    return keys


def _least(short: np.ndarray) -> np.ndarray:
    """The least of each hash function over a text's marked words, in 32 bits, which processors multiply several at a time."""
    least = []
    # a few hash functions at once, so that a block of values stays in the cache
    step = max(1, CELLS // len(short))
    with np.errstate(over="ignore"):
        for j in range(BANDS, BANDS + SIGNATURE, step):
            seeds = slice(j, min(j + step, BANDS + SIGNATURE))
            x = short[None, :] ^ _SEEDS32[seeds, None]
            x *= _ODD32[seeds, None]
            least.append(x.min(axis=1))
    return np.concatenate(least)


def sketches(texts: list[np.ndarray]) -> list[tuple[list[int], bytes]]:
    """Band keys of the shingles and the signature of the words of each text, none of them empty.

    Shingles and occurrences are found for all texts at once, laid one after another: for short ones a call costs more than its work.
    """
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    words, text = np.concatenate(texts), np.repeat(np.arange(len(texts)), size)
    keys = [[] for _ in texts]
    for width, most, bands in FAMILIES:
        found = [None] * len(texts)
        # a shingle belongs to the text in which it ends; texts of fewer words than a shingle are one
        whole = size >= width
        if whole.any():
            at = np.flatnonzero(text[: len(words) - width + 1] == text[width - 1 :])
            marked = labelled(shingles(words, width)[at], text[at])
            parts = np.split(marked, np.cumsum(size[whole] - width + 1)[:-1])
            for i, part in zip(np.flatnonzero(whole).tolist(), parts):
                found[i] = part
        for i in np.flatnonzero(~whole).tolist():
            found[i] = labelled(shingles(texts[i], width))
        for mine, part in zip(keys, found):
            mine += _band_keys(part, most, len(mine), len(mine) + bands)
    short = np.split((labelled(words, text) >> np.uint64(32)).astype(np.uint32), ends[:-1])
    least = mix(np.stack([_least(t) for t in short]).astype(np.uint64)) & np.uint64(255)
    return list(zip(keys, map(bytes, least.astype(np.uint8))))


def sketch(words: np.ndarray) -> tuple[list[int], bytes]:
    """sketches() of one text."""
    return sketches([words])[0]


def tally(words: np.ndarray) -> bytes:
    """Counts of the words by the low bits of their hashes; 65,535 stands for more too."""
    size = next((c for c in COUNTERS if len(words) <= c), COUNTERS[-1])
    low = ((words >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)
    return np.minimum(np.bincount(low, minlength=size), 65_535).astype("<u2").tobytes()


def shared_words(tallies: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of texts, no fewer than the words (with their counts) that both have."""
    size = np.array([len(t) // 2 for t in tallies])
    out = np.zeros(len(i), np.int64)
    for c in COUNTERS:
        pairs = np.flatnonzero(np.minimum(size[i], size[j]) == c)
        if len(pairs):
            # a larger tally is folded onto the smaller one's counters
            used, at = np.unique(np.r_[i[pairs], j[pairs]], return_inverse=True)
            folded = np.stack([np.minimum(np.frombuffer(tallies[k], "<u2").reshape(-1, c).sum(axis=0), 65_535) for k in used.tolist()]).astype(np.uint16)
            for k in range(0, len(pairs), 4096):
                some = np.arange(k, min(k + 4096, len(pairs)))
                least = np.minimum(folded[at[some]], folded[at[len(pairs) + some]])
                # nothing is known of counts that both have reached the end
                out[pairs[some]] = np.where((least == 65_535).any(axis=1), np.iinfo(np.int64).max, least.sum(axis=1, dtype=np.int64))
    return out


def _marks(texts: pd.Series) -> pd.DataFrame:
    out, waiting, n_words = [], [], 0

    def flush():
        for (i, _), found in zip(waiting, sketches([h for _, h in waiting]) if waiting else []):
            out[i] = (*out[i][:2], *found, out[i][2])

    for t in texts:
        words = byte_words(t)
        hashed = word_hashes(words)
        out.append((hashlib.blake2b(b"\0".join(words), digest_size=16).digest(), len(words), tally(hashed)))
        if words:
            waiting.append((len(out) - 1, hashed))
            n_words += len(words)
        else:
            out[-1] = (*out[-1][:2], [], b"", out[-1][2])
        if n_words >= TOGETHER:
            flush()
            waiting, n_words = [], 0
    flush()
    return pd.DataFrame(out, columns=["key", "n", "bands", "sig", "tally"])


def _marked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """_marks() of a few texts at a time. The worker lives on and serves later stages, so that what it remembers goes with the task."""
    for texts in batches:
        for k in range(0, len(texts), HELD):
            yield _marks(texts.iloc[k : k + HELD])
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


class Aligner:
    """Banded alignments of one text with others: a column of the band is two bit vectors, moved down a row with each word."""

    #: Words up to which the rows of each word are kept as one bit mask; above, as places alone, so that memory stays linear.
    MASKED = 4096

    def __init__(self, a: list):
        self.n, self.counts, self.places = len(a), Counter(a), {}
        for i, w in enumerate(a):
            self.places.setdefault(w, []).append(i)
        self.masks = {w: sum(1 << i for i in at) for w, at in self.places.items()} if self.n <= self.MASKED else None
        if self.masks is None:
            self.places = {w: np.array(at) for w, at in self.places.items()}

    def rows(self, word, low: int, width: int) -> int:
        """Bit t is set where the word stands in place low + t."""
        if self.masks is not None:
            x = self.masks.get(word, 0)
            return (x >> low if low >= 0 else x << -low) & ((1 << width) - 1)
        at = self.places.get(word)
        if at is None:
            return 0
        i, j = np.searchsorted(at, (low, low + width)).tolist()
        if j - i <= 4:
            return sum(1 << p for p in (at[i:j] - low).tolist())
        bits = np.zeros(width, np.uint8)
        bits[at[i:j] - low] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def similarity(self, b: list, least: float) -> float:
        """1 - edits / longer length, or 0 if that is under least. The band is as wide as the edits allowed."""
        n, m = self.n, len(b)
        longest = max(n, m, 1)
        most = int((1 - least) * longest + 1e-9)
        # each edit takes one word at most from what the two have in common
        if abs(n - m) > most or sum(min(c, self.counts.get(w, 0)) for w, c in Counter(b).items()) < longest - most:
            return 0.0
        # bit t of a column stands for row j - most + t; rows above the text cost as much as its first one
        width, slack = 2 * most + 1, most + abs(n - m)
        full, top = (1 << width) - 1, 1 << (width - 1)
        up, down, diagonal = full ^ ((1 << (most + 1)) - 1), 0, 0
        for j, w in enumerate(b):
            up, down = up >> 1 | top, down >> 1
            same = self.rows(w, j - most, width)
            free = (((same & up) + up) ^ up | same | down) & full
            right = ((down | (full ^ (up | free))) << 1 | 1) & full
            left = ((up & free) << 1) & full
            up, down = left | (full ^ (free | right)), right & free
            if not free >> most & 1:
                diagonal += 1
                if diagonal > slack:
                    return 0.0
        # from the end of the diagonal up or down the last column
        between = ((1 << abs(n - m)) - 1) << (most + 1 if n > m else most + 1 - (m - n))
        along = (up & between).bit_count() - (down & between).bit_count()
        edits = diagonal + (along if n > m else -along)
        return 1 - edits / longest if edits <= most else 0.0


def edit_similarity(a: list, b: list, least: float) -> float:
    return Aligner(a).similarity(b, least)


def _groups(batches, columns: list[str]):
    """Frames of whole groups from batches that are sorted by columns."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf[columns].eq(pdf[columns].iloc[-1]).all(axis=1).to_numpy()
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def _bounds(pdf: pd.DataFrame, columns: list[str]) -> list[tuple[int, int]]:
    v = [pdf[c].to_numpy() for c in columns]
    new = np.r_[True, np.any([x[1:] != x[:-1] for x in v], axis=0)] if len(pdf) > 1 else np.array([True])
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(pdf)]))


def _alike(sig: np.ndarray, n: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float):
    """Row, column and agreement of the likely pairs of rows x cols."""
    for k in range(0, len(rows), 64):
        r = rows[k : k + 64]
        near = np.minimum(n[r][:, None], n[cols][None, :]) >= least * np.maximum(n[r][:, None], n[cols][None, :])
        i, j = np.nonzero(((sig[r][:, None, :EARLY] == sig[cols][None, :, :EARLY]).sum(axis=2) >= AGREE_EARLY) & near)
        agree = (sig[r[i]] == sig[cols[j]]).sum(axis=1)
        ok = agree >= AGREE
        yield r[i[ok]], cols[j[ok]], agree[ok]


def _forest(least: float):
    """Of each block, a spanning forest of its likely pairs: sure ones first, from the smallest keys on, then the likeliest.

    The smallest keys are the same in all of a group's buckets, so the forests of its bands share most of their pairs.
    """

    def pairs(batches):
        for pdf in _groups(batches, ["band", "block"]):
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, SIGNATURE)
            n, keys, out = pdf["n"].to_numpy(), pdf["key"].tolist(), []
            for lo, hi in _bounds(pdf, ["band", "block"]):
                if hi - lo < 2:
                    continue
                at = np.array(sorted(range(lo, hi), key=keys.__getitem__))
                got = [x for k in range(0, hi - lo, 64) for x in _alike(sig, n, at[k : k + 64], at[k:], least)]
                i, j, agree = (np.concatenate(x) for x in zip(*got))
                top, rank = {}, np.zeros(len(pdf), np.int64)
                rank[at] = np.arange(len(at))

                def find(x):
                    while top.get(x, x) != x:
                        top[x] = x = top.get(top[x], top[x])
                    return x

                ok = np.flatnonzero(rank[i] < rank[j])
                ok = ok[np.lexsort((-agree[ok], np.where(agree[ok] >= SURE, rank[i[ok]], SIGNATURE - agree[ok]), agree[ok] < SURE))]
                for x, y in zip(i[ok].tolist(), j[ok].tolist()):
                    u, v = find(x), find(y)
                    if u != v:
                        top[u] = v
                        out.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
            yield pd.DataFrame(out, columns=["a", "b"])

    return pairs


def _between(least: float):
    """All likely pairs of different classes between a block's members and its stragglers.

    Each bucket that two texts share compares them, so that the one of their first common band alone gives the pair.
    """

    def pairs(batches):
        for pdf in _groups(batches, ["band", "block", "odd"]):
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, SIGNATURE)
            n, keys, role, out = pdf["n"].to_numpy(), pdf["key"].tolist(), pdf["role"].to_numpy(), set()
            code, tallies = pdf["cls"].factorize()[0], pdf["tally"].tolist()
            band, bands = pdf["band"].to_numpy(), np.stack(pdf["bands"].to_numpy())
            for lo, hi in _bounds(pdf, ["band", "block", "odd"]):
                at = np.arange(lo, hi)
                for i, j, _ in _alike(sig, n, at[role[lo:hi] == 1], at[role[lo:hi] == 0], least):
                    here = (code[i] != code[j]) & (band[lo] == bands[i, np.argmax(bands[i] == bands[j], axis=1)])
                    i, j = i[here], j[here]
                    near = shared_words(tallies, i, j) >= least * np.maximum(n[i], n[j]) - 1e-9
                    out.update((min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in zip(i[near].tolist(), j[near].tolist()))
            yield pd.DataFrame(sorted(out), columns=["a", "b"])

    return pairs


def _verify(least: float):
    """Links of pairs that come in the order of a, whose text is prepared once."""

    def links(batches):
        last, aligner = None, None
        for pdf in batches:
            out = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                if a != last:
                    last, aligner = a, Aligner(byte_words(ta))
                found = aligner.similarity(byte_words(tb), least)
                if found >= least:
                    out.append((a, b, found))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return links


def components(links: DataFrame) -> DataFrame:
    """node, cls: the smallest node that links a, b connect it to; nodes are those of links.

    In each round a node points at its smallest neighbour; pointers are followed to their ends, and the links
    between these are what is left for the next round.
    """
    edges, labels = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("top")))
        while True:
            up = point.select(F.col("node").alias("_up"), F.col("top").alias("_top"))
            after = written(point.join(up, point.top == F.col("_up")).select("node", F.col("_top").alias("top"), (F.col("top") != F.col("_top")).alias("_moved")))
            if not after.where("_moved").limit(1).count():
                break
            point = after.select("node", "top")
        labels = point.select("node", F.col("top").alias("cls")) if labels is None else written(
            labels.join(point.withColumnRenamed("node", "_n"), F.col("cls") == F.col("_n"), "left").select("node", F.coalesce("top", "cls").alias("cls"))
        )
        ends = point.select(F.col("node").alias("a"), F.col("top").alias("_a")), point.select(F.col("node").alias("b"), F.col("top").alias("_b"))
        edges = written(edges.join(ends[0], "a").join(ends[1], "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, key (of the words), cls (of the class), exact_id and class_id: the smallest doc_id of equal words and of the class."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    marked = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("th"), F.pandas_udf(_marked, "key binary, n int, bands array<long>, sig binary, tally binary")("text").alias("_m")).select("doc_id", "th", "_m.*")
    marked.write.parquet(folder)
    marked = spark.read.schema(marked.schema).parquet(folder)
    reps = written(
        marked.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "th")).alias("_r"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("tally").alias("tally"))
        .select("key", F.col("_r.doc_id").alias("exact_id"), "_r.th", "n", "bands", "sig", "tally")
    )
    # of all rows, only the keys are needed on; their sketches are those of reps
    ids = written(marked.select("doc_id", "key"))
    delete_folder(spark, folder)
    bands = reps.where("n > 0").select("key", F.explode("bands").alias("band"))
    # counts are written, so that Spark can split a hot bucket in the join
    counts = written(bands.groupBy("band").count().where("count > 1"))
    # rows that share a bucket; signatures, which are long and do not compress, join them on the way to their block and are never written
    members = written(bands.join(counts, "band"))

    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int")
    # the hubs of a bucket are its smallest keys, about: keys are hashes
    hub = (blocks > 1) & (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("double") * F.col("count") < float(HUBS << 32))
    block = F.pmod(F.xxhash64(F.lit(3), "key"), blocks).cast("int")
    dealt = members.join(reps.select("key", "n", "sig"), "key").select("band", "key", "n", "sig", F.explode(F.when(hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))).alias("block"))
    first = written(
        dealt.repartition("band", "block").sortWithinPartitions("band", "block").mapInPandas(_forest(least), "a binary, b binary").distinct()
    )
    links = written(verified(docs, reps, first, least))
    classes = components(links)

    known = members.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("cls", F.coalesce("cls", "key"))
    known = written(known)
    sizes = known.groupBy("band", "cls").agg(F.count("*").alias("_c")).groupBy("band").agg(F.max(F.struct("_c", "cls")).alias("_main"), F.count("*").alias("_classes"), F.sum("_c").alias("_all"))
    split = known.join(written(sizes.where("_classes > 1")), "band").join(reps.select("key", "n", "sig", "tally", "bands"), "key")
    odd = F.col("cls") != F.col("_main.cls")
    odds = F.greatest(F.lit(1), F.ceil((F.col("_all") - F.col("_main._c")) / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "key"), odds).cast("int")
    # each member in its block beside each heap of stragglers, and each straggler in its heap beside each block
    place = lambda role, block, odd: F.struct(F.lit(role).alias("role"), block.alias("block"), odd.alias("odd"))
    every = F.transform(F.sequence(F.lit(0), odds - 1), lambda o: place(0, block, o))
    stray = F.when(odd, F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: place(1, b, own))).otherwise(F.slice(every, 1, 0))
    placed = split.select("band", "key", "n", "sig", "tally", "bands", "cls", F.inline(F.concat(every, stray)))
    more = (
        placed.repartition("band", "block", "odd").sortWithinPartitions("band", "block", "odd")
        .mapInPandas(_between(least), "a binary, b binary").distinct()
    )
    second = written(more.join(first, ["a", "b"], "left_anti"))
    if second.limit(1).count():
        extra = written(verified(docs, reps, second, least))
        if extra.limit(1).count():
            classes = components(links.unionByName(extra))
    named = reps.select("key", "exact_id").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("cls", F.coalesce("cls", "key"))
    named = written(named)
    least_id = written(named.groupBy("cls").agg(F.min("exact_id").alias("class_id")))
    names = written(named.join(least_id, "cls").select("key", "cls", "exact_id", "class_id"))
    return ids.join(names, "key").select("doc_id", "key", "cls", "exact_id", "class_id")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of the pairs of keys that are near duplicates; only their texts are moved.

    The text of b comes first: a can be a hub with many pairs. These are dealt to blocks of about PAIRS, each of which gets a's text once.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = reps.join(written(ends), "key", "left_semi").select("key", F.col("exact_id").alias("_id"), F.col("th").alias("_th"))
    th = F.md5(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("doc_id", "text", th.alias("th")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    texts = written(texts.groupBy("key").agg(F.first("text").alias("text")))
    blocks = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("_of")))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64(F.lit(7), "b"), F.col("_of")).cast("int").alias("_block"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    a = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")).join(blocks, "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_block"))
    return dealt.join(b, "b").join(a, ["a", "_block"]).select("a", "b", "ta", "tb").mapInPandas(_verify(least), "a binary, b binary, similarity double")


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each class the row of the smallest doc_id stays (of repeated ones, any equal row)."""
    found = near_duplicates(docs, least)
    # the row that stays: the one whose doc_id names the class; classes of null doc_ids keep their smallest key
    keep = found.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "key")).alias("_k")).select(F.col("_k.doc_id").alias("_tarn_id"), F.hex("_k.key").alias("_tarn_key"))

    @F.pandas_udf("string")
    def word_key(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(b"\0".join(byte_words(t)), digest_size=16).hexdigest().upper() for t in texts])

    mine = docs.join(keep.select("_tarn_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_tarn_id")), "left_semi").withColumn("_tarn_key2", word_key("text"))
    return mine.join(keep, F.col("doc_id").eqNullSafe(F.col("_tarn_id")) & (F.col("_tarn_key2") == F.col("_tarn_key")), "left_semi").dropDuplicates(["doc_id", "_tarn_key2"]).drop("_tarn_key2")
