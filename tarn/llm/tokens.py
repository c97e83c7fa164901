"""Token counts by overlap resynchronisation.

A text longer than `chunk_chars` is encoded as overlapping chunks with offsets. Two neighbouring chunks are
spliced at a boundary that is proven stable: the splitter is a left-to-right scan whose next piece depends on
its position and on what follows alone, so where the left chunk (right from its beginning, by induction) and
the right chunk both start a piece at the same place, away from the left chunk's end, their scans agree from
there on. If the overlap holds no such place, it is doubled, up to the whole text.

Null texts count as empty and have no tokens; rows that repeat each give a row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder

def starts(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, the first one left out: character offsets and the index of the piece's first token."""
    word = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    if len(word) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(word) != 0) + 1
    offsets = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(word))
    return offsets[first], first


def margin(tokenizer) -> int:
    """Characters at a chunk's end whose pieces may differ in the whole text: the longest added token and some to look ahead."""
    return 16 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def count_by_chunks(tokenizer, text: str, chunk_chars: int, overlap: int) -> tuple[int, int]:
    """Tokens of the whole text, from chunks of chunk_chars that overlap, and the chunks that were encoded."""
    done, at, skip, n, edge = 0, 0, 0, len(text), margin(tokenizer)  # tokens counted; the chunk's start; its tokens that the left chunk has counted
    end, chunks = min(n, chunk_chars), 1
    left = tokenizer.encode(text[at:end], add_special_tokens=False)
    while end < n:
        l_off, l_tok = starts(left)
        wide = overlap
        while True:
            begin = max(at, end - wide)
            chunks += 1
            if begin == at:  # no stable place in all of the left chunk: take it into one twice as long
                end = min(n, end + max(chunk_chars, end - at))
                left = tokenizer.encode(text[at:end], add_special_tokens=False)
                break
            to = min(n, begin + max(chunk_chars, 2 * wide))
            right = tokenizer.encode(text[begin:to], add_special_tokens=False)
            r_off, r_tok = starts(right)
            safe = (l_off + at <= end - edge) & (l_tok >= skip)
            common, i, j = np.intersect1d(l_off[safe] + at, r_off + begin, return_indices=True)
            # an offset can repeat where a piece of no width was trimmed: only places that both hold once are used
            if len(common):
                k = len(common) - 1
                done += int(l_tok[safe][i[k]]) - skip
                left, at, end, skip = right, begin, to, int(r_tok[j[k]])
                break
            wide *= 4
    return done + len(left.ids) - skip, chunks


def count_tokens(docs: DataFrame, tokenizer: str, over: int = 512, chunk_chars: int = 65_536, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chunks (encoded) of each row of docs; tokenizer is the path of a byte-level file."""

    @F.pandas_udf("n_tokens long, n_chunks long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(tokenizer)
        out = [count_by_chunks(enc.tokenizer, t, chunk_chars, overlap) if len(t) > chunk_chars else (len(enc.packed(t)) // 4, 1) for t in texts]
        return pd.DataFrame(out, columns=["n_tokens", "n_chunks"], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("_c")).select(
        "doc_id", "n_bytes", "_c.n_tokens", (F.col("_c.n_tokens") > over).alias("over_limit"), "_c.n_chunks"
    )
