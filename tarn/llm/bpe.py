"""Byte-level BPE by a sentencepiece model that is written from a rank file.

Each token of the rank file becomes a piece: its bytes as the characters that stand for them, scored by the negative of its
rank, with its rank as its id. The normaliser changes nothing and adds no prefix, so the library's merges (the highest
score first, of equals the leftmost) are those of the ranks: the lowest rank first, the leftmost of equals. A text is cut
into pre-tokens by the pattern and each is encoded by itself; one that is a token as a whole is that token.

The pattern's classes of letters, numbers and white space follow the Unicode tables of the library that the ranks come from:
it is asked once in a worker for the characters of each class, since tables of other libraries differ by thousands of characters.

Decoding looks up each id's piece and maps its characters back to bytes; an id that is not in the vocabulary is an error.

Null and empty texts have no ids; rows that repeat each give a row; null doc_ids stay; an empty table gives no rows; other
columns are not read. A pre-token of any length is encoded whole, in n log n steps.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chars

#: Field numbers of the model file's format and its constants.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 3, 2, 4, 40, 41, 42, 43, 45
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5

#: Pre-tokens that a worker remembers, the length up to which it does, and characters of text that are sent on together.
REMEMBERED, SHORT, SLICE = 250_000, 64, 4_000_000


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def read_ranks(path: str) -> dict[bytes, int]:
    lines = map(bytes.split, Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The model file: a piece for each rank in order, then the one for what is unknown. Ranks are 0 to their number less 1."""
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) >= 1 << 24:
        raise ValueError("ranks are not 0, 1, 2, ... below 2 ** 24")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no rank")
    chars = byte_chars()
    out = []
    shown_as = {i: c for i, c in enumerate(chars)}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        shown = token.decode("latin-1").translate(shown_as)
        out.append(_block(PIECES, _block(PIECE, shown.encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", -rank) + _number(TYPE, NORMAL)))
    out.append(_block(PIECES, _block(PIECE, b"<unk>") + _varint(SCORE << 3 | 5) + struct.pack("<f", 0) + _number(TYPE, UNKNOWN)))
    none = [_number(f, -1) for f in (BOS_ID, EOS_ID, PAD_ID)]
    out.append(_block(TRAINER, _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(ranks) + 1) + _number(UNK_ID, len(ranks)) + b"".join(none) + _block(UNK_PIECE, b"<unk>")))
    out.append(_block(NORMALIZER, _block(NAME, b"identity") + b"".join(_number(f, 0) for f in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))))
    return b"".join(out)


@functools.cache
def class_ranges(escape: str) -> list[tuple[int, int]]:
    """The characters of an escape as the library of the rank files has them, as ranges."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    probe = tiktoken.Encoding("probe", pat_str=escape, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    points = np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(np.diff(points) != 1)
    return list(zip(points[[0, *(ends + 1)]].tolist(), points[[*ends, -1]].tolist()))


def splitter(pattern: str, below: int = 0x110000) -> re.Pattern:
    r"""The pattern with \p{..} and \s written out as ranges, right for texts of characters under `below`."""

    def written_out(escape: str) -> str:
        return "".join(f"\\U{a:08x}-\\U{min(b, below - 1):08x}" for a, b in class_ranges(escape) if a < below)

    def one(m: re.Match) -> str:
        part = m.group()
        if part.startswith("["):
            return re.sub(r"\\p\{\w+\}|\\s", lambda x: written_out(x.group()), part)
        return f"[^{written_out(chr(92) + 's')}]" if part == r"\S" else f"[{written_out(part)}]"

    return re.compile(re.sub(r"\[(?:\\.|[^\]\\])*\]|\\p\{\w+\}|\\[sS]", one, pattern))


class Codec(dict):
    """Encodes and decodes; as a dict it remembers the ids of short pre-tokens as 32-bit little-endian bytes."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        super().__init__()
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        chars = byte_chars()
        self.shown = {i: c for i, c in enumerate(chars)}
        back = {ord(c): i for i, c in enumerate(chars)}
        self.bytes_of = [p.translate(back).encode("latin-1") for p in self.model.id_to_piece(list(range(len(ranks))))]
        self.whole = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        # classes within 16 bits are looked up in a table, others range by range
        self.cut, self.cut_low, self.high = splitter(pattern).findall, splitter(pattern, 0x10000).findall, re.compile("[\U00010000-\U0010ffff]").search

    def __missing__(self, piece: str) -> bytes:
        plain = piece.encode().decode("latin-1")
        one = self.whole.get(plain)
        ids = self.model.encode(plain.translate(self.shown)) if one is None else [one]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, (self.cut if self.high(text) else self.cut_low)(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def code_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids and text_bytes of each row's text: the ids as little-endian unsigned 32-bit integers, and what they decode to.

    ranks is the path of a rank file. One worker does both, so that a task needs one codec; it sends rows on by SLICE characters of text.
    """

    def coded(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            first, held, n = 0, [], 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                held.append(c.encode(text))
                n += len(text)
                if n >= SLICE or k == batch.num_rows - 1:
                    columns = [batch.column(0)[first : k + 1], pa.array(held, pa.binary()), pa.array(map(c.decode, held), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text_bytes"])
                    first, held, n = k + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(coded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, text_bytes binary")


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids of each row's text, the ids as little-endian unsigned 32-bit integers. ranks is the path of a rank file."""

    def encoded(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            packed = pa.array([c.encode(t.as_py() or "") for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encoded with text_bytes, what its ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def decoded(ids):
        c = codec(ranks, pattern)
        return ids.map(lambda x: None if x is None else c.decode(x))

    return encoded.withColumn("text_bytes", decoded("ids"))
