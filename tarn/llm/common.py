"""Pieces that several corpus operators share: word rules, shared storage, memoised tokenising."""

from __future__ import annotations

import re
import struct
from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.store import shared_folder, written  # noqa: F401 - the operators take them from here

#: Contract word classes. Words of rule W are runs of digits, ASCII letters and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of rule S are runs without ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PY_WORD = re.compile(WORD)
#: Bytes of UTF-8 to bytes: A-Z in lower case, a space for what is no part of a word.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; lower() does that by itself where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_array(c: Column) -> Column:
    """Lower-cased words of rule W; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), NOT_WORD), "")


def byte_words(text: str | None) -> list[bytes]:
    """The words of word_array() in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def py_words(text: str | None) -> list[str]:
    """The words of word_array()."""
    return list(filter(None, (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).decode("utf-8", "surrogatepass").split(" ")))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, where: Column | None = None) -> DataFrame:
    """doc_id, text, _label of at most `rows` labelled documents, those of the smallest hash of doc_id; the bound makes the broadcast safe.

    Labels that are null are left out; of several labels of a document the largest counts, of several texts the one of the smallest hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if where is not None:
        known = known.where(where)
    chosen = (
        known.groupBy("doc_id").agg(F.max(column).alias("_label")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(rows)
    )
    # doc_ids may repeat: the text's hash picks one row of each before any text is moved on
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "_label").agg(F.min_by("text", F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("text")).select("doc_id", "text", "_label")


def byte_chars() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in seen else chr(next(rest)) for b in range(256))


class Memo(dict):
    """Ids of a piece of text by the library's model, as 32-bit little-endian bytes; emptied when it holds `most` pieces."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most = model, most
        self.chars = {i: c for i, c in enumerate(byte_chars())}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        # in plain ASCII without line feeds all but the space stands for itself
        shown = piece.replace(" ", self.chars[32]) if piece.isascii() and "\n" not in piece else piece.encode().decode("latin-1").translate(self.chars)
        packed = self[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return packed


class PieceEncoder:
    """Ids of whole texts as the tokenizers library gives them, remembering the ids of pieces.

    A byte-level tokenizer cuts a text into pieces by a pattern and encodes each by itself. Over the characters of
    PLAIN, whose classes are fixed, the pattern is written out here; the library's model encodes each new piece
    once. Any other text, and one that holds an added token's string, goes to the library whole.
    """

    LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
    OUTSIDE = re.compile("[^\n -~\xa1-\u017f]")
    #: The published pattern of byte-level tokenizers, its first two alternatives set before the contractions.
    PIECE = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.tokenizer.model, most)

    def pieces(self, text: str) -> list[str] | None:
        return None if self.OUTSIDE.search(text) or any(a in text for a in self.added) else self.PIECE.findall(text)

    def packed(self, text: str) -> bytes:
        """The text's ids as 32-bit little-endian bytes."""
        cut = self.pieces(text)
        if cut is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.memo.__getitem__, cut))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_pattern() -> str:
    """The pattern that goes with the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN
