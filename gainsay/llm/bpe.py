"""Byte-level BPE with the tiktoken library and a local rank file: whole texts to ids, ids to raw bytes.

Short texts go to the library as they are. A longer one is cut first, only where a match of the pattern
ends whatever stands around: before white space that follows anything else, and between a plain letter
and a following digit or mark. So the pieces have the ids of the whole text. A long run of white space,
on which the library's pattern engine runs out of stack, is split by the pattern's own rule (all but the
last character are one match, or all of them at the end of the text) and given to the model as one piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from gainsay.llm.common import begin, keeps, raw, slices, texts

PIECE_CHARS = 1 << 16
LONG_RUN = 1 << 12

# White space as Unicode has it, and as the pattern's \s means it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = r"A-Za-z\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = r"!-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1f"
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[{_LETTERS}])(?=[{_MARKS}])")
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")

_encodings: dict[tuple[str, str], Encoding] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoding(path: str, pattern: str) -> Encoding:
    """This process's encoding for a rank file and a pattern."""
    keeps("bpe", _encodings.clear)
    if (path, pattern) not in _encodings:
        _encodings[path, pattern] = Encoding(path, pattern)
    return _encodings[path, pattern]


class Encoding:
    """``pattern`` must split as the default one does where ``_SAFE`` and ``_RUN`` cut long texts."""

    def __init__(self, path: str, pattern: str, piece_chars: int = PIECE_CHARS):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._piece_chars = piece_chars

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self._piece_chars:
            if len(text) < LONG_RUN or not _RUN.search(text):
                return self._model.encode_to_numpy(text, disallowed_special=())
        parts = [self._run(part) if white else self._model.encode_to_numpy(part, disallowed_special=())
                 for white, part in _parts(text, self._piece_chars)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def _run(self, part: str) -> np.ndarray:
        return np.array(self._model._encode_single_piece(part), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self._model.decode_bytes(ids.tolist())


def _parts(text: str, size: int) -> Iterator[tuple[bool, str]]:
    """The text in pieces, and whether a piece is one match of nothing but white space."""
    at = 0
    for run in _RUN.finditer(text):
        yield from _cut(text, at, run.start(), size)
        # The last character goes with what follows it, if anything does.
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield True, text[run.start() : at]
    yield from _cut(text, at, len(text), size)


def _cut(text: str, at: int, end: int, size: int) -> Iterator[tuple[bool, str]]:
    while end - at > size:
        found = _SAFE.search(text, at + size, end)
        if found is None or found.start() >= end:
            break
        yield False, text[at : found.start()]
        at = found.start()
    if at < end:
        yield False, text[at:end]


def encode(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    Each match of the pattern is encoded on its own, and strings of special tokens are ordinary text. Null
    and empty texts have no ids. Bytes that are no UTF-8 count as U+FFFD. Rows with null or equal ids are
    rows like others; an empty table gives none. A text of any length is encoded whole; only a single match
    (one word without an end) is as large in memory as it is. Columns other than the two named are not read.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    rows = texts(docs, doc_id, text)
    schema = StructType([rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        model = encoding(path, pattern)
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = [model.encode(text.decode("utf-8", "replace")) for text in raw(piece.column("text"))]
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id"),
                    "n_tokens": pa.array(map(len, ids), pa.int64()),
                    "ids": pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                })

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with the raw bytes of its ``ids`` as ``decoded``; null ids decode to nothing.

    Bytes need not be UTF-8: a cut in the middle of a character decodes to its part. An id that the rank
    file lacks is an error. All columns stay; one called ``decoded`` is replaced.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    rows = encoded.drop("decoded")
    schema = StructType([*rows.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        model = encoding(path, pattern)
        for batch in batches:
            for piece in slices(batch, "ids"):
                ids = piece.column("ids").to_pylist()
                whole = [model.decode(np.frombuffer(i or b"", dtype="<u4")) for i in ids]
                yield pa.record_batch(
                    [*piece.columns, pa.array(whole, pa.binary())], names=[*piece.schema.names, "decoded"]
                )

    return rows.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """Hashes of ids and of decoded bytes, in lower case hex."""
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
