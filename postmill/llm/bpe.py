"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank vocabulary.

The model is a protocol buffer written here: one piece per token, its bytes mapped one to one to printable characters,
its score the negative rank (so the best-scored merge is the one of lowest rank), identity normalisation. Each pre-token,
a match of the pattern, is encoded on its own; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import small_batches

#: Pre-tokens whose ids a task remembers; then it starts anew.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable and not a space, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """token bytes -> rank from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model proto whose piece ids are the ranks; the unknown piece comes after them."""
    chars = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_chunk(1, _chunk(1, "".join(chars[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -i)) for i, t in enumerate(tokens)]
    pieces.append(_chunk(1, _chunk(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _chunk(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _chunk(2, trainer) + _chunk(3, normalizer)


class Codec:
    """Encodes and decodes with one vocabulary; built once in each Python worker."""

    def __init__(self, lines: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(lines)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.tokens = np.array(sorted(self.ranks, key=self.ranks.__getitem__), object)
        self.split = regex.compile(pattern).findall
        self.table = dict(zip(range(256), byte_characters()))
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Like encode, for each text; pre-tokens not seen before go to the model in one call."""
        known, split = self.known, [self.split(text) for text in texts]
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list(set().union(*split).difference(known))
        raw = [w.encode() for w in fresh]
        rest = []
        for w, r in zip(fresh, raw):
            rank = self.ranks.get(r)
            if rank is None:
                rest.append((w, r.decode("latin-1").translate(self.table)))
            else:  # a token that is a whole pre-token stands for it, as its rank says
                known[w] = rank.to_bytes(4, "little")
        if rest:
            ids = self.model.encode([r for _, r in rest], num_threads=1)
            ends = np.cumsum([len(x) for x in ids]) * 4
            flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
            start = 0
            for (w, _), end in zip(rest, ends.tolist()):
                known[w] = flat[start:end]
                start = end
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(2)
def _codec(lines_file: str, pattern: str) -> Codec:
    with open(SparkFiles.get(lines_file), "rb") as f:
        return Codec(f.read(), pattern)


def _encoded(name: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            counts, ids_of, back_of, kept = [], [], [], []
            for ids in codec.encode_all(batch.column(1).fill_null("").to_pylist()):
                counts.append(len(ids) // 4)
                ids_of.append(hashlib.sha256(ids).hexdigest())
                back_of.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_of), pa.array(back_of)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def tokenize(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of ``docs``.

    ``vocabulary`` is a file of base64 tokens and ranks, shipped to the executors by Spark. A null or empty text has no
    tokens; very long texts are encoded whole; repeated rows and null ids are encoded like any other row; other columns
    are not read. ``ids_sha256`` digests the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` the bytes
    that decoding gives back. An empty table gives an empty table.
    """
    small_batches(spark)
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rsplit("/", 1)[-1]
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_encoded(name, pattern, with_ids), shape)
