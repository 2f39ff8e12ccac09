"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

A rank file lists byte strings in merge order. `sentencepiece_model` turns it into a serialised BPE model: every byte
becomes one fixed character, every byte string one piece scored by its negative rank, and the normaliser is the
identity. Merging the best-scored adjacent pair first is then the same as merging the lowest rank first.

Texts are cut by a pattern and each match is encoded separately. A match that is itself a token is that token, as rank
file encoders do. Ids are the ranks. Null texts count as empty and give an empty list.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.registry import query, table

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
# One character for each byte: 256 letters from U+0100 on, none of them white space.
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]
# Matches longer than this are rarely seen twice; the cache starts anew when it is full.
CACHED_LENGTH = 48
CACHE_ENTRIES = 250_000
BLOCK_CHARS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field in protocol buffer wire format."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


_TO_CHARS = {b: char for b, char in enumerate(BYTE_CHARS)}


def _mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised model whose piece i is the token of the i-th smallest rank; the unknown piece comes last."""
    # Fixed values of the model format: piece types, model type, field numbers.
    unknown, bpe = 2, 2
    pieces = [
        _field(1, _field(1, _mapped(token).encode()) + _field(2, -float(rank)))
        for token, rank in sorted(ranks.items(), key=lambda item: item[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    no_id = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(i, no_id) for i in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder of one vocabulary. The packed ids of a match are kept, as most matches recur."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # White space is the Unicode property, also where a Python engine adds control characters to \s.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.by_piece = np.array(sorted(ranks.values()), dtype="<u4")
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.cache: dict[str, bytes] = {}

    def _encode_matches(self, matches: list[str]) -> dict[str, bytes]:
        """Packed ids of different matches, through one call of the model."""
        data = [m.encode() for m in matches]
        out = {m: struct.pack("<I", self.ranks[d]) for m, d in zip(matches, data, strict=True) if d in self.ranks}
        rest = [(m, d) for m, d in zip(matches, data, strict=True) if m not in out]
        if rest:
            # Byte 255 is in no UTF-8 text and separates the matches while they are mapped together.
            mapped = _mapped(b"\xff".join(d for _, d in rest)).split(BYTE_CHARS[255])
            lists = self.model.encode(mapped, num_threads=1)
            ends = np.cumsum([len(x) for x in lists]) * 4
            flat = self.by_piece[np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=ends[-1] // 4)].tobytes()
            start = 0
            for (m, _), end in zip(rest, ends.tolist(), strict=True):
                out[m] = flat[start:end]
                start = end
        return out

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        packed = []
        for block in _blocks(texts):
            parts = [self.split(t) for t in block]
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            missing = [m for m in set(chain.from_iterable(parts)) if m not in self.cache]
            fresh = self._encode_matches(missing)
            long = {m: x for m, x in fresh.items() if len(m) > CACHED_LENGTH}
            self.cache.update(fresh)
            packed += [b"".join(map(self.cache.__getitem__, p)) for p in parts]
            for m in long:
                del self.cache[m]
        offsets = np.zeros(len(packed) + 1, dtype=np.int64)
        np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
        return np.frombuffer(b"".join(packed), dtype="<i4"), offsets

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


class Decoder:
    """Bytes of ids; needs neither the model nor what it keeps."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all lists one after another, offsets of the lists)."""
        data = [b"".join(map(self.tokens.__getitem__, ids[a:b].tolist())) for a, b in pairwise(offsets.tolist())]
        ends = np.zeros(len(offsets), dtype=np.int64)
        np.cumsum([len(x) for x in data], out=ends[1:])
        return b"".join(data), ends

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids, np.array([0, len(ids)]))[0]


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about BLOCK_CHARS characters, so that the matches of a batch need little memory."""
    block, size = [], 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, read from the tokenizer file every machine has."""
    return Codec(read_ranks(path), pattern)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an array of integer lists; null lists are empty."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    return np.asarray(lists.flatten(), dtype=np.int32), np.concatenate([[0], np.cumsum(lengths)])


def _binary(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def encode(text: Column | str, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of a text as an array of integers."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        values, offsets = codec(path, pattern).encode_all(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    # The planner would otherwise copy the call into every use of its result and encode once for each.
    return ids.asNondeterministic()(text)


def decode(ids: Column | str, path: str) -> Column:
    """Bytes of the text the ids stand for; an id outside the vocabulary fails, a null list gives no bytes."""

    @F.arrow_udf("binary")
    def data(lists: pa.Array) -> pa.Array:
        return _binary(*decoder(path).decode_all(*_flat(lists)))

    return data(ids)


def packed(ids: Column | str) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        values, offsets = _flat(lists)
        return _binary(np.ascontiguousarray(values, dtype="<i4"), offsets * 4)

    return pack(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows of `docs` with the ids of their texts; a column called `out` is replaced."""
    return docs.withColumn(out, encode(F.col(text), path))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    return docs.withColumn(out, decode(F.col(ids), path))


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(DEFAULT_RANKS)
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    back = decode_documents(coded, path).withColumn("packed", packed("ids"))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
