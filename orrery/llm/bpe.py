"""Byte-level BPE through a sentencepiece model that is written straight from the ranks.

Every vocabulary entry becomes a piece whose characters stand for its bytes (byte b is
U+0100 + b), scored by its negative rank, under identity normalisation; sentencepiece then
merges as byte-level BPE does.  Texts are cut into pre-tokens first, and each is encoded
by itself; decoding looks ids up in the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import text_chunks

#: Pre-tokens remembered by a worker; longer ones than CACHED_CHARS are not remembered.
CACHE_ENTRIES = 600_000
CACHED_CHARS = 48
#: Texts up to this length are cut into pre-tokens whole.
LONG_CHARS = 1_000_000
_FIRST = 0x100
_SPELT = {b: _FIRST + b for b in range(256)}


def _spelt(data: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return data.decode("latin-1").translate(_SPELT)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file on the driver: token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model in its wire format; piece r + 1 is rank r, piece 0 is unknown.

    Ranks must be 0 .. n-1, and every single byte must have one.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    pieces = [_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2)]
    for rank, token in enumerate(tokens):
        name = _spelt(token).encode()
        pieces.append(_field(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    trainer = _flag(3, 2) + _flag(4, len(pieces)) + _flag(24, 0) + _flag(40, 0)
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # no bos, eos, pad
    normal = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encodes and decodes with one model; made once in every Python worker."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.cut, self.each = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks
        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.digits = list(map(str, range(len(ranks))))
        self.shared = list(range(len(ranks)))  # one object for each id
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> None:
        data = [w.encode() for w in words]
        shared = self.shared
        for word, raw, ids in zip(words, data, self.pieces.encode([_spelt(x) for x in data], num_threads=1)):
            whole = self.ranks.get(raw)  # a vocabulary entry stands for itself
            self.known[word] = (shared[whole],) if whole is not None else tuple([shared[i - 1] for i in ids])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of every text; pre-tokens that are new are encoded together.

        Of a text longer than ``LONG_CHARS`` the pre-tokens are taken so many at a time, so
        that only its ids are held whole.
        """
        long = [i for i, t in enumerate(texts) if t and len(t) > LONG_CHARS]
        cut = [self.cut(t) if t and len(t) <= LONG_CHARS else [] for t in texts]
        out = self._encode(cut)
        for i in long:
            matches = (m.group() for m in self.each(texts[i]))
            while part := list(islice(matches, LONG_CHARS // 4)):
                out[i].extend(self._encode([part])[0])
        return out

    def _encode(self, cut: list[list[str]]) -> list[list[int]]:
        known = self.known
        words = set().union(*cut)
        new = words.difference(known)
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = words
        if new:
            self._learn(list(new))
        out = [list(chain.from_iterable(map(known.__getitem__, w))) for w in cut]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out

    def listed(self, ids: list[int]) -> str:
        """The ids as decimal text joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(spark, path: str, pattern: str):
    """A function giving the worker's codec.  What is broadcast is the vocabulary file."""
    ranks = read_ranks(path)
    sent = spark.sparkContext.broadcast((model_bytes(ranks), ranks, pattern))
    made: list[Codec] = []

    def get() -> Codec:
        if not made:
            made.append(Codec(*sent.value))
        return made[0]

    return get


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key`` and the token ``ids`` of every whole text; a null text encodes as empty."""
    codec = _codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            ids = codec().encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(coded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key`` and the exact ``data`` bytes that ``ids`` stand for; null ids decode as empty."""
    codec = _codec(coded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [codec().decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(data, pa.binary())], names=["key", "data"])

    kind = dict(coded.dtypes)[key]
    return coded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded,
    and with ``with_ids`` the ``ids`` themselves.

    A null text is the empty one: no tokens.  Repeated rows and null keys keep their rows, other
    columns are left out, and an empty table gives an empty one.  A task holds the ids of one
    long text, about 40 bytes for each, and not its pre-tokens.
    """
    codec = _codec(docs.sparkSession, path, pattern)
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            n, coded, back, kept = [], [], [], []
            for ids in codec().encode(batch.column("text").to_pylist()):
                n.append(len(ids)), coded.append(hashlib.sha256(codec().listed(ids).encode()).hexdigest())
                back.append(hashlib.sha256(codec().decode(ids)).hexdigest())
                if with_ids:
                    kept.append(pa.array(ids, pa.int32()))
            columns = [batch.column("key"), pa.array(n, pa.int64()), pa.array(coded), pa.array(back)]
            if with_ids:
                offsets = pa.array(list(accumulate(map(len, kept), initial=0)), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(kept)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("key", key)
