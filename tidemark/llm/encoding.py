"""Encoding of a corpus with a public byte-level BPE vocabulary, through sentencepiece.

A sentencepiece BPE model is serialised directly from the vocabulary's rank file:
one piece per token, its bytes mapped to one character each, its score the
negative rank, no normalisation and no handling of white space.  sentencepiece
then merges the pair with the highest score (the lowest rank) first, leftmost
first, which is the vocabulary's own rule.  Texts are cut into pre-tokens by the
vocabulary's pattern, the distinct pre-tokens of a batch are encoded once, and
texts are put together from them.

Nothing is trained.  The vocabulary's folder is a parameter; the driver reads it
and the model's 1.3 MB travel with the task.

Defined cases: null, empty texts: an empty list; wording that looks like a
special token is plain text; lone surrogates become U+FFFD; repeated rows are
each encoded.
"""

from __future__ import annotations

import base64
import importlib.util
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Distinct pre-tokens kept between batches, and the longest one kept.
CACHE_SIZE, CACHE_LENGTH = 400_000, 48
_SHIFT = 0x100  # byte b is written as the character U+0100 + b
_TO_CHARS = {b: chr(_SHIFT + b) for b in range(256)}


def read_ranks(folder: str, name: str) -> list[bytes]:
    """Tokens by rank of a rank file (base64 token, blank, rank)."""
    ranks = {}
    for line in Path(folder, f"{name}.tiktoken").read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def read_pattern(folder: str) -> str:
    """The pattern that cuts texts into pre-tokens, as the vocabulary's package states it."""
    spec = importlib.util.spec_from_file_location("_vocabulary_package", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: bytes and text by length, floats in four bytes, whole numbers as varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, str):
        return _field(number, value.encode())
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value) & (1 << 64) - 1)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with the tokens as pieces, ids as in the vocabulary, and an unknown piece after them."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "".join(map(_TO_CHARS.get, t))) + _field(2, -float(rank)) + _field(3, normal) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, "<unk>") + _field(2, -float(len(tokens))) + _field(3, unknown))
    trainer = (
        _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, "<unk>")
    )  # model type, vocabulary size, ids of unk, bos, eos, pad, unk piece
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, no trimming, no escapes
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


@lru_cache(maxsize=4)
def _processor(model: bytes, pattern: str):
    import regex
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model), regex.compile(pattern)


class Encoder:
    """Encodes batches of texts; keeps what it knows of frequent pre-tokens."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.processor, self.pattern = _processor(model, pattern)
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        long: dict[str, list[int]] = {}
        if new:
            mapped = [p.encode("utf-8", "replace").decode("latin-1").translate(_TO_CHARS) for p in new]
            for p, ids in zip(new, self.processor.encode(mapped, num_threads=1), strict=True):
                (known if len(p) <= CACHE_LENGTH else long)[p] = ids
        get = known.__getitem__ if not long else lambda p: long[p] if p in long else known[p]
        out = [list(chain.from_iterable(map(get, parts))) for parts in cut]
        if len(known) > CACHE_SIZE:
            known.clear()
        return out


def decode(ids: list[int], tokens: list[bytes]) -> str:
    """The inverse mapping: the tokens' bytes put together."""
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def _encode_batches(model: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        for batch in batches:
            step = 512
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitions only where the scan has fewer tasks than the cluster has cores (few, unsplittable files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < cores else df


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each document, without special tokens."""
    model = serialise_model(read_ranks(folder, vocabulary))
    pairs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    return pairs.mapInArrow(_encode_batches(model, read_pattern(folder)), f"doc_id {dict(documents.dtypes)[doc_id]}, ids array<int>")
