"""Asking all of a corpus about hashed keys: chunks of documents send their distinct keys to buckets, buckets answer each chunk.

A chunk is a set of documents given by a hash of the id, a few MB of text; a bucket is a range of hashes. What travels is packed:
a row for each chunk and bucket, holding arrays of the chunk's distinct keys in order, and back an array of one answer a key. A key that
fills a third of the corpus is thus at most one entry of each chunk, and no chunk or bucket grows with the corpus: their number does.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and most bytes of text in a chunk, and keys in a bucket: they bound a task's memory. Between them both follow the corpus, so that a row
#: of the exchange stays worth its overhead.
CHUNK_BYTES, BUCKET_KEYS = (2 << 20, 16 << 20), (1 << 17, 1 << 20)
MOST_PARTITIONS = 20_000
_U = np.uint64


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def counts(total_bytes: int, keys_a_byte: float) -> tuple[int, int]:
    """Numbers of chunks and of buckets for this much text."""
    keys = total_bytes * keys_a_byte
    chunk = min(max(total_bytes / 1024, CHUNK_BYTES[0]), CHUNK_BYTES[1])
    bucket = min(max(keys / 512, BUCKET_KEYS[0]), BUCKET_KEYS[1])
    return max(8, math.ceil(total_bytes / chunk)), max(8, math.ceil(keys / bucket))


def dealt(df: DataFrame, column: str, n: int) -> DataFrame:
    """df with one partition for each of n chunks or buckets, up to MOST_PARTITIONS: tasks stay small however much there is, and beyond it take group after group."""
    return df.repartition(min(n, MOST_PARTITIONS), column)


def chunk_of(doc_id: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def placed(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Each key's bucket (from its upper half) above its lower 40 bits: what tells it from others in the exchange."""
    bucket = ((keys >> _U(32)) * _U(n_buckets)) >> _U(32)
    return (bucket << _U(40)) | (keys & _U((1 << 40) - 1))


def bucket_cuts(sorted_placed: np.ndarray, n_buckets: int) -> np.ndarray:
    return np.searchsorted(sorted_placed >> _U(40), np.arange(n_buckets + 1, dtype=np.uint64))


def pack(x: np.ndarray, width: int) -> bytes:
    """The lower width bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")
