"""Work in chunks of documents that ask buckets of hashes about the whole corpus.

A chunk is a few MB of documents, chosen by the id's hash; a bucket is a range of 64-bit hashes.  Chunks send
each bucket one packed array of the distinct hashes they hold, so what a very common value costs is one entry
a chunk, not one an occurrence, and buckets answer the chunks.  Numbers of both follow the size of the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import shuffle_partitions

CHUNK_BYTES = 4 << 20
#: Hashes are cut to their upper bits, so that differences of sorted ones fit four bytes as a rule.
HASH_BITS = 48


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def pieces(spark: SparkSession, total: int, size: int = CHUNK_BYTES, spread: int = 2) -> int:
    """Chunks or buckets of about `size` bytes for `total`; a few for each shuffle partition, so that partitions are even."""
    return max(total // size + 1, spread * shuffle_partitions(spark))


def chunk_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def bucket_edges(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted (HASH_BITS wide) hashes starts; one entry more than buckets."""
    edges = (np.arange(n_buckets, dtype=np.float64) * (float(1 << HASH_BITS) / n_buckets)).astype(np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences of four bytes, or as they are if one doesn't fit."""
    if not len(values):
        return b""
    steps = np.diff(values)
    if len(steps) and int(steps.max()) >= 1 << 32:
        return b"\x08" + values.tobytes()
    return b"\x04" + values[:1].tobytes() + steps.astype(np.uint32).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    if blob[0] == 8:
        return np.frombuffer(blob, np.uint64, offset=1)
    first = np.frombuffer(blob, np.uint64, 1, 1)
    return np.cumsum(np.concatenate((first, np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64))), dtype=np.uint64)
