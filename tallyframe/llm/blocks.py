"""Hashed words of whole texts, and the exchange between document blocks and hash shards.

Statistics over all n-grams of a corpus would move one row per n-gram. Instead, documents are dealt into
blocks of bounded size; a block sends each shard one packed list of its distinct keys, the shard answers
with one packed list in the same order, and the block's documents meet the answers in a second pass over
the same dealing (one exchange, used twice).
"""

from __future__ import annotations

import ctypes
import inspect
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, about, and rows at most.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 14
#: Words whose hashes a task remembers; beyond it, it starts again.
REMEMBERED = 1 << 18


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words(text: bytes) -> list[bytes]:
    """Words as [^\\x20\\x09-\\x0D]+ with A-Z lowered; bytes.lower and bytes.split touch ASCII alone."""
    return text.lower().split()


def hashes(text: bytes, known: WordHashes) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; of the whole sequence, if it is shorter; none of none."""
    n = len(h)
    if not n:
        return h
    width = min(width, n)
    out = mixed(h[: n - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return out


def blocked(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(id, text as bytes, h: its hash, block), and the number of blocks, which follows the bytes of text and the rows.

    Rows that repeat an id and a text are spread by their place in the input, so no block gathers them; the
    input is a table, or anything else whose rows come in the same order when a lost task is repeated.
    """
    total, rows = df.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    blocks = max(1, -(-(total or 0) // BLOCK_BYTES), -(-rows // BLOCK_ROWS))
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("h"))
    return docs.withColumn("block", F.pmod(F.xxhash64("id", "h", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), blocks


def in_order(t: pa.Table) -> pa.Table:
    """The rows of a block in an order that doesn't depend on how they arrived."""
    return t.sort_by([("id", "ascending"), ("text", "ascending")])


def packed(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpacked(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def gaps(sorted_values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences: their low 16 bits, apart from the rare higher bits."""
    d = np.diff(sorted_values, prepend=np.uint64(0))
    low = (d & np.uint64(0xFFFF)).astype(np.uint16)
    high = d >> np.uint64(16)
    at = np.flatnonzero(high)
    parts = [np.array([len(d), len(at)], np.uint32).tobytes(), low.tobytes()]
    if len(at) * 3 < len(d):
        parts += [at.astype(np.uint32).tobytes(), high[at].astype(np.uint64).tobytes()]
    else:
        parts += [(high & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), (high >> np.uint64(16)).astype(np.uint32).tobytes()]
    return zlib.compress(b"".join(parts), 1)


def from_gaps(b: bytes) -> np.ndarray:
    raw = zlib.decompress(b)
    n, m = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
    d = np.frombuffer(raw, np.uint16, n, 8).astype(np.uint64)
    at = 8 + 2 * n
    if m * 3 < n:
        d[np.frombuffer(raw[at : at + 4 * m], np.uint32)] += np.frombuffer(raw[at + 4 * m :], np.uint64) << np.uint64(16)
    else:
        d += np.frombuffer(raw[at : at + 2 * n], np.uint16).astype(np.uint64) << np.uint64(16)
        d += np.frombuffer(raw[at + 2 * n :], np.uint32).astype(np.uint64) << np.uint64(32)
    return np.cumsum(d, dtype=np.uint64)


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(f):
    """f, a function of Arrow groups, with release() after each call."""

    def call(*args):
        try:
            return f(*args)
        finally:
            release()

    if inspect.isgeneratorfunction(f):
        def each(batches):
            try:
                yield from f(batches)
            finally:
                release()

        return each

    # Spark counts the parameters
    return (lambda a: call(a), lambda a, b: call(a, b), lambda a, b, c: call(a, b, c))[f.__code__.co_argcount - 1]
