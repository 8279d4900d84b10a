"""What the text operators share: table reading, lineage cuts and vectorised word hashing.

Hashes are 64-bit. They only ever propose; where a wrong match would change a result the
operator compares the bytes or the full sets afterwards, or uses 128 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stowage.sources.shared import cut, forget  # noqa: F401  every operator's modules take them from here

#: Bytes of text that one vectorised step works on; bounds the memory of a task.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, beyond its first row; Spark's own bound is 64 MB for each of several copies.
BATCH_BYTES = 2 << 20
#: Rows of a table of one or two numbers that may be broadcast; a larger one is joined by shuffling.
MAX_BROADCAST = 500_000
#: Rows that a Parquet reader holds at a time.
READ_ROWS = 512

T = TypeVar("T")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)
_letters = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows; df must be cheap to read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _begin(module: str) -> None:
    """Drop what another operator's tasks left in this worker. (A function of the module: a nested one's globals are copies in a worker.)"""
    if _resident and _resident[0][0] != module:
        _resident.clear()


def _release() -> None:
    """Give memory back that a task used: Arrow's, and what the C library keeps of freed arrays where it can say so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, one generator call for each batch; batches without rows are skipped.

    Sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` to BATCH_BYTES, and
    ``spark.sql.parquet.columnarReaderBatchSize`` to READ_ROWS: thousands of long texts are no batch.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))

    module = step.__module__

    def run(batches):
        _begin(module)
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        _release()

    return df.mapInArrow(run, schema)


_resident: list = []


def resident(module: str, key: object, make: Callable[[], T]) -> T:
    """What make() returns, which a Python worker keeps from task to task: one such object, until a task of another module begins."""
    if not _resident or _resident[0] != (module, key):
        _resident[:] = [(module, key), make()]
    return _resident[1]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``most`` bytes each, one row at least."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _grown(base: int, n: int) -> np.ndarray:
    made = np.full(max(n + 1, 1 << 16), base, _U)
    made[0] = 1
    return np.multiply.accumulate(made)


def powers(n: int) -> np.ndarray:
    """B ** 0 ... B ** n modulo 2 ** 64, kept for the life of the worker."""
    global _powers
    if len(_powers) <= n:
        _powers = _grown(_BASE, n)
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    """B ** 0 ... B ** -n modulo 2 ** 64; B is odd, so it has an inverse."""
    global _inverse
    if len(_inverse) <= n:
        _inverse = _grown(pow(_BASE, -1, 1 << 64), n)
    return _inverse


def prefix_sums(codes: np.ndarray, family: int = 0) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of letter[codes[k]] * B ** k for i <= k < j; of two families with letters of their own."""
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum(_letters[family][codes] * powers(len(codes))[: len(codes)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the codes stand."""
    return (sums[end] - sums[start]) * inverse_powers(len(sums) - 1)[start]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    Returns the joined bytes, the byte offset of each text in them, and for each word its
    text's index, start and end.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=at[1:])
    gap = _white[joined]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(joined) and not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    return joined, at, np.searchsorted(at, start, "right") - 1, start, end


def word_hashes(joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(spans_hash(prefix_sums(joined), start, end)) if len(start) else np.zeros(0, _U)


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; crossing of texts is for the caller to mask."""
    if len(word) < n:
        return np.zeros(0, _U)
    out = word[: len(word) - n + 1] * _GRAM[0]
    for k in range(1, n):
        out = mix(out) + word[k : len(word) - n + 1 + k] * _GRAM[k % len(_GRAM)]
    return mix(out)
