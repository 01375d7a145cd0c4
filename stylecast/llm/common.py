"""Small helpers shared by the operators: reading, cutting lineage, words as numpy arrays."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one numpy step works on; a longer single text is one step of its own.
STEP_BYTES = 1 << 21
#: Bytes of text over which the running sum of ``span_hashes`` goes at once, unless one span is longer.
HASH_BYTES = 1 << 18
#: Bytes of an Arrow batch, a little under the power of two to which its buffers grow.
BATCH_BYTES = 14 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse, which they share too, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python are bounded in bytes, not in rows alone, whose texts may be long; a value that the session has stays."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of a wide frame: written as Parquet into the shared folder and read again."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a step of a loop: written and read again, as a checkpoint carries its plan's constraints along, which grow with every join."""
    return written(df, "kept")


def text_or_empty(col="text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        m = max(1 << n.bit_length(), HASH_BYTES + 64)
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(m, np.uint64(base))
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes; ends: where each text of the step ends."""
    return ink_spans(~_WHITE[data], ends)


def ink_spans(ink: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are ink; a run ends where its text ends."""
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = ends[(ends > 0) & (ends < len(ink))]  # a text that ends in a word ends the word
    first[inner] |= ink[inner]
    last[inner - 1] |= ink[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold_case: bool) -> np.ndarray:
    """A 64-bit polynomial hash of each span, from a running sum over the bytes of some spans at a time."""
    out, code, i = np.empty(len(starts), np.uint64), _BYTE_FOLDED if fold_case else _BYTE, 0
    ordered = bool((starts[1:] >= starts[:-1]).all() and (stops[1:] >= stops[:-1]).all())
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + HASH_BYTES, side="right"))) if ordered else len(starts)
        low, high = (int(starts[i]), int(stops[j - 1])) if ordered else (int(starts.min()), int(stops.max()))
        up, down = _power_tables(high - low + 1)
        run = np.zeros(high - low + 1, np.uint64)
        np.cumsum(code[data[low:high]] * up[: high - low], out=run[1:])
        a, b = starts[i:j] - low, stops[i:j] - low
        out[i:j] = mix((run[b] - run[a]) * down[a] ^ (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place of every byte of the spans, one after the other; no span is empty."""
    if not len(starts):
        return np.zeros(0, np.int64)
    out = np.ones(int(lengths.sum()), np.int64)
    out[0] = starts[0]
    out[np.cumsum(lengths)[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return np.cumsum(out, out=out)


def distinct_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each distinct content, and the number of each span's content among them.

    Spans of one hash are compared byte by byte; should two contents share a hash, contents are told apart themselves.
    """
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, same = stops - starts, True
    for i in range(0, len(starts), 1 << 16):  # in parts, as each byte has a place of eight
        at, n, rep = starts[i : i + (1 << 16)], lengths[i : i + (1 << 16)], first[of[i : i + (1 << 16)]]
        same = same and np.array_equal(n, lengths[rep]) and np.array_equal(data[spread(at, n)], data[spread(starts[rep], n)])
    if same:
        return first, of
    seen: dict[bytes, int] = {}
    of = np.fromiter((seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.int64, len(starts))
    return np.unique(of, return_index=True)[1], of


def give_back() -> None:
    """Freed memory goes back to the system: workers wait for their next task beside others that need it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """(first, last) text of each step: consecutive texts of so many bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    if n and offsets[n] - offsets[0] > most >> 2:
        give_back()


def string_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column, nulls as empty ones, without a copy."""
    import pyarrow as pa
    import pyarrow.compute as pc

    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets
