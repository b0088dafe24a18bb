"""Shared helpers: names that can't clash, shared folders, flat views of Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy kernel works on at once, at some 60 bytes of memory each; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
_LOCAL: dict[str, str] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with *base* that *df* doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a temporary folder serves local masters only;
    a cluster without the setting is an error, as executors couldn't read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.get("dir") or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tierlens-"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """*df* written as Parquet to the shared folder and read again: cuts the lineage."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_bytes(df: DataFrame) -> DataFrame:
    """*df*, with the session's Arrow batches limited by bytes: ten thousand texts at once would be a large part of a small executor.

    A limit that the session sets itself, if smaller, stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = df.sparkSession.conf.get(name).lower().removesuffix("b")
    if not given.isdigit() or not 0 < int(given) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns what is free to the system: a worker outlives its tasks, and its allocators keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """*run*, which gives back its memory when a task is done."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return all_of


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and offsets (n + 1); null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of *texts*, of at most *most* bytes unless one text is longer."""
    _, at = flat(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield texts.slice(start, min(end, len(texts)) - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of ASCII white space, and line ends.
WHITE, NEWLINE = (np.isin(np.arange(256), x) for x in ([9, 10, 11, 12, 13, 32], [10]))
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def parts(raw: np.ndarray, at: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, offsets) of the runs of each text's bytes that lie between those of *between*.

    The hash of bytes i..j is the sum of (byte + 1) * odd**k, divided by
    odd**i, modulo 2**64, and then mixed with the length.
    """
    inside = ~between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    inside[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(inside) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(raw)), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, at)
