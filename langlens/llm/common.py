"""What the training-data operators share: shared storage and vectorised text scans.

Row conventions of all operators: a null text is the empty text; a null id is kept as null; rows that
repeat are separate documents; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared storage; a local one only where none is configured and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}/langlens-shared"
    return f"{base.rstrip('/')}/langlens/{name}-{uuid.uuid4().hex}"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """The shuffles of what is made and run within end with their job, not when the driver collects its garbage."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before) if before else spark.conf.unset(clean)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in shared storage: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """documents() with a 128-bit key of id and text: rows with equal keys are equal."""
    text = documents(docs)
    return text.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit("k2"))})


def trim() -> None:
    """Gives memory that was freed back to the system: Python workers live on, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the rows' offsets in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(at: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class RollingHash:
    """64-bit polynomial hashes of any slices of a byte sequence, by prefix sums modulo 2**64. Only for slices of fewer than
    1,024 bytes, or where equal hashes are harmless: longer ones collide by design if they follow the Thue-Morse sequence.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.table = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.pow = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow))
            with np.errstate(over="ignore"):
                inverse = pow(self.BASE, -1, 1 << 64)
                powers = [np.full(n + 1, x, np.uint64) for x in (self.BASE, inverse)]
                for x in powers:
                    x[0] = 1
                self.pow, self.inv = (np.cumprod(x, dtype=np.uint64) for x in powers)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over 64-bit values (bytes go through a random table)."""
        if values.dtype == np.uint8:
            values = self.table[values]
        self._grow(len(values) + 1)
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum(values * self.pow[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes that slice_hashes works on at once, and places whose multipliers are kept.
_HASH_BYTES, _HASH_PLACES = 1 << 18, 1 << 12
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_MULTIPLIERS = mix(np.arange(1, _HASH_PLACES + 1, dtype=np.uint64) * _PLACE)


def slice_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of bytes that follow one another without overlap: the sum of each byte's random number
    times a random number of its place in the slice, modulo 2**64. As every place has its own multiplier, no two
    texts of any length, however regular, collide but by the chance of 64 bits."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    with np.errstate(over="ignore"):
        for lo in range(int(start[0]), int(end[-1]), _HASH_BYTES):
            hi = min(lo + _HASH_BYTES, int(end[-1]))
            a, b = int(np.searchsorted(end, lo, "right")), int(np.searchsorted(start, hi, "left"))
            if a == b:
                continue
            origin = np.zeros(hi - lo, np.int64)
            origin[0] = min(int(start[a]), lo)
            inner = start[a:b]
            inner = inner[inner > lo]
            origin[inner - lo] = inner
            np.maximum.accumulate(origin, out=origin)
            place = np.arange(lo, hi) - origin
            far = int(place.max()) >= _HASH_PLACES
            by = mix((place + 1).astype(np.uint64) * _PLACE) if far else _MULTIPLIERS[place]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw[lo:hi]] * by, dtype=np.uint64)])
            out[a:b] += sums[np.minimum(end[a:b], hi) - lo] - sums[np.maximum(start[a:b], lo) - lo]
        return mix(out + (end - start).astype(np.uint64) * _PLACE)


def word_grams(token: np.ndarray, first: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs first to stop of word hashes, of n words at most."""
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            there = first + k < stop
            out[there] += token[(first + k)[there]] * (_MULTIPLIERS[k] | np.uint64(1))
        return mix(out + (stop - first).astype(np.uint64) * _PLACE)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[raw]


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within a row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at[at <= n]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+: starts, ends, and the rows' offsets in the list of words."""
    start, end = spans(~_SPACE[raw], at)
    return start, end, np.searchsorted(start, at)


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] of all i, one after another."""
    total = int(length.sum())
    if not total:
        return values[:0]
    out = np.cumsum(length)
    index = np.arange(total) + np.repeat(start - (out - length), length)
    return values[index]
