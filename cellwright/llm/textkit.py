"""Array helpers that run inside Arrow tasks: whole texts as bytes, words, hashes and sliding extremes.

Everything here works on one bounded slice of a partition (``SLICE_BYTES`` of text, or one longer document) and keeps
no state between slices.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
HASHED_WORDS = 1 << 15
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: A fixed random word for each byte value.
BYTE_WORD = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of its own only where none is named and all executors are in this process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir().rstrip("/")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared checkpoint folder, under a name of its own."""
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: workers are kept for the next stage, and what they hold counts there."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the n + 1 offsets of its rows."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def words(buf: np.ndarray, offs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in table ``of``, none across rows, and each row's first word."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = of[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    fresh = edge[:-1].copy()
    fresh[1:] |= ~m[:-1]
    fresh[0] = True
    last = edge[1:].copy()
    last[:-1] |= ~m[1:]
    last[-1] = True
    starts, ends = np.flatnonzero(m & fresh), np.flatnonzero(m & last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _MUL, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_WORD) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``HASHED_WORDS`` at a time, as a byte takes up to 48 of them on the way."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(starts) > HASHED_WORDS:
        parts = range(0, len(starts), HASHED_WORDS)
        return np.concatenate([word_hashes(buf, starts[i : i + HASHED_WORDS], ends[i : i + HASHED_WORDS], table) for i in parts])
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(first, length)
    at = place + np.repeat(starts, length)
    x = table[buf[at]] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(x, first) + length.astype(np.uint64) * _ODD)


def window_hashes(tok: np.ndarray, k: int, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The hash of every run of k tokens, by joining runs of doubled lengths."""
    if len(tok) < k:
        return np.zeros(0, np.uint64)
    mul = lambda n: np.uint64(pow(by, n, 1 << 64))
    out, done, run, size = None, 0, tok, 1
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out, done = run, size
            else:
                m = len(tok) - done - size + 1
                out, done = out[:m] * mul(size) + run[done : done + m], done + size
        bits >>= 1
        if bits:
            m = len(run) - size
            run, size = run[:m] * mul(size) + run[size : size + m], 2 * size
    return mix(out)


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """The minimum or maximum (``op``) of every w neighbours, by doubling."""
    if len(a) < w:
        return a[:0]
    size = 1
    while 2 * size <= w:
        a = op(a[:-size], a[size:])
        size *= 2
    return a if size == w else op(a[: len(a) - (w - size)], a[w - size :])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some w neighbours: any w in a row hold one, chosen by their content alone."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h)


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def ragged(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of each of the runs that ``bounds`` cut."""
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def packed(rows: np.ndarray) -> bytes:
    """Fixed-size rows, compressed byte column by byte column."""
    return zstandard.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes(), 1)


def unpacked(data: bytes, dtype: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    return raw.T.copy().view(dtype).ravel()


def carried(docs: DataFrame, text_col: str, columns: list[str] | None = None) -> DataFrame:
    """Rows (or some of their columns) as one struct beside the text, so that no name can clash with an operator's own."""
    row = F.struct(*[docs[c] for c in (docs.columns if columns is None else columns)])
    return docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))


def carried_schema(rows: DataFrame, extra: str) -> T.StructType:
    """The schema of ``row`` and of the columns that the DDL ``extra`` names."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(extra).fields])
