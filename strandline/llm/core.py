"""Shared parts: the shared folder, written tables, text chunks of Arrow batches, and a vectorised word tokenizer.

Text travels to Python as Arrow batches and is handled as one byte array per chunk, so the work per byte is a few
numpy passes and no Python loop runs per row, word or byte.
"""

from __future__ import annotations

import atexit
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import shared_dir, ship

#: Bytes of text handled at once in a worker; a longer document is a chunk of its own.
CHUNK = 4 << 20
#: Bytes hashed at once inside a chunk; bounds the scratch arrays however long a document is.
BLOCK = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: ASCII letters and digits and every byte of a multi-byte character belong to words; all else separates them.
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_EXACT = np.arange(256, dtype=np.uint64) + np.uint64(1)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a cut of the lineage that outlives any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a written table; one that is gone already, or a session that has ended, is no error."""
    if getattr(spark.sparkContext, "_jsc", None) is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidy(run):
    """run, a function of batches, and then the memory that it used given back: idle workers are kept, and an executor's memory is theirs too."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its rows' offsets in them (one more than rows). A null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(col: pa.Array, limit: int = CHUNK):
    """(first row, end row, bytes, offsets) of runs of rows of up to limit bytes, or of one longer row."""
    data, offs = text_bytes(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _P if kind == "up" else _P_INV
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, disjoint spans; equal bytes hash alike wherever they are."""
    out = np.empty(len(start), np.uint64)
    table, i = _LOWER if lower else _EXACT, 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        part = data[base : int(end[j - 1])]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[part] * _pow("up", len(part)), out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _pow("down", len(part) + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, row) of every word. No word crosses a row's end."""
    is_word = _WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = is_word[1:] != is_word[:-1]
    edge[0], edge[-1] = (is_word[0], is_word[-1]) if len(data) else (False, False)
    flips = np.flatnonzero(edge)
    start, end = flips[0::2], flips[1::2]
    # A word that runs over a row's end is two words.
    cuts = offs[1:-1]
    if len(start) and len(cuts):
        cuts = np.unique(cuts)
        at = np.searchsorted(start, cuts, "left") - 1
        inside = cuts[(at >= 0) & (cuts < end[np.maximum(at, 0)]) & (cuts > start[np.maximum(at, 0)])]
        if len(inside):
            start = np.sort(np.concatenate([start, inside]))
            end = np.sort(np.concatenate([end, inside]))
    row = np.searchsorted(offs, start, "right") - 1
    return span_hash(data, start, end, lower), start, end, row


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on; the last n - 1 positions are left out."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as doubles in [0, 1)."""
    return (h >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def ids_only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names, so that no other column can clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
