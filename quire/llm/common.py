"""Shared pieces: scratch tables, hold-out columns, and word hashing straight from Arrow buffers."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one on a local master (as in tests);
    an error on a cluster, whose executors do not see the driver's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the scratch folder, which Hadoop removes when the driver's JVM ends; clean_up() removes it before."""
    path = f"{scratch_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    where, files = _hadoop(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    _made.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clean_up(spark: SparkSession) -> None:
    """Remove the scratch tables made so far, once all results that read them are written."""
    while _made:
        where, files = _hadoop(spark, _made.pop())
        files.delete(where, True)


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared scratch folder and read it back.

    Cuts the lineage durably: a lost executor costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (0 for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _byte_values() -> np.ndarray:
    """One fixed random value a byte; A-Z share those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    v[65:91] = v[97:123]
    return v


@functools.cache
def word_bytes(kind: str) -> np.ndarray:
    """Which bytes belong to words: 'space' splits at \\x09-\\x0D and \\x20, 'alnum' keeps 0-9, a-z, A-Z and non-ASCII."""
    ok = np.ones(256, bool)
    if kind == "space":
        ok[9:14] = False
        ok[32] = False
    else:
        ok[:128] = False
        for lo, hi in ((48, 58), (65, 91), (97, 123)):
            ok[lo:hi] = True
    return ok


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASE)
    inv = pow(base, -1, 1 << 64)
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, b in ((up, base), (down, inv)):
        out[0] = 1
        out[1:] = b
        np.cumprod(out, out=out)
    return up, down


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows, without copying; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def word_hashes(data: np.ndarray, offs: np.ndarray, kind: str, prefixes: tuple[int, ...] = ()) -> tuple:
    """Hashes of all words of all rows, A-Z lower-cased.

    Returns (hash, row, [hash of the first p bytes for p in prefixes]); a prefix hash of a shorter word is 0.
    Works in blocks cut between words, so a text of any length needs only its words' hashes in memory.
    """
    ok, values = word_bytes(kind), _byte_values()
    n, out, at = len(data), [], 0
    starts = np.unique(offs[:-1])
    while at < n:
        end = min(n, at + _BLOCK)
        while end < n:
            stop = np.flatnonzero(~ok[data[end : end + _BLOCK]])
            bound = starts[np.searchsorted(starts, end)] if len(starts) and starts[-1] >= end else n
            end = min(int(bound), end + int(stop[0])) if len(stop) else min(int(bound), end + _BLOCK)
            if len(stop) or end == bound:
                break
        block = data[at:end]
        inside = ok[block]
        first = np.zeros(len(block), bool)
        s = starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)] - at
        first[s] = True
        first[0] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:]
        b = np.flatnonzero(begin)
        if len(b):
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:]
            e = np.flatnonzero(last) + 1
            up, down = _powers(max(_BLOCK, 1 << (len(block) - 1).bit_length()))
            cum = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(values[block] * up[: len(block)], out=cum[1:])
            lens = (e - b).astype(np.uint64)
            h = mix((cum[e] - cum[b]) * down[b] ^ lens * np.uint64(0xD6E8FEB86659FD93))
            row = np.searchsorted(offs, b + at, side="right") - 1
            more = []
            for p in prefixes:
                q = np.minimum(b + p, len(block))
                x = mix((cum[q] - cum[b]) * down[b] ^ np.uint64(0xA0761D6478BD642F + p))
                x[e - b < p] = 0
                more.append(x)
            out.append((h, row, *more))
        at = end
    if not out:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), [np.empty(0, np.uint64) for _ in prefixes])
    cols = [np.concatenate(c) if len(out) > 1 else c[0] for c in zip(*out)]
    return cols[0], cols[1], cols[2:]


def slices(col: pa.Array, most: int = 1 << 21):
    """Cut a column into runs of rows of about `most` bytes each; yields (first row, column)."""
    _, offs = buffers(col)
    at, n = 0, len(col)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield at, col.slice(at, end - at)
        at = end


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
