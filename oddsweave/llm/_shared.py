"""Helpers that several training-data operators share.

Texts reach Python as Arrow batches.  ``slabs`` cuts a batch into pieces of a
bounded number of bytes, so a task's memory does not depend on how many long
documents happen to meet in one batch; ``Words`` finds all words of a slab with
array operations and gives each a 64-bit hash that depends on its bytes alone.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

SLAB_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240117))
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The session names it (``spark.checkpoint.dir``).  Where it doesn't, one
    process alone may use a temporary folder of its own; a cluster may not.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="oddsweave-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a finished query where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, a lost executor loses nothing.

    What was shuffled to make it isn't needed again, so its files go at once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_key(docs: DataFrame, key: str) -> Column:
    """The key column as a 64-bit number.  Keys are whole numbers (or null); any other type is refused before a job runs."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"column {key} is of type {kind.simpleString()}; keys must be whole numbers")
    return F.col(f"`{key}`").cast("long")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all ``taken`` (letter case aside)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null values count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def slabs(batch: pa.RecordBatch, column: str = "text", size: int = SLAB_BYTES):
    """Runs of rows of at most ``size`` bytes of text (or one longer row): first row, end row, bytes, offsets."""
    data, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def texts_of(data: np.ndarray, at: np.ndarray) -> list[str]:
    """The texts of a slab."""
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans; equal bytes give equal hashes wherever they stand."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LETTER[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        i = j
    return mix(out)


class Words:
    """All words (runs of bytes other than \\x20 and \\x09-\\x0D) of a slab.

    ``data`` has one line feed more behind every document; ``first`` says at
    which word each document starts (one entry more at the end).  ``space``
    says which bytes part words; line feeds must.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        docs = len(at) - 1
        self.doc_at = at + np.arange(docs + 1)
        flat = np.full(len(data) + docs, 10, np.uint8)
        keep = np.ones(len(flat), bool)
        keep[self.doc_at[1:] - 1] = False
        flat[keep] = _LOWER[data] if lower else data
        edge = np.diff(np.concatenate(([True], space[flat], [True])).view(np.int8))
        self.data, self.starts, self.ends = flat, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.starts, self.doc_at)
        self.docs = docs

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.per_doc)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that stay inside one document, and at which word each starts."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    inside = np.ones(len(out), bool)
    for k in range(1, n):
        cut = first[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(out))]] = False
    at = np.flatnonzero(inside)
    return out[at], at


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each document."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)))
    return total[first[1:]] - total[first[:-1]]
