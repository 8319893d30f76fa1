"""What the operators share: the shared folder, Arrow batches and word hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to Python; documents can be long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Words worked on at once in numpy.
CHUNK_WORDS = 400_000
#: Bytes hashed at once.
SEGMENT = 1 << 20

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in one process with its executors, a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor loses nothing.

    An aggregate that is joined back on its own key is written first as well: the join's sides then each
    come from a plain exchange, and only such joins have their skewed partitions split at run time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() wrote and nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle makes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def checked_keep(keep: list[str] | None, made: list[str]) -> list[str]:
    """The columns to hand on; one that is also a column of the result has no place there."""
    if both := sorted(set(keep or []) & set(made)):
        raise ValueError(f"columns of the result can't be handed on: {both}")
    return list(keep or [])


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows and about BATCH_BYTES: options that are read when the query runs,
    so they stay set in the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def digest(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_WORDS words (6 bytes each) of text, one document at least."""
    for batch in batches:
        texts = texts_of(batch.column(column))
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= 6 * CHUNK_WORDS or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


class Words:
    """The words of several texts, found and hashed without a Python object for each.

    hashes: 64 bits of each word, all texts one after another; offsets: text i has words offsets[i] to
    offsets[i + 1]; starts, ends: their bytes in data. A word's hash is a polynomial of its bytes, taken
    from running sums over a segment, and mixed.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join([*texts, b""])
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        parts = [self._segment(i, j) for i, j in self._segments()]
        self.starts, self.ends, self.hashes = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
        self.offsets = np.searchsorted(self.starts, begins)

    def _segments(self):
        """Pieces of about SEGMENT bytes that end in white space."""
        i = 0
        while i < len(self.data):
            j = min(i + SEGMENT, len(self.data))
            while j < len(self.data) and not _SPACE[self.data[j - 1]]:
                j += 1
            yield i, j
            i = j

    def _segment(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(self.data, np.uint8, j - i, i)
        edge = np.diff(np.concatenate([[1], _SPACE[a], [1]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _powers(j - i)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return starts + i, ends + i, mixed(h + (ends - starts).astype(np.uint64) * _MIX2)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (over all texts), joined by one blank."""
        return b" ".join(self.data[self.starts[i] : self.ends[j - 1]].split())

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words joined by one blank, and where each begins there, with one place past the last."""
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts + 1, out=at[1:])
        return b" ".join(self.data.split()), at


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, SEGMENT)
        for k, b in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= _MIX1
    h ^= h >> np.uint64(33)
    h *= _MIX2
    h ^= h >> np.uint64(33)
    return h


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    size = len(h) - n + 1
    g = h[:size].copy()
    for j in range(1, n):
        g *= _BASE
        g += h[j : j + size]
    return mixed(g)


def words_sql(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LETTER = re.compile(r"[^\W\d_]")
