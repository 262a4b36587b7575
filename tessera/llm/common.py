"""What the corpus operators share: scratch tables, text slices, word hashes.

Conventions of every operator here
* it reads the columns it is told to read and nothing else, so further columns
  of the input, whatever their names, cannot clash with its own;
* a null text is an empty text; a null id is one more id, below all others;
* scratch tables go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Stands for a null id inside an operator.
NO_ID = -(2**63)
#: Bytes of text that one numpy pass works on (a longer text is a slice of its own).
SLICE = 1 << 20

with contextlib.suppress(OSError, AttributeError):  # arrays reuse memory while a task runs; tidy() gives it back (glibc: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD)
    ctypes.CDLL(None).mallopt(-3, 1 << 25)
    ctypes.CDLL(None).mallopt(-1, 1 << 28)

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession) -> str:
    """The shared folder for scratch tables."""
    return shared_folder(spark)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: a cut in the lineage that survives executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a saved table that no later plan reads."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if the ``rows`` that it can have at most are few."""
    return F.broadcast(df) if rows <= most else df


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators read, null-free: ``doc_id`` long, ``text`` string."""
    return df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def semi_join(df: DataFrame, keys: DataFrame, *values) -> DataFrame:
    """``df``'s rows whose ``values`` are a row of ``keys``, whatever the names of either's columns."""
    keys = keys.toDF(*free_names(df, *keys.columns))
    on = [value.eqNullSafe(F.col(f"`{name}`")) for value, name in zip(values, keys.columns, strict=True)]
    return df.join(keys.hint("shuffle_hash"), reduce(and_, on), "left_semi")


def public_id(name: str = "doc_id"):
    """The id as the caller had it."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each holds about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.cumsum(np.diff(_offsets(batch.column(text))), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            base = at[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(at, base + most, "right")))
            yield batch.slice(low, high - low)
            low = high
    tidy()


def tidy() -> None:
    """Give memory back: a worker waits for its next task beside others that need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in a row, and where each text begins (one entry more than texts)."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = _offsets(texts).astype(np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words (runs of anything but space, tab, LF, VT, FF, CR) of a slice of texts, as arrays.

    ``first``: each text's first word, one entry more than texts; ``hash``: 64
    bits for each word, from its bytes alone.
    """

    def __init__(self, texts: pa.Array, hashed: bool = True):
        self.data, self.offsets = text_bytes(texts)
        n, data = len(self.data), self.data
        self.inside = ~_WS[data]
        begins, ends = self.inside.copy(), self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        ends[:-1] &= ~self.inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begins[edges] = self.inside[edges]
        ends[edges - 1] = self.inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        if hashed:
            self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.starts)

    def _hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        power = np.multiply.accumulate(np.full(int(length.max()), _STEP, np.uint64))
        value = _BYTE[self.data[self.inside]] * power[place]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, and the index of each run's first word."""
        last = len(self) - n + 1
        if last <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(last, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + self.hash[i : i + last] + np.uint64(i + 1))
        ok = self.text_of[:last] == self.text_of[n - 1 :]
        return h[ok], np.flatnonzero(ok)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
