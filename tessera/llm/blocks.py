"""Documents in blocks that ask hash buckets how often their hashes occur, and get an answer back.

A block is a hash share of the documents, small enough for arrays in memory. It
sends each bucket (a range of 64-bit hashes) one row with its sorted distinct
hashes; a bucket sees every block's row and answers each in the same order. So
a table of hashes is partitioned, joined and summed with a row for each block and
bucket, not for each hash, and a hash that is in all documents comes once from
each block. The exchange by block is the same in each step and Spark reuses it.

Rows stay in proportion to the input: a block writes to ``MOST_ROWS`` buckets at
most. Where there are more buckets than that, the exchange has two steps.
Buckets are then parts of coarse ones, about as many coarse ones as parts; the
rows that a region of blocks sends to a coarse bucket are merged first, and what
is merged goes on to the parts; answers come back the same way. A block sends a
row to each coarse bucket, and a region (as many blocks as a coarse bucket has
parts) a row to each bucket, so both steps have blocks x coarse buckets rows, and
each merge holds about as much as a block: two steps reach to ``MOST_ROWS`` squared
buckets.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Bytes of text whose hashes one bucket gets, and the least and the most that one block holds.
BUCKET_BYTES, LEAST_BLOCK, MOST_BLOCK = 4 << 20, 6 << 20, 16 << 20
#: Buckets that a block writes rows for, at most.
MOST_ROWS = 4096

REQUEST = "bucket int, block int, hashes binary, counts binary"
REPLY = "block int, bucket int, totals binary"
_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])


class Route(NamedTuple):
    """How hashes travel: ``coarse`` x ``fine`` buckets, regions of ``region`` blocks, ``drop`` low bits of a hash unused."""

    coarse: int
    fine: int
    region: int
    drop: int = 0

    @property
    def buckets(self) -> int:
        return self.coarse * self.fine


def route(buckets: int, most_rows: int | None = None) -> Route:
    most_rows = MOST_ROWS if most_rows is None else most_rows
    if buckets <= most_rows:
        return Route(buckets, 1, 1)
    fine = math.ceil(math.sqrt(buckets))
    return Route(math.ceil(buckets / fine), fine, fine)


def in_blocks(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Route, int]:
    """The documents as (block, doc_id, h1, text), the route of their hashes, and the bytes of all texts.

    Blocks and buckets follow the bytes of all texts, so neither a block's nor a
    bucket's arrays grow with the input. A block is a share by id and text, so
    rows with one id (null, say) are spread out.
    """
    docs = documents(df, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    block = min(max(LEAST_BLOCK * math.sqrt(total / 2**30), LEAST_BLOCK), MOST_BLOCK)
    blocks = max(1, math.ceil(total / block))
    h1 = F.xxhash64("text")
    return docs.select(F.pmod(F.xxhash64("doc_id", h1), F.lit(blocks)).cast("int").alias("block"), "doc_id", h1.alias("h1"), "text"), route(max(1, math.ceil(total / BUCKET_BYTES))), total


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts hashes, equal ones as they stood, and where each hash begins in it.

    One sort of plain integers: a hash's upper bits with its place below them. The
    few that differ only in the bits which the place took are put in order afterwards.
    """
    n = len(h)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    x = h & ~low
    x |= np.arange(n, dtype=np.uint64)
    x.sort()
    x &= low
    order = x.view(np.int64)
    s = h[order]
    step = s[1:] ^ s[:-1]
    new = np.ones(n, bool)
    np.not_equal(step, 0, out=new[1:])
    step >>= bits
    mixed = new[1:] & (step == 0)
    del step
    if mixed.any():
        top = s >> bits
        group = np.cumsum(np.append(True, top[1:] != top[:-1])) - 1
        wrong = np.zeros(int(group[-1]) + 1, bool)
        wrong[group[1:][mixed]] = True
        at = np.flatnonzero(wrong[group])
        order[at] = order[at][np.lexsort((order[at], s[at]))]
        s = h[order]
        new[1:] = s[1:] != s[:-1]
    return order, new


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: ranges of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_ranges(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket that is there, for the buckets of sorted hashes."""
    if not len(bucket):
        return []
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)]))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def put_numbers(values: np.ndarray) -> bytes:
    """Integers of at least 0, byte by byte of equal weight, with as many bytes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + squeeze(np.ascontiguousarray(planes).tobytes())


def get_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def put_sorted(hashes: np.ndarray, drop: int = 0) -> bytes:
    """Sorted integers as their differences, without ``drop`` low bits."""
    return put_numbers(np.diff(hashes >> np.uint64(drop), prepend=np.uint64(0)))


def get_sorted(data: bytes, drop: int = 0) -> np.ndarray:
    return np.cumsum(get_numbers(data), dtype=np.uint64) << np.uint64(drop)


def put(values: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(values).tobytes())


def get(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(unsqueeze(data), kind)


def request(asker: int, hashes: np.ndarray, counts: np.ndarray, buckets: int, drop: int) -> pa.Table:
    """An asker's rows: its sorted distinct hashes and their counts, by bucket."""
    some = bucket_ranges(bucket_of(hashes, buckets))
    return pa.table([
        pa.array([k for k, _, _ in some], pa.int32()), pa.array([asker] * len(some), pa.int32()),
        pa.array([put_sorted(hashes[a:z], drop) for _, a, z in some], pa.binary()),
        pa.array([put_numbers(counts[a:z]) for _, a, z in some], pa.binary()),
    ], schema=_REQUEST)


class _Asked:
    """The rows of several askers, summed."""

    def __init__(self, rows: pa.Table, drop: int):
        hashes = [get_sorted(x, drop) for x in rows["hashes"].to_pylist()]
        self.ends = np.cumsum([len(x) for x in hashes])
        flat = np.concatenate(hashes)
        self.order, new = grouped(flat)
        begin = np.flatnonzero(new)
        self.hashes = flat[self.order[begin]]
        counts = np.concatenate([get_numbers(x) for x in rows["counts"].to_pylist()])
        self.counts = np.add.reduceat(counts[self.order], begin)
        self.which = np.cumsum(new) - 1

    def answers(self, totals: np.ndarray) -> list[bytes]:
        """Each row's totals in its own order."""
        back = np.empty(len(self.order), np.uint64)
        back[self.order] = totals[self.which]
        return [put_numbers(x) for x in np.split(back, self.ends[:-1])]


def _replies(rows: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table([rows["block"].combine_chunks(), rows["bucket"].combine_chunks(), pa.array(answers, pa.binary())], schema=_REPLY)


def _sum(drop: int, most: int | None):
    def run(rows: pa.Table) -> pa.Table:
        asked = _Asked(rows, drop)
        return _replies(rows, asked.answers(asked.counts if most is None else np.minimum(asked.counts, most)))

    return run


def _merge(route: Route):
    def run(rows: pa.Table) -> pa.Table:
        asked = _Asked(rows, route.drop)
        return request(rows["region"][0].as_py(), asked.hashes, asked.counts, route.buckets, route.drop)

    return run


def _hand_back(drop: int):
    def run(rows: pa.Table, far: pa.Table) -> pa.Table:
        return _replies(rows, _Asked(rows, drop).answers(totals_of(far)))

    return run


def totals_of(replies: pa.Table) -> np.ndarray:
    """The totals of all buckets in a row."""
    rows = sorted(zip(replies["bucket"].to_pylist(), replies["totals"].to_pylist()))
    return np.concatenate([get_numbers(x) for _, x in rows]) if rows else np.zeros(0, np.uint64)


def totals(asked: DataFrame, route: Route, most: int | None = None) -> DataFrame:
    """(block, bucket, totals): for each ``request`` the sums over all blocks, to ``most``, in the order of its hashes."""
    if route.fine == 1:
        return asked.groupBy("bucket").applyInArrow(_sum(route.drop, most), REPLY)
    asked = asked.withColumn("region", F.expr(f"block div {route.region}").cast("int"))
    merged = asked.groupBy("region", "bucket").applyInArrow(_merge(route), REQUEST)
    far = merged.groupBy("bucket").applyInArrow(_sum(route.drop, most), REPLY)
    far = far.withColumnRenamed("block", "region").withColumn("coarse", F.expr(f"bucket div {route.fine}").cast("int"))
    return asked.groupBy("region", "bucket").cogroup(far.groupBy("region", "coarse")).applyInArrow(_hand_back(route.drop), REPLY)
