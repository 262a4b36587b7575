"""Line dedup: a line that many documents hold stays in one of them only.

Method. Each document's lines become 128-bit hashes of their keys (the line
stripped of ASCII white space, A-Z lower-cased), one row for each hash of a
document. The rows are range-partitioned by (hash, document) and sorted within
partitions by hash, document descending and position, so a hash that a third of
all documents hold takes as many partitions as its rows fill. One pass streams
each partition: the first document of a hash (the largest id) keeps its lines,
the others lose theirs once the hash has been met in ``least_docs`` documents.
Only the first and last hash of a partition can go on elsewhere; their counts
(two rows a partition at most) are summed afterwards. What comes back is a
deflated bitmap for each document; texts never travel with the hashes.

Defined cases: a null or empty text is one empty line; a long text's lines are
hashed one by one, and its bitmap has a bit for each up to its last lost line; rows
that repeat an id are one document for the count, and each row loses its own lines;
of the documents that hold a line the one with the largest id keeps it, in all its
rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop, free_names, partitions, public_id, save, slices, small

_BLANK = b" \t\n\x0b\x0c\r"
_PLACES = pa.list_(pa.int32())
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("places", _PLACES)])
_LINES_DDL = "h1 long, h2 long, doc_id long, text_hash long, places array<int>"
#: kind 0: these lines go; 1: undecided, a row of a hash that may go on in another partition; 2: what this
#: partition knows of such a hash (doc_id: the largest document, text_hash: the number of documents).
_RUNS = pa.schema([("kind", pa.int32()), *_LINES])
_GOES, _OPEN, _COUNT = 0, 1, 2
#: Rows of hashes that one partition sorts, about.
PART_ROWS = 2_000_000


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _hash_lines(least_chars: int):
    def long_enough(key: bytes) -> bool:
        return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, ids, texts, places, ends = [], [], [], [], [0]
            for doc, of, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                met: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.encode().split(b"\n")):
                    if len(line) >= least_chars and long_enough(key := line_key(line)):
                        met.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for h, at in met.items():
                    hashes.append(h)
                    ids.append(doc)
                    texts.append(of)
                    places += at
                    ends.append(len(places))
            if ids:
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))], schema=_LINES)

    return run


class _Stream:
    """One sorted partition, batch by batch; it holds fewer than ``least`` documents' rows."""

    def __init__(self, least: int):
        self.least, self.key, self.doc = least, None, None
        self.is_first, self.seen, self.top, self.held = True, 0, 0, []

    def rows(self, kind: int, rows: pa.RecordBatch, but: int | None = None) -> Iterator[pa.RecordBatch]:
        if but is not None:
            rows = rows.filter(pa.array(rows.column("doc_id").to_numpy() != but))
        if rows.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int32)), *rows.columns], schema=_RUNS)

    def count(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": _COUNT, "h1": self.key[0], "h2": self.key[1], "doc_id": self.top, "text_hash": self.seen, "places": []}], schema=_RUNS)

    def feed(self, rows: pa.RecordBatch, key: tuple[int, int], docs: int) -> Iterator[pa.RecordBatch]:
        """Some rows of one hash, ``docs`` documents of which have not been seen."""
        if key != self.key:
            if self.key is not None:
                if self.is_first:
                    yield self.count()
                self.is_first = False
            self.key, self.seen, self.top, self.held = key, 0, rows.column("doc_id")[0].as_py(), []
        self.seen += docs
        if self.is_first:
            yield from self.rows(_OPEN, rows)
        elif self.seen < self.least:
            self.held.append(rows)
        else:
            for x in (*self.held, rows):
                yield from self.rows(_GOES, x, but=self.top)
            self.held = []

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            for x in self.held:
                yield from self.rows(_OPEN, x)
            yield self.count()

    def batch(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2, ids = (rows.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        n = len(ids)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh = np.ones(n, bool)
        fresh[1:] = new[1:] | (ids[1:] != ids[:-1])
        fresh[0] = self.key != (h1[0], h2[0]) or self.doc != ids[0]
        self.doc = ids[-1]
        begin = np.flatnonzero(new)
        low, high = (begin[1], begin[-1]) if len(begin) > 1 else (n, n)
        yield from self.feed(rows.slice(0, low), (h1[0], h2[0]), int(fresh[:low].sum()))
        if high > low:  # the hashes that begin and end in this batch
            group = np.cumsum(new[low:high]) - 1
            docs = np.bincount(group, fresh[low:high])[group]
            top = ids[begin[1:-1]][group]
            yield from self.rows(_GOES, rows.slice(low, high - low).filter(pa.array((docs >= self.least) & (ids[low:high] != top))))
        if high < n:
            yield from self.feed(rows.slice(high), (h1[high], h2[high]), int(fresh[high:].sum()))


def _stream(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(least_docs)
        for rows in batches:
            if rows.num_rows:
                yield from state.batch(rows)
        yield from state.end()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, sizes = [], []
        for at in b.column("places"):
            at = at.values.to_numpy()
            bits = np.ones(int(at.max()) + 1, np.uint8)
            bits[at] = 0
            sizes.append(len(bits))
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_bits", "bitmap"])


def keep_lines(text: str, n_bits: int | None, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay and the number of all; lines past the bitmap's end stay."""
    lines = text.split("\n")
    if bitmap is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_bits, bitorder="little").tolist()
    return [x for x, bit in zip(lines, bits) if bit] + lines[n_bits:], len(lines)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n, kept, digest = [], [], []
        for x in zip(*(b.column(c).to_pylist() for c in ("text", "n_bits", "bitmap")), strict=True):
            lines, all_lines = keep_lines(*x)
            n.append(all_lines)
            kept.append(all_lines - len(lines))
            digest.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.int64()), pa.array(digest)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


@F.arrow_udf(T.StringType())
def _kept_text(text: pa.Array, n_bits: pa.Array, bitmap: pa.Array) -> pa.Array:
    return pa.array([x if z is None or x is None else "\n".join(keep_lines(x, y, z)[0]) for x, y, z in zip(text.to_pylist(), n_bits.to_pylist(), bitmap.to_pylist(), strict=True)], pa.string())


def line_bitmaps(df: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_bits, bitmap) for each document that loses a line; a clear bit is a lost line."""
    docs = documents(df, id_col, text_col)
    lines = save(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_hash_lines(least_chars), _LINES_DDL), "lines")
    n = max(partitions(df.sparkSession), lines.count() // PART_ROWS)
    ranged = lines.repartitionByRange(n, "h1", "h2", F.col("doc_id").desc()).sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), F.element_at("places", 1))
    runs = save(ranged.mapInArrow(_stream(least_docs), "kind int, " + _LINES_DDL), "line-runs")
    drop(lines)
    # two rows for each partition at most
    sums = runs.filter(F.col("kind") == _COUNT).groupBy("h1", "h2").agg(F.sum("text_hash").alias("docs"), F.max("doc_id").alias("top")).filter(F.col("docs") >= least_docs)
    open_ = runs.filter(F.col("kind") == _OPEN).join(small(sums, 2 * n), ["h1", "h2"]).filter(F.col("doc_id") != F.col("top"))
    goes = runs.filter(F.col("kind") == _GOES).select("doc_id", "text_hash", "places").unionByName(open_.select("doc_id", "text_hash", "places"))
    return goes.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("places")).alias("places")).mapInArrow(_bitmaps, "doc_id long, text_hash long, n_bits int, bitmap binary")


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents' side is the streamed side of a hash join: its texts are shuffled once and not sorted."""
    return docs.join(bitmaps.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")


def dedup_lines(df: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the lost lines taken out of its text column; other columns as they were."""
    bitmaps = line_bitmaps(df, least_chars, least_docs, id_col, text_col)
    names = free_names(df, *bitmaps.columns)
    doc_id, text_hash, n_bits, bitmap = (F.col(f"`{x}`") for x in names)
    text = F.col(f"`{text_col}`")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    joined = df.join(bitmaps.toDF(*names).hint("shuffle_hash"), (key == doc_id) & (F.xxhash64(F.coalesce(text, F.lit(""))) == text_hash), "left")
    return joined.withColumn(text_col, _kept_text(text, n_bits, bitmap)).select(*(F.col(f"`{c}`") for c in df.columns))


def line_digests(df: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: lines, lines lost, SHA-256 of what is left."""
    docs = documents(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    out = _with_bitmaps(docs, line_bitmaps(df, least_chars, least_docs, id_col, text_col))
    return out.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string").withColumn("doc_id", public_id())
