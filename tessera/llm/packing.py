"""Best-fit packing of token pieces into sequences, after Martello and Toth's reduction.

Method. Documents longer than a sequence are cut into full pieces and a shorter
first one. What has to be packed is then known from a histogram: how many pieces
there are of each of at most ``capacity`` lengths. The plan is made on that
histogram (bounded at any size of the input), a run of equal sequences at a time:

1. Reduction. For each length, longest first, the set of partners that dominates
   all others is looked for: alone if nothing fits beside it; one partner if it
   fills the sequence, or if it is at least as long as any two that fit
   together; two partners if one is the longest that fits and the other at least
   as long as the shorter of any two that fit. Such sequences belong to a best
   packing and are fixed for good, as many at once as there are pieces.
2. Best fit, longest first, for what is left.

Each piece then gets its number among the pieces of its length (counted by length
and block, so that a length that a third of all pieces have is spread out) and
looks up the run that number falls in; sequence and place follow by arithmetic.

Defined cases: a null or empty text is the end id alone; a long text is encoded in
one go (its ids take four bytes each) and cut; repeated rows are pieces of their
own; pieces of one length are numbered by block, id, piece and checksum, so which of
two equal pieces takes which place says nothing; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions, public_id, save, slices
from .tokens import SLICE, encoder, with_end

#: Pieces of a length that one block counts, about.
BLOCK_ROWS = 50_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Left:
    """Lengths that are left, with counts; ``sorted`` holds those with a count."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.n)

    def take(self, length: int, how_many: int) -> None:
        self.n[length] -= how_many
        if not self.n[length]:
            del self.n[length]
            self.sorted.pop(bisect_left(self.sorted, length))

    def longest(self, room: int, beside: tuple[int, ...] = ()) -> int:
        """The longest piece of at most ``room``, when those in ``beside`` are taken; 0 if none."""
        i = bisect_right(self.sorted, room) - 1
        while i >= 0:
            x = self.sorted[i]
            if self.n[x] > beside.count(x):
                return x
            i -= 1
        return 0

    def shortest(self, how_many: int, beside: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for x in self.sorted:
            out += [x] * min(self.n[x] - beside.count(x), how_many - len(out))
            if len(out) == how_many:
                break
        return out

    def times(self, pattern: tuple[int, ...]) -> int:
        return min(self.n[x] // pattern.count(x) for x in set(pattern))


def _dominant(left: _Left, length: int, capacity: int) -> tuple[int, ...] | None:
    """The sequence with a piece of this length that dominates all others with it, if there is one."""
    room = capacity - length
    one = left.longest(room, (length,))
    if not one:
        return (length,)
    if one == room:
        return (length, one)
    least = left.shortest(3, (length,))
    if len(least) < 2 or least[0] + least[1] > room:
        return (length, one)
    if len(least) == 3 and sum(least) <= room:
        return None  # sets of three partners are not looked into
    # pairs that fit: the longest sum, and the longest shorter member
    most, shorter = 0, 0
    for x in left.sorted:
        if 2 * x > room and x > room - least[0]:
            break
        y = left.longest(room - x, (length, x))
        if y:
            most, shorter = max(most, x + y), max(shorter, min(x, y))
    if one >= most:
        return (length, one)
    two = left.longest(room - one, (length, one))
    return (length, one, two) if two and two >= shorter else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in a sequence, number of such sequences) that use up all pieces."""
    left, runs = _Left(counts), []
    changed = True
    while changed:
        changed = False
        for length in sorted(left.n, reverse=True):
            while left.n.get(length) and (best := _dominant(left, length, capacity)):
                times = left.times(best)
                for x in best:
                    left.take(x, times)
                runs.append((best, times))
                changed = True
    return runs + _best_fit(left, capacity)


def _best_fit(left: _Left, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the room they have
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, times))

    for length in sorted(left.n, reverse=True):
        todo = left.n[length]
        while todo:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                room, pattern, times = capacity, (), todo // (capacity // length) + 1
            else:
                room = rooms[i]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            each = room // length  # the emptied room stays the tightest, so a sequence is filled up
            full = min(times, todo // each)
            add(room - each * length, (*pattern, *[length] * each), full)
            todo -= full * each
            if full < times and todo:
                add(room - todo * length, (*pattern, *[length] * todo), 1)
                todo, full = 0, full + 1
            if pattern:
                add(room, pattern, times - full)
    return [run for some in open_.values() for run in some]


def _slots(runs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by their number among them: arrays sorted by (length, from)."""
    met: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in runs:
        offset = 0
        for length in pattern:
            low = met.get(length, 0)
            rows.append((length, low, sequence, offset))
            met[length] = low + times
            offset += length
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "low": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def _cut(tokenizer: str, space_leads: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, space_leads)
        for b in slices(batches, most=SLICE):
            ids, offsets = with_end(*enc.encode(b.column("text")), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            rows: list[tuple] = []
            for doc, low, high in zip(b.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                n = high - low
                first = (n - 1) % capacity + 1
                begins = [0, *range(first, n, capacity)]
                for piece, (start, end) in enumerate(zip(begins, [*begins[1:], n])):
                    rows.append((doc, piece, start, end - start, zlib.crc32(raw[4 * (low + start) : 4 * (low + end)])))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        key = s["length"].astype(np.float64)
        first = {int(x): (int(np.searchsorted(key, x)), int(np.searchsorted(key, x, "right"))) for x in np.unique(s["length"])}
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.zeros(b.num_rows, np.int64)
            for x in np.unique(length).tolist():
                low, high = first[x]
                which = length == x
                at[which] = low + np.searchsorted(s["low"][low:high], rank[which], "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(s["sequence"][at] + rank - s["low"][at]), pa.array(s["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, space_leads: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    spark = df.sparkSession
    pieces = save(documents(df, id_col, text_col).mapInArrow(_cut(tokenizer, space_leads, end_id, capacity), _PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))
    blocks = max(partitions(spark), sum(counts.values()) // BLOCK_ROWS)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    bases = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("own", own).join(bases, ["length", "block"]).withColumn("number", F.col("base") + F.col("own") - 1)
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(_place(slots), _PIECES + ", sequence_id long, offset long").withColumn("doc_id", public_id())
