"""Suffix-array dedup: take out every byte of a long string that an earlier document holds.

A byte goes if it is covered by a string of ``length`` bytes that also starts in
a document with a smaller id. The strings are found by sorting suffixes.

Which suffixes have to be sorted. All of a corpus' suffixes at this depth are
many times its size, so only those that can have an equal are sorted. Every
window of ``length`` bytes has a minimiser: the ``seed``-byte string in it with
the smallest hash. Equal windows have equal minimisers, so a window whose
minimiser is in one document only is no copy. Minimisers are counted by hash
bucket (module ``blocks``): a lossless sieve, and what passes by chance is
told apart by the sort.

The sort is deep-shallow (Manzini and Ferragina, 2004), by bucket of minimisers,
so equal windows meet. Shallow: multikey quicksort, eight bytes a step, to
``SHALLOW`` bytes; each step sorts only what is still tied. Deep: what is still
tied shares a long prefix and is ordered by blind tries: a tied group's first
suffix is the path, the others branch off it at the byte after their common
prefix (compared a word at a time, the bytes between not looked at), and each
branch is a group of the next level. All groups go down a level together.
Neighbours that agree in ``length`` bytes are one string, whose least document
keeps it.

Windows with one minimiser that stand in a row travel as one run of text. Equal
runs of a block travel once, with their least document, and the answer (a bit for
each window: an earlier document holds it) is applied to all of them at home; so
a passage that a third of all documents hold costs a bucket one run from each
block. Texts that equal another document's are set aside first: all but the
smallest id's lose every byte, if they have ``length``.

Defined cases: a null or empty text has no bytes; a text longer than a block is a
block's only long one and goes through the same steps whole (its arrays take about
sixty bytes for each byte); rows that repeat an id are documents of one id and do
not count against one another; of equal strings those in documents with the
smallest id stay, in all of that id's rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import REQUEST, bucket_of, bucket_ranges, get, grouped, in_blocks, put, request, totals, totals_of
from .common import mix, public_id, save, slices, text_bytes

LENGTH, SEED, SHALLOW = 50, 26, 24
#: Bits of a minimiser's hash beyond those that number all minimisers, and the least of all bits; the sieve may pass too much.
SPARE, LEAST_BITS = 10, 40
#: Copies of a row that names a text of several documents.
SALT = 16
_MOST = np.uint64(2**64 - 1)
_FACTORS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
_ASIDE, _KNOWN, _MARKS = 0, 1, 2
_TO_BLOCK = "block int, kind int, bucket int, doc_id long, h1 long, payload binary"
_TO_BLOCK_KIND = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("payload", pa.binary())])
_RUNS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("windows", pa.binary()), ("docs", pa.binary()), ("texts", pa.binary())])


def words_at(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven after it as a big-endian integer; zeros follow the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for width in (1, 2, 4):
        x[:-width] = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x[: len(data)]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _spread(h: np.ndarray) -> np.ndarray:
    """Minimisers are small hashes; another mixing deals them evenly to buckets."""
    return mix(h + np.uint64(0x9E3779B97F4A7C15))


class Windows:
    """A slice's windows and their minimisers. Windows never cross texts."""

    def __init__(self, texts: pa.Array, length: int = LENGTH, seed: int = SEED):
        self.data, self.offsets = text_bytes(texts)
        self.length, n = length, len(self.data)
        span = length - seed + 1
        count = n - length + 1
        self.valid = np.zeros(max(count, 0), bool)
        if count <= 0:
            self.low = np.zeros(0, np.uint64)
            self.seeds, self.seed_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        for a, z in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            if z - a >= length:
                self.valid[a : z - length + 1] = True
        w = words_at(self.data)
        m = n - seed + 1
        # one product for each eight bytes, summed and mixed: what collides only passes the sieve
        h, some = np.zeros(m, np.uint64), np.empty(m, np.uint64)
        for k, at in enumerate([*range(0, seed - 7, 8), seed - 8]):
            np.multiply(w[at : at + m], _FACTORS[k], out=some)
            h += some
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(h, np.uint64(shift), out=some)
            h ^= some
            h *= np.uint64(factor)
        h |= np.uint64(1)  # never the 0 that stands for an invalid window
        self.low = _sliding(h, span, np.minimum)
        top = np.zeros(m + span - 1, np.uint64)
        np.multiply(self.low, self.valid, out=top[span - 1 : span - 1 + count])
        # a seed is picked if it is the least of some window that holds it
        self.seeds = np.flatnonzero(_sliding(top, span, np.maximum)[:m] == h)
        self.raw = h[self.seeds]
        self.seed_hash = _spread(self.raw)
        self.span, self.hashes = span, m

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Whether each window's minimiser is among the picked seeds that are shared."""
        h = np.full(self.hashes, _MOST, np.uint64)
        h[self.seeds[shared]] = self.raw[shared]
        return self.valid & (_sliding(h, self.span, np.minimum) == self.low) & (self.low != _MOST)


def _slices(docs: pa.Table, aside: set) -> list[tuple[pa.RecordBatch, np.ndarray, Windows]]:
    """A block's slices without the texts set aside: rows, ids and windows."""
    out = []
    if docs.num_rows:
        for part in slices(docs.combine_chunks().to_batches(), most=1 << 18):
            keep = np.array([x not in aside for x in zip(part.column("doc_id").to_pylist(), part.column("h1").to_pylist())], bool)
            part = part.filter(pa.array(keep)) if not keep.all() else part
            if part.num_rows:
                out.append((part, part.column("doc_id").to_numpy(), Windows(part.column("text"))))
    return out


def _aside(table: pa.Table) -> set:
    kinds = table["kind"].to_numpy() == _ASIDE
    return {x for x, k in zip(zip(table["doc_id"].to_pylist(), table["h1"].to_pylist()), kinds.tolist()) if k}


def _block_of(docs: pa.Table, more: pa.Table) -> int:
    return (docs if docs.num_rows else more)["block"][0].as_py()


class _Seeds:
    """A block's minimisers: distinct and sorted, 2 where several documents of it hold one, else 1.

    ``which``: for each slice, the place of each of its minimisers among them.
    """

    def __init__(self, block: list, drop: int):
        keep = ~((np.uint64(1) << np.uint64(drop)) - np.uint64(1))
        hashes = [w.seed_hash & keep for _, _, w in block]
        ids = [doc[np.searchsorted(w.offsets, w.seeds, "right") - 1] for _, doc, w in block]
        h, d = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((hashes, np.uint64), (ids, np.int64)))
        order, new = grouped(h)
        begin = np.flatnonzero(new)
        self.hashes, d = h[order[begin]], d[order]
        some = len(begin) > 0
        self.counts = 1 + (np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)) if some else np.zeros(0, np.int64)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        self.which = np.split(which, np.cumsum([len(x) for x in hashes])[:-1]) if hashes else []


def _ask_seeds(route):
    def run(docs: pa.Table, more: pa.Table) -> pa.Table:
        seeds = _Seeds(_slices(docs, _aside(more)), route.drop)
        return request(_block_of(docs, more), seeds.hashes, seeds.counts, route.coarse, route.drop)

    return run


def _to_block(kind: int, asked: pa.Table, payloads: list[bytes]) -> pa.Table:
    n = asked.num_rows
    zero = pa.array(np.zeros(n, np.int64))
    return pa.table([asked["block"].combine_chunks(), pa.array(np.full(n, kind, np.int32)), asked["bucket"].combine_chunks(), zero, zero, pa.array(payloads, pa.binary())], schema=_TO_BLOCK_KIND)


def _of_kind(more: pa.Table, kind: int) -> pa.Table:
    return more.filter(pa.array(more["kind"].to_numpy() == kind))


def _prints(data: np.ndarray, word: np.ndarray, first: np.ndarray, windows: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """64 bits for each run of windows, from its text."""
    size = windows + LENGTH - 1
    h = mix(windows.astype(np.uint64) + np.asarray(salt, np.uint64))
    short = size <= 128
    for step in range(0, 128, 8):
        on = np.flatnonzero(short & (step < size))
        if len(on):
            here = first[on] + np.minimum(step, size[on] - 8)
            h[on] = mix(h[on] * np.uint64(0xFF51AFD7ED558CCD) + word[here])
    for k in np.flatnonzero(~short).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[first[k] : first[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    return h


class _Runs:
    """A block's runs of candidate windows: where they stand, and which are equal."""

    def __init__(self, docs: pa.Table, more: pa.Table, route):
        aside = _aside(more)
        parts = _slices(docs, aside)
        seeds = _Seeds(parts, route.drop)
        shared = totals_of(_of_kind(more, _KNOWN).select(["bucket", "payload"]).rename_columns(["bucket", "totals"])) > 1
        data, base = [], 0
        start, windows, seed, doc, prints = [], [], [], [], []
        for (_, ids, w), which in zip(parts, seeds.which):
            if len(w.seeds):
                at = np.flatnonzero(w.candidates(shared[which]))
                if len(at):
                    low = w.low[at]
                    of = np.searchsorted(w.offsets, at, "right") - 1
                    new = np.append(True, (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (of[1:] != of[:-1]))
                    begin = np.flatnonzero(new)
                    n = np.diff(np.append(begin, len(at)))
                    first = at[begin]
                    h = _prints(w.data, words_at(w.data), first, n, low[begin])
                    start.append(first + base)
                    windows.append(n)
                    seed.append(_spread(low[begin]))
                    prints.append(h)
                    doc.append(ids[of[begin]])
            data.append(w.data)
            base += len(w.data)
        self.data = np.concatenate(data) if data else np.zeros(0, np.uint8)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.windows, self.seed, self.doc, self.prints = join(start, np.int64), join(windows, np.int64), join(seed, np.uint64), join(doc, np.int64), join(prints, np.uint64)
        # equal runs side by side, sorted by bucket; the first of them has the least document
        bucket = bucket_of(self.seed, route.buckets)
        order = np.lexsort((self.doc, self.prints, self.seed))
        for name in ("start", "windows", "seed", "doc", "prints"):
            setattr(self, name, getattr(self, name)[order])
        self.bucket = bucket[order]
        self.first = np.append(True, (self.seed[1:] != self.seed[:-1]) | (self.prints[1:] != self.prints[:-1])) if len(order) else np.zeros(0, bool)

    def asked(self) -> list[tuple[int, np.ndarray]]:
        """The runs that each bucket is asked about: no more rows than runs."""
        one = np.flatnonzero(self.first)
        return [(k, one[a:z]) for k, a, z in bucket_ranges(self.bucket[one])]

    def ask(self, block: int) -> pa.Table:
        out = []
        for k, mine in self.asked():
            n = self.windows[mine]
            size = n + LENGTH - 1
            at = np.repeat(self.start[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.append((k, block, put(n.astype("<i8")), put(self.doc[mine].astype("<i8")), put(self.data[at])))
        return pa.table([pa.array([r[i] for r in out], t.type) for i, t in enumerate(_RUNS)], schema=_RUNS)


def _ask_runs(route):
    def run(docs: pa.Table, more: pa.Table) -> pa.Table:
        return _Runs(docs, more, route).ask(_block_of(docs, more))

    return run


def sort_suffixes(word: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first ``length`` bytes, and which of them begins a new string.

    ``word``: the text's ``words_at``.
    """
    n = len(starts)
    order = np.argsort(word[starts], kind="stable")
    key = word[starts[order]]
    new = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    depth = 8
    while depth < min(shallow, length):  # multikey quicksort: the next eight bytes of what is tied
        tied = _tied(new)
        if not len(tied):
            return order, new
        key = _word(word, starts[order[tied]], depth, length)
        _refine(order, new, tied, (key,))
        depth += 8
    while len(tied := _tied(new)) and depth < length:
        # blind tries: each tied group's first suffix is the path, the others leave it at their common prefix
        group = np.cumsum(new[tied]) - 1
        path = order[tied[np.flatnonzero(new[tied])]][group]
        a, b = starts[order[tied]], starts[path]
        common = np.full(len(tied), length, np.int64)
        byte, over = np.zeros(len(tied), np.int64), np.zeros(len(tied), bool)
        open_ = np.arange(len(tied))
        for at in range(depth, length, 8):
            x, y = _word(word, a[open_], at, length), _word(word, b[open_], at, length)
            differ = x != y
            if differ.any():
                here = open_[differ]
                x, y = x[differ], y[differ]
                skip = _leading_bytes(x ^ y)
                common[here] = at + skip
                byte[here] = (x >> (np.uint64(56) - np.uint64(8) * skip.astype(np.uint64)) & np.uint64(255)).astype(np.int64)
                over[here] = x > y
                open_ = open_[~differ]
            if not len(open_):
                break
        if (common >= length).all():
            return order, new  # every group is one string
        # below the path: the sooner it branches off, the smaller; above it, the greater
        side = np.where(common >= length, 1, np.where(over, 2, 0))
        _refine(order, new, tied, (byte, np.where(side == 0, common, -common), side))
    return order, new


def _word(word: np.ndarray, starts: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Eight bytes at a depth, without those past ``length``."""
    x = word[starts + depth]
    over = depth + 8 - length
    return x >> np.uint64(8 * over) << np.uint64(8 * over) if over > 0 else x


def _tied(new: np.ndarray) -> np.ndarray:
    """Places that are in a group of several."""
    last = np.append(new[1:], True)
    return np.flatnonzero(~(new & last))


def _refine(order: np.ndarray, new: np.ndarray, tied: np.ndarray, keys: tuple[np.ndarray, ...]) -> None:
    """Sort the tied places by group, then by keys (the last one first), and mark where strings now begin."""
    group = np.cumsum(new[tied])
    by = np.lexsort((*keys, group))
    order[tied] = order[tied][by]
    begins = new[tied]
    for k in keys:
        k = k[by]
        begins[1:] |= k[1:] != k[:-1]
    new[tied] = begins


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of non-zero words are zero."""
    n = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        low = x < np.uint64(1) << np.uint64(64 - bits)
        n[low] += bits // 8
        x = np.where(low, x << np.uint64(bits), x)
    return n


def _sort_bucket(asked: pa.Table) -> pa.Table:
    """One bucket: for each run's windows, whether a document before the run's least one holds the string."""
    windows = [get(x, "<i8") for x in asked["windows"].to_pylist()]
    docs = [get(x, "<i8") for x in asked["docs"].to_pylist()]
    texts = [get(x, "u1") for x in asked["texts"].to_pylist()]
    n, doc = np.concatenate(windows), np.concatenate(docs)
    data = np.concatenate([*texts, np.zeros(LENGTH + 8, np.uint8)])
    word = words_at(data)
    size = n + LENGTH - 1
    start = np.cumsum(size) - size
    # equal runs of several blocks are sorted once, for the least document of all
    prints = _prints(data, word, start, n, 0)
    order = np.lexsort((doc, prints))
    first = np.append(True, prints[order][1:] != prints[order][:-1])
    one = order[first]
    which = np.empty(len(n), np.int64)
    which[order] = np.cumsum(first) - 1
    begin = np.cumsum(n[one]) - n[one]
    total = int(n[one].sum())
    starts = np.repeat(start[one] - begin, n[one]) + np.arange(total)
    owner = np.repeat(doc[one], n[one])
    order, new = sort_suffixes(word, starts)
    least = np.empty(total, np.int64)
    least[order] = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    # back to every run's windows
    at = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    earlier = least[at] < np.repeat(doc, n)
    ends = np.cumsum([int(x.sum()) for x in windows])
    return _to_block(_MARKS, asked, [put(np.packbits(x)) for x in np.split(earlier, ends[:-1])])


def _removed(docs: pa.Table, more: pa.Table, route) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Each document's id, bytes and which of them go."""
    aside = _aside(more)
    runs = _Runs(docs, more, route)
    one = np.flatnonzero(runs.first)
    marks = _of_kind(more, _MARKS)
    answers = dict(zip(marks["bucket"].to_pylist(), marks["payload"].to_pylist()))
    bits = [np.unpackbits(get(answers[k], "u1"), count=int(runs.windows[mine].sum())) for k, mine in runs.asked()]
    marks = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    change = np.zeros(len(runs.data) + 1, np.int32)
    if len(one):
        begin = np.cumsum(runs.windows[one]) - runs.windows[one]
        of = np.cumsum(runs.first) - 1
        n = runs.windows
        total = int(n.sum())
        shift = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        # equal runs share their bits; those of a document after the run's least one go in any case
        goes = marks[np.repeat(begin[of], n) + shift] | np.repeat(runs.doc > runs.doc[one][of], n)
        at = (np.repeat(runs.start, n) + shift)[goes]
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    covered = np.cumsum(change[:-1]) > 0
    base = 0
    if docs.num_rows:
        for part in slices(docs.combine_chunks().to_batches(), most=1 << 18):
            for doc, h1, text in zip(part.column("doc_id").to_pylist(), part.column("h1").to_pylist(), part.column("text").to_pylist()):
                raw = text.encode()
                if (doc, h1) in aside:
                    yield doc, raw, np.full(len(raw), len(raw) >= LENGTH)
                else:
                    yield doc, raw, covered[base : base + len(raw)]
                    base += len(raw)


def _digest(route):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(docs: pa.Table, more: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for doc, raw, gone in _removed(docs, more, route):
            n = int(gone.sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
            out.append((doc, len(raw), n, spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(columns)], names=names)

    return run


def _spans(route):
    def run(docs: pa.Table, more: pa.Table) -> pa.Table:
        ids, begins, ends = [], [], []
        for doc, _, gone in _removed(docs, more, route):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            ids += [doc] * (len(edge) // 2)
            begins += edge[::2].tolist()
            ends += edge[1::2].tolist()
        return pa.table([pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "begin", "end"])

    return run


def _apply(df: DataFrame, id_col: str, text_col: str, last, schema: str) -> DataFrame:
    docs, route, size = in_blocks(df, id_col, text_col)
    route = route._replace(drop=64 - min(64, max(LEAST_BITS, (size // 12).bit_length() + SPARE)))  # a minimiser for 13 bytes
    # texts that another document has as well: a few bytes of each document are compared, not its text
    ids = docs.select("block", "doc_id", "h1", F.xxhash64(F.lit(1), "text").alias("h2"))
    least = ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    # copies of the few rows that name a text, so that one which a third of all documents have is met by several tasks
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    ids = ids.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    aside = ids.join(least, ["h1", "h2", "salt"]).filter("doc_id > least").select("block", F.lit(_ASIDE).alias("kind"), F.lit(0).alias("bucket"), "doc_id", "h1", F.lit(b"").alias("payload")).distinct()
    aside = save(aside, "copies")

    def at_home(more: DataFrame, step, out: str) -> DataFrame:
        return docs.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(step, out)

    shared = totals(at_home(aside, _ask_seeds(route), REQUEST), route, most=2)
    known = aside.union(shared.select("block", F.lit(_KNOWN).alias("kind"), "bucket", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h1"), F.col("totals").alias("payload")))
    runs = at_home(known, _ask_runs(route), "bucket int, block int, windows binary, docs binary, texts binary")
    marks = runs.groupBy("bucket").applyInArrow(_sort_bucket, _TO_BLOCK)
    return at_home(known.union(marks), last(route), schema)


def suffix_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: its bytes, how many go in how many spans, and the SHA-256 of the rest."""
    return _apply(df, id_col, text_col, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", public_id())


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, begin, end): the byte ranges that go."""
    return _apply(df, id_col, text_col, _spans, "doc_id long, begin long, end long").withColumn("doc_id", public_id())
