"""MinHash near-dedup by Order MinHash: sketches that keep the order of what they sample.

Method (Marcais et al., 2019). A document's k-mers are its runs of three words,
each labelled with how often it has occurred before. For each of ``sketches`` hash functions
the ``minima`` smallest labelled k-mers are taken, in the order in which
they stand in the text; their hash is one sketch. Two texts share a sketch the
more likely the smaller their edit distance. Texts that share one are candidates:
each with the first text of the sketch's group (round one), and then each with
every other one of the group, if the two are still in different components
(round two); so each two texts that share a sketch are in one component or have
been compared. What is compared is screened first by a bound that loses nothing:
a text's words are counted in ``BAG`` classes, and an edit changes the counts by
one word gone and one word come at most. Candidates are verified by banded
alignment: the words' edit distance within a band of (1 - similarity) times the
longer text, bit by bit in parallel (Myers 1999, Hyyro 2003). Verified links make
components.

Round two works on blocks, and its rows are texts, not pairs. Groups are screened
in pairs of blocks of ``BLOCK`` texts; a group of more than ``BLOCKS`` of them has
larger blocks instead of more, so a text goes to ``BLOCKS`` places at most and the
rows grow in proportion to the group (until blocks hold ``BLOCK_TEXTS``, which bounds
a task's memory). In a pair of blocks, sorted by length, only texts of lengths that
can be similar meet. A text's home is a block of ``HOME_TEXTS``
at most of its largest group; what the screen passes is packed by pairs of
homes, each text goes once to a pair of homes that needs it, and there pairs are
aligned until their texts are in one component. So a group's comparisons, which
may grow with its square where its texts are neither similar nor easily told
apart, are shared by many tasks and only links come out.

Sketches miss few of the pairs that the similarity asks for: with edits at random
places, two texts of 200 words and similarity 0.8 agree in a sketch with a chance
of 0.12, so 64 sketches miss 1 in 3000. Texts of fewer than ``SHORT`` words have
``SHORT_SKETCHES`` of single runs of two words: whatever the places of the edits,
a third of these is common, so fewer than 1 in 10,000 pairs are missed. Texts of
lengths that can be similar to both have both.

Equal texts are one node from the start. A text with many candidates is compared
with them in pieces, each with a copy of the text.

Memory: pieces and homes hold as many words as ``PIECE_WORDS`` and ``HOME_WORDS`` or
a single text; the alignment's own arrays take the band times ``CHUNK`` bits, so long
texts take memory in proportion to their length. Its time is the length times
the distance, by ever wider bands.

Similarity: 1 - distance / words of the longer text, at least ``similarity``.

Defined cases: null and empty texts are copies of one another; a text with fewer
words than a k-mer has them all as its only k-mer; a text without words links
with its copies only; rows that repeat an id and a text are one document, rows
that repeat an id with other texts are documents of their own; of documents with one smallest id
the one with the smallest hash of its text stays; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, Words, documents, drop, mix, partitions, save, semi_join, slices
from .components import components

_SKETCHED = "doc_id long, h1 long, h2 long, words long, bag binary, sketches array<long>"
_PACKED = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("pairs", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Classes of words that a bag counts (to 255 each; less is still a bound).
BAG = 256
#: Texts of a block, blocks of a group whose blocks are larger than that, and texts of such a block, at most.
BLOCK, BLOCKS, BLOCK_TEXTS = 4000, 16, 100_000
#: Pairs whose bags are compared at once.
SCREENED = 1 << 18
#: Texts and words that one task compares with a hub, at most (or a single text), and those at home in one place.
PIECE_TEXTS, PIECE_WORDS, HOME_TEXTS, HOME_WORDS = 100, 500_000, 1000, 1_000_000
#: Columns of an alignment whose words are looked up together, and copies of the row that names a component.
CHUNK, SALT = 1024, 16
#: Texts of fewer words have this many sketches of one run of two words, besides or instead of the others.
SHORT, SHORT_SKETCHES = 50, 24
_MOST = np.uint64(2**64 - 1)


def _labelled(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-mers with their occurrence's number, and each text's first k-mer (one entry more)."""
    h, at = words.grams(k)
    of = words.text_of[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):  # all words of a short text are its k-mer
        own = np.array([xxhash.xxh3_64_intdigest(words.hash[words.first[i] : words.first[i + 1]].tobytes()) for i in short.tolist()], np.uint64)
        h, of = np.concatenate([h, own]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    if len(h):
        key = mix(h + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        begin = np.flatnonzero(new)
        number = np.arange(len(h)) - begin[np.cumsum(new) - 1]
        label = np.empty(len(h), np.uint64)
        label[order] = number.astype(np.uint64)
        h = mix(h + label * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(of, np.arange(len(words.counts) + 1))


def order_sketches(h: np.ndarray, first: np.ndarray, sketches: int, minima: int) -> np.ndarray:
    """A row of sketches for each text that has a k-mer (others: zeros)."""
    out = np.zeros((len(first) - 1, sketches), np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return out
    begin, n = first[some], len(h)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(n, dtype=np.uint64)
    for s in range(sketches):
        # the place stands in the low bits: the minimum tells which k-mer it is
        x = (mix(h ^ mix(np.array([s + 1], np.uint64) * np.uint64(0x2545F4914F6CDD1D))) & ~low) | place
        at = []
        for _ in range(minima):
            least = np.minimum.reduceat(x, begin)
            here = np.where(least == _MOST, np.uint64(0), least & low).astype(np.int64)
            at.append(np.where(least == _MOST, -1, here))
            x[here[least != _MOST]] = _MOST
        at = np.sort(np.stack(at), axis=0)
        value = np.full(len(some), np.uint64(s + 1))
        for row in at:
            value = np.where(row < 0, value, mix(value * np.uint64(0xFF51AFD7ED558CCD) + h[np.maximum(row, 0)]))
        out[some, s] = value
    return out


def _bags(words: Words) -> np.ndarray:
    """A row for each text: how many of its words are in each class."""
    n = len(words.counts)
    of = words.text_of * BAG + (words.hash % np.uint64(BAG)).astype(np.int64)
    return np.minimum(np.bincount(of, minlength=n * BAG), 255).astype(np.uint8).reshape(n, BAG)


def _may_be_near(words_a: np.ndarray, bags_a: np.ndarray, words_b: np.ndarray, bags_b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs the alignment could accept: no distance is less than the words that one bag has and the other lacks."""
    out = np.zeros(len(words_a), bool)
    for low in range(0, len(out), 4096):
        at = slice(low, low + 4096)
        a, b = bags_a[at], bags_b[at]
        apart = np.maximum(a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64)) - np.minimum(a, b).sum(axis=1, dtype=np.int64)
        out[at] = apart <= ((1 - similarity) * np.maximum(words_a[at], words_b[at]) + 1e-9).astype(np.int64)
    return out


def _bag_rows(bags: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bags.to_pylist()), np.uint8).reshape(-1, BAG)


def _screen(similarity: float):
    """The pairs that the alignment could accept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = _may_be_near(b.column("hub_words").to_numpy(), _bag_rows(b.column("hub_bag")), b.column("words").to_numpy(), _bag_rows(b.column("bag")), similarity)
            yield b.select(["hub", "node", "words"]).filter(pa.array(ok))

    return run


def _open(similarity: float):
    """Of each sketch and pair of blocks of a bucket: the pairs in different components that the alignment could accept.

    They come packed by the homes of their texts. Pairs with the group's hub have
    been compared.
    """

    def run(table: pa.Table) -> pa.Table:
        sketch, i, j, own, node, group, words, hub, home = (table[c].to_numpy() for c in ("sketch", "i", "j", "own", "node", "of", "words", "hub", "home"))
        bags = _bag_rows(table["bag"])
        order = np.lexsort((j, i, sketch))
        key = np.stack([sketch, i, j])[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        ends = [*np.flatnonzero(new).tolist(), len(order)]
        found = [np.zeros((0, 4), np.int64)]
        for u, v in zip(ends[:-1], ends[1:]):
            at = order[u:v]
            at = at[node[at] != hub[at]]
            if not len(at):
                continue
            same = i[at[0]] == j[at[0]]
            left = at if same else at[own[at] == i[at[0]]]
            right = at if same else at[own[at] == j[at[0]]]
            left, right = (x[np.argsort(words[x], kind="stable")] for x in (left, right))
            length, step = words[right], max(1, SCREENED // max(len(right), 1))
            for low in range(0, len(left), step):
                part = left[low : low + step]
                # the lengths that the shortest and the longest of the part can be similar to
                begin, end = np.searchsorted(length, [words[part[0]] * similarity - 1, words[part[-1]] / similarity + 1])
                other = right[begin:end]
                a, b = words[part][:, None], words[other][None, :]
                ok = (group[part][:, None] != group[other][None, :]) & (np.minimum(a, b) >= np.maximum(a, b) * similarity - 1e-6)
                if same:
                    ok &= node[part][:, None] < node[other][None, :]
                x, y = np.nonzero(ok)
                x, y = part[x], other[y]
                near = _may_be_near(words[x], bags[x], words[y], bags[y], similarity) if len(x) else np.zeros(0, bool)
                x, y = x[near], y[near]
                swap = (home[x] > home[y]) | ((home[x] == home[y]) & (node[x] > node[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                found.append(np.stack([home[x], home[y], node[x], node[y]], axis=1))
            if len(found) > 1000:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0)
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
        ends = [*np.flatnonzero(new).tolist(), len(pairs)]
        packed = [np.ascontiguousarray(pairs[u:v, 2:]).tobytes() for u, v in zip(ends[:-1], ends[1:])]
        return pa.table([pa.array(pairs[new, 0]), pa.array(pairs[new, 1]), pa.array(packed, pa.binary())], schema=_PACKED)

    return run


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that each pair of homes needs."""
    for b in batches:
        pairs = [np.frombuffer(x, np.int64) for x in b.column("pairs").to_pylist()]
        of = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
        rows = np.stack([b.column("left").to_numpy()[of], b.column("right").to_numpy()[of], np.concatenate(pairs) if pairs else np.zeros(0, np.int64)], axis=1)
        rows = np.unique(rows, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["left", "right", "node"])


def text_sketches(texts: pa.Array, w: Words, k: int, sketches: int, minima: int, similarity: float) -> list[np.ndarray]:
    """Each text's sketches; none if it has no words."""
    out = list(order_sketches(*_labelled(w, k), sketches, minima))
    short = np.flatnonzero(w.counts < SHORT)
    own = order_sketches(*_labelled(Words(texts.take(pa.array(short))), 2), SHORT_SKETCHES, 1) if len(short) else []
    for i, x in zip(short.tolist(), own):
        # a text that can be similar to one of SHORT words has both kinds
        out[i] = np.concatenate([out[i], x]) if w.counts[i] >= SHORT * similarity - 1 else x
        out[i] = out[i] if w.counts[i] else out[i][:0]
    return out


def _sketch(k: int, sketches: int, minima: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            got = text_sketches(b.column("text"), w, k, sketches, minima, similarity)
            h2 = [xxhash.xxh3_64_intdigest(x) - 2**63 for x in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, got)])
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(got).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), pa.array(h2, pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array([x.tobytes() for x in _bags(w)], pa.binary()), arrays], names=["doc_id", "h1", "h2", "words", "bag", "sketches"])

    return run


def banded_distance(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None.

    What both begin and end with is left out; the band is tried narrow first, so
    near copies cost little however long they are.
    """
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return max(len(a), len(b))
    band = max(16, abs(len(a) - len(b)))
    while band * 4 < most:
        if (d := _banded(a, b, band)) is not None:
            return d
        band *= 4
    return _banded(a, b, most)


def _banded(a: list, b: list, most: int) -> int | None:
    """``banded_distance`` with one band.

    A column of the alignment is kept as the bits of its band's vertical
    differences; the band moves down a row with each column. Rows above the first
    count on as if every word there had to be inserted, so the edge needs no case.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return None
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    plus = mask >> (most + 1) << (most + 1)
    minus = (1 << (most + 1)) - 1
    score, bit = abs(m - n), m - n + most
    for begin in range(0, n, CHUNK):
        some = b[begin : begin + CHUNK]
        base = begin - most  # the row of the first bit in this chunk's masks
        where = _masks(a, max(base, 0), begin + len(some) + most, base, set(some))
        for step, x in enumerate(some):
            plus, minus = (plus >> 1) | top, minus >> 1
            equal = (where.get(x, 0) >> step) & mask
            diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
            if not diagonal >> bit & 1:
                score += 1
                if score > most:
                    return None
            right = minus | (mask & ~(diagonal | plus))
            left = diagonal & plus
            right = (right << 1 | 1) & mask
            plus = (left << 1 & mask) | (mask & ~(diagonal | right))
            minus = diagonal & right
    return score


def _masks(a: list, low: int, high: int, base: int, words: set) -> dict:
    """For each of the words, its places in a[low:high] as bits counted from ``base``."""
    places: dict = {}
    for i, x in enumerate(a[low:high], low - base):
        if x in words:
            places.setdefault(x, []).append(i)
    out = {}
    for x, own in places.items():
        if len(own) < 4:
            out[x] = sum(1 << i for i in own)
        else:
            bits = np.zeros((own[-1] >> 3) * 8 + 8, np.uint8)
            bits[own] = 1
            out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


class _Aligner:
    """Texts' words, and whether two texts are similar."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def words(self, text: str) -> tuple[list, Counter]:
        words = text.encode().split()
        return words, Counter(words)

    def near(self, a: tuple[list, Counter], b: tuple[list, Counter]) -> bool:
        longer = max(len(a[0]), len(b[0]))
        most = int((1 - self.similarity) * longer + 1e-9)
        if not a[0] or not b[0] or longer - (a[1] & b[1]).total() > most:
            return False
        return banded_distance(a[0], b[0], most) is not None


def _link_rows(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], schema=_LINK)


def _verify_hub(similarity: float):
    """A hub against a piece of its candidates."""

    def run(pairs: pa.Table, hubs: pa.Table) -> pa.Table:
        links = []
        if pairs.num_rows and hubs.num_rows:
            align = _Aligner(similarity)
            hub, first = hubs["first"][0].as_py(), align.words(hubs["first_text"][0].as_py())
            links = [(node, hub) for node, text in zip(pairs["node"].to_pylist(), pairs["text"]) if align.near(first, align.words(text.as_py()))]
        return _link_rows(links)

    return run


def _verify_homes(similarity: float):
    """The open pairs of two homes; a pair whose texts are in one component by now is left out."""

    def run(packed: pa.Table, texts: pa.Table) -> pa.Table:
        pairs = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in packed["pairs"].to_pylist()]), axis=0) if packed.num_rows else np.zeros((0, 2), np.int64)
        align, links = _Aligner(similarity), []
        row = {x: k for k, x in enumerate(texts["node"].to_pylist())}
        own = texts["text"]
        label = dict(zip(row, texts["of"].to_pylist()))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        at, words = None, {}
        for x, y in pairs.tolist():
            a, b = root(label[x]), root(label[y])
            if a == b:
                continue
            if at != x:
                at, first = x, align.words(own[row[x]].as_py())
            if y not in words:
                words[y] = align.words(own[row[y]].as_py())
            if align.near(first, words[y]):
                parent[max(a, b)] = min(a, b)
                links.append((x, y))
        return _link_rows(links)

    return run


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes."""
    needed = wanted.distinct().join(nodes.select("node", "least", "h1"), "node")
    return save(docs.join(needed.hint("shuffle_hash"), (docs["doc_id"] == needed["least"]) & (docs["h1"] == needed["h1"])).select("node", "text").dropDuplicates(["node"]), "texts")


def _hub_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (hub, node) that the alignment accepts, as links (a, b)."""
    texts = _texts(docs, nodes, pairs.select("node").union(pairs.select("hub")))
    pieces = pairs.groupBy("hub").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PIECE_TEXTS, F.sum("words") / PIECE_WORDS)).cast("int").alias("pieces"))
    dealt = pairs.join(pieces, "hub").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).join(texts, "node").select("hub", "piece", "node", "text")
    hubs = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "piece", "text")
    hubs = hubs.select(F.col("hub").alias("first"), F.col("piece").alias("first_piece"), F.col("text").alias("first_text"))
    out = save(dealt.groupBy("hub", "piece").cogroup(hubs.groupBy("first", "first_piece")).applyInArrow(_verify_hub(similarity), "a long, b long"), "links")
    drop(texts)
    return out


def _home_links(docs: DataFrame, nodes: DataFrame, packed: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The packed pairs that the alignment accepts, as links (a, b); enough of them to join their components."""
    needed = save(packed.mapInArrow(_needed, "left long, right long, node long").distinct(), "needed")
    texts = _texts(docs, nodes, needed.select("node"))
    sent = needed.join(texts, "node").join(known, "node", "left").select("left", "right", "node", F.coalesce("component", "node").alias("of"), "text")
    out = save(packed.groupBy("left", "right").cogroup(sent.groupBy("left", "right")).applyInArrow(_verify_homes(similarity), "a long, b long"), "links")
    drop(texts)
    drop(needed)
    return out


def _named(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(h1, h2, class_id, of_kept_text) of every node: the least document of its group."""
    alone = nodes.join(groups, "node", "left_anti").select("h1", "h2", F.col("least").alias("class_id"), F.lit(True).alias("of_kept_text"))
    inside = nodes.select("h1", "h2", "node", "least").join(groups, "node")
    # a row for each group, copied so that a group with a third of all nodes is named by several tasks
    least = inside.groupBy("component").agg(F.min(F.struct("least", "h1", "h2")).alias("one")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    inside = inside.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(least, ["component", "salt"])
    return alone.union(inside.select("h1", "h2", F.col("one.least").alias("class_id"), ((F.col("one.h1") == F.col("h1")) & (F.col("one.h2") == F.col("h2"))).alias("of_kept_text")))


def near_groups(df: DataFrame, similarity: float = 0.8, k: int = 3, sketches: int = 64, minima: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, class_id, kept): the class is the smallest id of the document's group."""
    docs = documents(df, id_col, text_col).withColumn("h1", F.xxhash64("text"))
    sketched = save(docs.mapInArrow(_sketch(k, sketches, minima, similarity), _SKETCHED), "sketches")
    nodes = sketched.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("words").alias("words"), F.first("bag").alias("bag"), F.first("sketches").alias("sketches"))
    nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # a sketch's number is in its hash, so equal sketches are of one band
    bands = nodes.filter("words > 0").select("node", "words", F.explode("sketches").alias("sketch"))
    groups = bands.groupBy("sketch").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), F.sum("words").alias("all_words")).filter("n > 1")
    members = save(bands.select("node", "sketch").join(groups, "sketch"), "bands")
    texts = nodes.select("node", "words", "bag")
    pairs = members.filter(F.col("hub") != F.col("node")).select("hub", "node").distinct()
    pairs = pairs.join(texts.toDF("hub", "hub_words", "hub_bag"), "hub").join(texts, "node")
    # the alignment could not accept other lengths
    pairs = pairs.filter(F.least("words", "hub_words") >= F.greatest("words", "hub_words") * F.lit(similarity) - 1e-6)
    first = save(pairs.mapInArrow(_screen(similarity), "hub long, node long, words long"), "pairs")
    known = save(components(_hub_links(docs, nodes, first, similarity)), "groups")
    # groups of more than one component: all of their pairs between components
    placed = members.join(known, "node", "left").withColumn("of", F.coalesce("component", "node"))
    mixed = placed.groupBy("sketch").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low < high").select("sketch")
    placed = placed.join(mixed, "sketch").withColumn("blocks", F.least(F.ceil(F.col("n") / BLOCK), F.greatest(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK_TEXTS))).cast("int"))
    placed = save(placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("sketch", "node", "of", "n", "hub", "all_words", "blocks", "own"), "open")
    homes = placed.groupBy("node").agg(F.max(F.struct("n", "sketch", "all_words")).alias("x"))
    place = F.pmod(F.xxhash64("node"), F.ceil(F.greatest(F.col("x.n") / HOME_TEXTS, F.col("x.all_words") / HOME_WORDS)))
    homes = homes.select("node", F.xxhash64("x.sketch", place).alias("home"))
    rows = placed.agg(F.sum("blocks")).collect()[0][0] or 0
    buckets = max(partitions(df.sparkSession), rows // 20_000)
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    # the pairs of blocks of a group go to one bucket after the other
    bucket = F.pmod(F.pmod(F.xxhash64("sketch"), F.lit(buckets)) + F.col("i").cast("long") * F.col("blocks") + F.col("j"), F.lit(buckets))
    dealt = dealt.withColumn("bucket", bucket.cast("int")).join(texts.join(homes, "node"), "node").select("bucket", "sketch", "i", "j", "own", "node", "of", "hub", "home", "words", "bag")
    second = save(dealt.groupBy("bucket").applyInArrow(_open(similarity), "left long, right long, pairs binary"), "pairs")
    # links between the components there are
    more = _home_links(docs, nodes, second, known, similarity)
    for end in "ab":
        more = more.join(known.toDF(end, "of_" + end), end, "left").withColumn(end, F.coalesce("of_" + end, end)).select("a", "b")
    found = components(more).toDF("component", "into")
    labelled = known.join(found, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    labelled = labelled.union(found.select(F.col("component").alias("node"), F.col("into").alias("component")).join(known, "node", "left_anti"))
    named = save(_named(nodes, labelled), "named")
    for done in (members, placed, first, second, known):
        drop(done)
    out = sketched.select("doc_id", "h1", "h2").join(named, ["h1", "h2"])
    return out.select("doc_id", "h1", "class_id", (F.col("of_kept_text") & (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def dedup_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df``'s rows of one document of each group, the one with the smallest id."""
    kept = near_groups(df, id_col=id_col, text_col=text_col, **options).filter("kept").select("doc_id", "h1").distinct()
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return semi_join(df, kept, key, text)
