"""LM scoring: stupid-backoff scores, computed as joins of n-gram counts.

Method (Brants et al., 2007). The documents' n-grams, up to ``order`` words, are
exploded by block, counted in tables partitioned by hash, joined back to the
blocks' n-grams, and summed for each document (module ``blocks`` says how the
rows of these relations are packed). A document is scored by the corpus without
itself: its own counts are taken off first, else every n-gram would have been
seen. A word's score is count(n-gram) / count(context) for the longest n-gram
that other documents hold, times ``backoff`` for each word that had to be left
out; a word that no other document holds counts as half a time.

The score is the mean of the words' log scores. What is gathered from the corpus
is every n-gram of every document.

An n-gram is a hash of as many bits as keep two n-grams of the corpus apart: ``SPARE``
more than their number has, up to 64. One in 2 ** ``SPARE`` at most shares its
hash with another one.

Defined cases: a null or empty text has no words and the score null; rows that
repeat an id, or an id and a text, are documents of their own, each scored by the
others; a text longer than a block is a block's only long one and is counted and
scored whole (its arrays take about a hundred bytes for each word); an empty table
gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import REQUEST, grouped, in_blocks, request, totals, totals_of
from .common import Words, public_id, save, slices, tidy

_SCORED = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("known", pa.float64()), ("unigrams", pa.int64())])
#: Bits of a hash beyond those that number all n-grams, and the least of all bits.
SPARE, LEAST_BITS = 20, 48


class _Grams:
    """A block's n-grams, up to ``order`` words, every occurrence of them.

    ``h``: hashes; ``of``: the document's row; ``end``: the n-gram's last word,
    counted through the block; ``first``: where each order begins in these
    arrays, one entry more. ``sorted`` has equal ones side by side, ``new`` marks
    the first of each.
    """

    def __init__(self, docs: pa.Table, order: int, drop: int):
        by_order: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order)]
        counts, words, rows = [], 0, 0
        keep = ~((np.uint64(1) << np.uint64(drop)) - np.uint64(1))
        for part in slices(docs.combine_chunks().to_batches()):
            w = Words(part.column("text"))
            for o in range(1, order + 1):
                h, at = w.grams(o)
                by_order[o - 1].append(((h ^ np.uint64(o * 0x9E3779B97F4A7C15 & (2**64 - 1))) & keep, (w.text_of[at] + rows).astype(np.int32), (at + (o - 1 + words)).astype(np.int32)))
            counts.append(w.counts)
            words, rows = words + len(w), rows + len(w.counts)
        self.words, self.counts = words, np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.cumsum([0, *(sum(len(p[0]) for p in own) for own in by_order)])
        flat = [x for own in by_order for x in own]
        del by_order
        self.h, self.of, self.end = (np.zeros(int(self.first[-1]), kind) for kind in (np.uint64, np.int32, np.int32))
        at = 0
        for k, x in enumerate(flat):
            z = at + len(x[0])
            self.h[at:z], self.of[at:z], self.end[at:z] = x
            at, flat[k] = z, ()  # the pieces go as the whole grows
        self.sorted, self.new = grouped(self.h)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams, sorted, and how often each occurs."""
        begin = np.flatnonzero(self.new)
        return self.h[self.sorted[begin]], np.diff(np.append(begin, len(self.h)))

    def elsewhere(self, total: np.ndarray) -> np.ndarray:
        """For each occurrence, how often all other documents hold its n-gram; ``total``: of each distinct one."""
        of = self.of[self.sorted]
        own = self.new.copy()
        own[1:] |= of[1:] != of[:-1]
        size = np.diff(np.append(np.flatnonzero(own), len(of)))
        count = np.diff(np.append(np.flatnonzero(self.new), len(of)))
        rest = np.repeat(total.astype(np.int64), count)
        rest -= np.repeat(size, size)
        out = np.empty(len(of), np.int64)
        out[self.sorted] = rest
        return out


def _ask(order: int, buckets: int, drop: int):
    def run(docs: pa.Table) -> pa.Table:
        return request(docs["block"][0].as_py(), *_Grams(docs, order, drop).distinct(), buckets, drop)

    return run


def _score(order: int, backoff: float, drop: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORED.empty_table()
        grams = _Grams(docs, order, drop)
        elsewhere, n = grams.elsewhere(totals_of(replies)), grams.words
        del grams.h, grams.of, grams.sorted, grams.new
        seen = np.full((order + 1, n), -1, np.int64)  # of the n-gram that ends at a word: count elsewhere, -1 if there is none
        for o in range(1, order + 1):
            own = slice(grams.first[o - 1], grams.first[o])
            seen[o, grams.end[own]] = elsewhere[own]
        value, done = np.zeros(n), np.zeros(n, bool)
        steps = np.zeros(n, np.int64)
        for o in range(order, 1, -1):
            hit = ~done & (seen[o] > 0)
            here = np.flatnonzero(hit)
            value[here] = np.log(seen[o, here] / seen[o - 1, here - 1]) + steps[here] * math.log(backoff)
            done |= hit
            steps += ~done & (seen[o] >= 0)  # an n-gram that would start before the text is no step back
        rest = np.flatnonzero(~done)
        value[rest] = np.log(np.maximum(seen[1, rest], 0.5)) + steps[rest] * math.log(backoff)
        rows = len(grams.counts)
        of = np.repeat(np.arange(rows), grams.counts)
        tidy()
        known, unigrams = np.bincount(of, value, rows), np.bincount(of, ~done, rows).astype(np.int64)
        return pa.table([docs["doc_id"].combine_chunks(), pa.array(grams.counts.astype(np.int64)), pa.array(known), pa.array(unigrams)], schema=_SCORED)

    return run


def lm_scores(df: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, score) for every document; score is log_score a word."""
    docs, route, size = in_blocks(df, id_col, text_col)
    # a word and what parts it from the next one take two bytes at least, four mostly
    drop = 64 - min(64, max(LEAST_BITS, (size * order // 4).bit_length() + SPARE))
    route = route._replace(drop=drop)
    asked = docs.groupBy("block").applyInArrow(_ask(order, route.coarse, drop), REQUEST)
    replies = totals(asked, route)
    scored = docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(order, backoff, drop), "doc_id long, words long, known double, unigrams long")
    scored = save(scored, "lm-scores")
    words = scored.agg(F.sum("words")).collect()[0][0] or 0
    # what is divided by all other documents' words is left to the end, when their number is known
    log_score = F.col("known") - F.col("unigrams") * F.log(F.greatest(F.lit(words) - F.col("words"), F.lit(1)).cast("double"))
    return scored.select(public_id(), F.col("words").alias("n_words"), log_score.alias("log_score"), F.when(F.col("words") > 0, log_score / F.col("words")).alias("score"))
