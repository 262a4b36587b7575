"""Quality rules: an isolation forest on rule statistics, behind two fixed rules.

Method. Every document gets the statistics that quality rules are made of. Two
rules reject at once (too few words; most words in repeated 3-word windows). For
the rest, an isolation forest is grown on the statistics of the labelled good rows:
trees of random splits, each on a random subsample drawn from all of them; a
document that ends on short paths is unlike the good ones. The verdict's threshold
on the mean path length is calibrated on all labelled rows, each scored by trees
that have not seen it: the one that tells good from bad best among those that keep
at least ``keep_good`` of the good. The forest (at most ``trees`` x 2 x
``subsample`` nodes) goes to every task.

All labelled rows are learned from, on the executors: they are numbered in ``BUCKETS``
by hash, so that draws and sums do not depend on partitions; the driver fetches
the rows that the trees have drawn (at most ``trees`` x ``subsample``), a row for each
bucket and the best threshold of each range of scores.

Defined cases: a null or empty text has no words and fails the first rule; a text
is counted whole, in memory in proportion to it; labels repeated for an id count
as the worst of them; rows that repeat an id are judged each by its text, and
learned from each if the id is labelled; without labelled rows of both kinds that
pass the fixed rules the forest rejects nothing; of thresholds that tell good from
bad equally well the lowest counts; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, documents, drop, per_text, public_id, save, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_POINT = np.zeros(256, bool)
_POINT[list(b"!?;:\"'()[]{}=/\\_@~^`+-")] = True
_BLANK = " \t\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_points", "n_distinct")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        w = Words(part.column("text"))
        rows = len(w.counts)
        inside = w.inside
        first_byte = inside & ((w.data & 0xC0) != 0x80)
        texts = part.column("text").to_pylist()
        lines, dups = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for i, text in enumerate(texts):
            got = [x for x in text.split("\n") if x.strip(_BLANK)]
            lines[i], dups[i] = len(got), len(got) - len(set(got))
        cover = np.zeros(len(w), bool)
        if len(w) >= 3:
            h, at = w.grams(3)
            h ^= w.text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            again = np.zeros(len(h), bool)
            again[order[1:]] |= same
            again[order[:-1]] |= same
            for k in range(3):
                cover[at[again] + k] = True
        distinct = np.zeros(rows, np.int64)
        if len(w):
            key = np.sort(w.hash & np.uint64((1 << 40) - 1) | (w.text_of.astype(np.uint64) << np.uint64(40)))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=rows)
        out = [w.counts, per_text(first_byte, w.offsets), per_text(_SYMBOL[w.data], w.offsets), dups, per_text(cover, w.first), lines, per_text(_UPPER[w.data], w.offsets), per_text(_POINT[w.data], w.offsets), distinct]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in out)], names=["doc_id", *COUNTS])


def rule_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules and the forest work on, a row for each document."""
    return documents(df, id_col, text_col).mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each document: ratios, so that neither length nor language says much.

    Digits and long words are left out: numbers, addresses and keys are not what
    makes a text bad.
    """
    n = np.maximum(c["n_words"], 1).astype(float)
    chars = np.maximum(c["word_chars"], 1).astype(float)
    lines = np.maximum(c["n_lines"], 1).astype(float)
    return np.stack([
        chars / n,
        np.sqrt(c["n_symbols"] / chars),
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / n,
        np.sqrt(c["n_upper"] / chars),
        np.sqrt(c["n_points"] / chars),
        c["n_distinct"] / n ** 0.9,
    ], axis=1)


def _mean_path(n: float) -> float:
    """Mean path length of a failed search in a tree of n leaves: what a leaf of n rows still stands for."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def draws(rows: int, trees: int, subsample: int, seed: int) -> list[np.ndarray]:
    """The numbers of the rows that each tree is grown on."""
    rng = np.random.default_rng([seed, 1])
    return [rng.choice(rows, min(subsample, max(2, rows // 2), rows), replace=False) for _ in range(trees)]


class Forest:
    """Isolation trees as arrays: ``feature`` -1 is a leaf; children of node i are ``child[i]`` and the next one.

    The rows that grow the trees are good ones, so a split is drawn from their
    range widened by ``spread`` (twice the statistic's deviation over good and
    bad rows): what lies outside the good rows' range ends early in an empty leaf,
    also where all good rows agree. ``taken``: what ``draws`` gave, as places in ``rows``.
    """

    def __init__(self, rows: np.ndarray, spread: np.ndarray, trees: int, subsample: int, seed: int, taken: list[np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        self.spread, self.taken = spread, draws(len(rows), trees, subsample, seed) if taken is None else taken
        self.depth = math.ceil(math.log2(max(2, *map(len, self.taken))))
        self.feature, self.split, self.child, self.length, self.roots = [], [], [], [], []
        for take in self.taken:
            self.roots.append(self._node())
            self._grow(self.roots[-1], rows[take], 0, rng)
        for name in ("feature", "child", "roots"):
            setattr(self, name, np.array(getattr(self, name), np.int32))
        for name in ("split", "length"):
            setattr(self, name, np.array(getattr(self, name), float))
        # for walks: a leaf is its own child, and no value is beyond its split
        leaf = self.feature < 0
        self._feature = np.where(leaf, 0, self.feature).astype(np.int64)
        self._split = np.where(leaf, np.inf, self.split)
        self._child = np.where(leaf, np.arange(len(leaf)), self.child).astype(np.int64)

    def _node(self) -> int:
        for column, value in ((self.feature, -1), (self.split, 0.0), (self.child, 0), (self.length, 0.0)):
            column.append(value)
        return len(self.feature) - 1

    def _grow(self, at: int, rows: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        if depth >= self.depth or len(rows) <= 1:
            self.length[at] = depth + _mean_path(len(rows))
            return
        low, high = rows.min(axis=0) - self.spread, rows.max(axis=0) + self.spread
        open_ = np.flatnonzero(high > low)
        if not len(open_):
            self.length[at] = depth + _mean_path(len(rows))
            return
        f = int(rng.choice(open_))
        s = float(rng.uniform(low[f], high[f]))
        left = self._node()
        right = self._node()
        self.feature[at], self.split[at], self.child[at] = f, s, left
        self._grow(left, rows[rows[:, f] < s], depth + 1, rng)
        self._grow(right, rows[rows[:, f] >= s], depth + 1, rng)

    def score(self, rows: np.ndarray, grew: bool = False) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for what is isolated at once.

        ``grew``: the rows are those that the forest was grown on, and each is
        scored by the trees that have not seen it.
        """
        total, trees = np.zeros(len(rows)), np.full(len(rows), len(self.roots))
        flat, first = np.ascontiguousarray(rows, float).ravel(), np.arange(len(rows)) * rows.shape[1]
        for root, taken in zip(self.roots, self.taken if grew else [()] * len(self.roots)):
            at = np.full(len(rows), root, np.int64)
            for _ in range(self.depth):
                right = flat.take(first + self._feature.take(at)) >= self._split.take(at)
                at = self._child.take(at) + right
            length = self.length[at]
            if grew:
                length[taken] = 0
                trees[taken] -= 1
            total += length
        return 2.0 ** (-(total / np.maximum(trees, 1)) / max(_mean_path(2**self.depth), 1e-9))


#: Groups of labelled rows, by hash.
BUCKETS = 256


def marks(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, good) of all labelled ids."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("good")).dropna()
    return rows.groupBy("doc_id").agg((F.min("good") >= 1).alias("good"))


def _summary(table: pa.Table) -> pa.Table:
    """A bucket's rows, good rows, and the mean and the sum of squares around it of each feature."""
    table = table.sort_by([(c, "ascending") for c in ("doc_id", *COUNTS)])
    x = features({c: table[c].to_numpy() for c in COUNTS})
    mean = x.mean(axis=0)
    rows = {"bucket": table["bucket"][0].as_py(), "n": len(x), "n_good": int(table["good"].to_numpy().sum()), "mean": mean.tolist(), "squares": ((x - mean) ** 2).sum(axis=0).tolist()}
    return pa.Table.from_pylist([rows], schema=pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("n_good", pa.int64()), ("mean", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))]))


def _deviation(buckets: list[dict]) -> np.ndarray:
    """Each feature's deviation over all buckets (Chan et al.)."""
    n, mean, squares = 0, 0.0, 0.0
    for b in buckets:
        off, both = np.array(b["mean"]) - mean, n + b["n"]
        squares = squares + np.array(b["squares"]) + off**2 * (n * b["n"] / both)
        n, mean = both, mean + off * (b["n"] / both)
    return np.sqrt(squares / n)


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            if b.num_rows:
                score = forest.score(features({c: b.column(c).to_numpy() for c in COUNTS}))
                yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("place"), b.column("good"), pa.array(score)], names=["bucket", "place", "good", "score"])

    return run


def _best_cut(before: dict[int, tuple[int, int]], n_good: int, n_bad: int, keep_good: float):
    """The best threshold of a range of scores: of (part, score, good, bad), with the counts of the ranges before."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("score")
        good, bad = (table[c].to_numpy() for c in ("good", "bad"))
        good_before, bad_before = before[table["part"][0].as_py()]
        kept = (good_before + np.cumsum(good) - good) / n_good
        caught = 1 - (bad_before + np.cumsum(bad) - bad) / n_bad
        gain = np.where(kept >= keep_good, kept + caught, -1)
        best = int(gain.argmax())
        return pa.table({"gain": pa.array([float(gain[best])]), "score": pa.array([table["score"][best].as_py()])})

    return run


def calibrate(scores: DataFrame, keep_good: float) -> float:
    """The score from which on a row is rejected, from all rows of (good, score)."""
    counts = save(scores.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")), "scores")
    cuts = save(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "cuts")
    before, n_good, n_bad = {}, 0, 0
    for r in sorted(cuts.groupBy("part").agg(F.sum("good"), F.sum("bad")).collect()):
        before[r[0]] = n_good, n_bad
        n_good, n_bad = n_good + r[1], n_bad + r[2]
    best = (1, math.inf)
    if n_good and n_bad:
        found = cuts.groupBy("part").applyInArrow(_best_cut(before, n_good, n_bad, keep_good), "gain double, score double").collect()
        best = min(((r.gain, r.score) for r in found), key=lambda x: (-x[0], x[1]))
    drop(counts)
    drop(cuts)
    return best[1] if best[0] > 1 else math.inf


def fit(stats: DataFrame, labelled: DataFrame, trees: int = 400, subsample: int = 256, keep_good: float = 0.99, seed: int = 7) -> tuple[Forest | None, float]:
    """Grow the forest and find its threshold from ``rule_statistics`` and ``marks``."""
    spark = stats.sparkSession
    rows = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(labelled, "doc_id")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(BUCKETS)).cast("int"))
    rows = save(rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "good").orderBy("doc_id", *COUNTS)) - 1), "labelled")
    buckets = rows.groupBy("bucket").applyInArrow(_summary, "bucket int, n long, n_good long, mean array<double>, squares array<double>").toArrow().sort_by("bucket").to_pylist()
    first = np.cumsum([0, *(b["n_good"] for b in buckets)])
    if not first[-1]:
        drop(rows)
        return None, math.inf
    taken = draws(int(first[-1]), trees, subsample, seed)
    wanted = np.unique(np.concatenate(taken))
    of = np.searchsorted(first, wanted, "right") - 1
    keys = {"bucket": pa.array(np.array([b["bucket"] for b in buckets], np.int32)[of]), "place": pa.array((wanted - first[of]).astype(np.int32))}
    drawn = rows.filter("good").join(F.broadcast(spark.createDataFrame(pa.table(keys))), ["bucket", "place"]).toArrow().sort_by([("bucket", "ascending"), ("place", "ascending")])
    x = features({c: drawn[c].to_numpy() for c in COUNTS})
    forest = Forest(x, 2 * _deviation(buckets), trees, subsample, seed, [np.searchsorted(wanted, t) for t in taken])
    unseen = spark.createDataFrame(pa.table({**keys, "good": pa.array(np.ones(len(wanted), bool)), "unseen": pa.array(forest.score(x, grew=True))}))
    forest.taken = []
    scores = rows.mapInArrow(_scored(forest), "bucket int, place int, good boolean, score double").join(F.broadcast(unseen), ["bucket", "place", "good"], "left")
    threshold = calibrate(scores.select("good", F.coalesce("unseen", "score").alias("score")), keep_good)
    drop(rows)
    return forest, threshold


#: Rows that the forest scores at once.
ROWS = 16_384


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _verdicts(forest: Forest | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            if not b.num_rows:
                continue
            c = {x: b.column(x).to_numpy() for x in COUNTS}
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            score = forest.score(features(c)) if forest is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(x) for x in COUNTS[:5]), pa.array(failed), pa.array(~failed & (score < threshold)), pa.array(score)], names=["doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly"])

    return run


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly)."""
    stats = save(rule_statistics(df, id_col, text_col), "rule-statistics")
    forest, threshold = fit(stats, marks(labels, id_col, label_col), **options)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, anomaly double"
    return stats.mapInArrow(_verdicts(forest, threshold), schema).withColumn("doc_id", public_id())


def filter_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """``df`` without the rows that ``quality`` rejects; a row's verdict needs nothing but its text."""
    forest, threshold = fit(rule_statistics(df, id_col, text_col), marks(labels, id_col, label_col), **options)
    return df.filter(_row_verdict(forest, threshold)(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def _row_verdict(forest: Forest | None, threshold: float):
    @F.arrow_udf(T.BooleanType())
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        verdicts = _verdicts(forest, threshold)
        for texts in batches:
            b = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int64)), texts], names=["doc_id", "text"])
            got = [x.column("kept") for x in verdicts(_statistics(iter([b])))]
            yield pa.concat_arrays(got) if got else pa.array([], pa.bool_())

    return kept
