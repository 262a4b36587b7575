"""Connected components of a table of links, all on the executors.

Large-star and small-star steps in turn (Kiveris et al., 2014): every node links
its larger neighbours, then its smaller ones and itself, to the least of its
neighbourhood, until no link changes. The links become stars whose centres are
the components' least nodes. A step is one aggregation (with partial sums, so a
node with very many links is no hot key) and one join. Only what a step changes is
joined: in the first one nodes between smaller and larger ones, in the second one
those with several smaller ones, neither of which a star has; there are ``SALT``
copies of each, so that a node with very many links is met by several tasks.
After each round every partition makes stars of its own links, in arrays of the
partition's size, so a few rounds do where links mostly meet in one partition. Each
round is cut by a scratch table, and the one before it is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save

#: Links that a partition makes stars of at a time.
LINKS = 2_000_000
#: Copies of a row that a node's links are joined with.
SALT = 16


def least_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each of n nodes' least node of its component, for the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not ((again := new[new]) == new).all():
            new = again
        if (new == label).all():
            return label
        label = new


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_of(at[: len(a)], at[len(a) :], len(nodes))
    far = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def _own_stars(at_once: int):
    """The links of a partition as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= at_once:
                yield _stars(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield _stars(*map(np.concatenate, zip(*held)))

    return run


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))


def _round(links: DataFrame) -> DataFrame:
    """A large-star and a small-star step on links (a, b) with a > b."""
    around = links.toDF("u", "v").union(links.select("b", "a"))
    between = around.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).filter("m < u and u < most").select("u", "m")
    large = _salted(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).join(_copied(between), ["u", "salt"], "left")
    large = large.select("v", F.coalesce("m", "u")).toDF("u", "v")
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
    small = _salted(large).join(_copied(least.filter("m < most").select("u", "m")), ["u", "salt"]).select("v", "m")
    return small.union(least.select("u", "m")).toDF("a", "b").filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, at_once: int = LINKS) -> DataFrame:
    """(node, component) for every node of the links (a, b): the component is its least node."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    now = save(now.mapInArrow(_own_stars(at_once), "a long, b long"), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        new = save(_round(now).mapInArrow(_own_stars(at_once), "a long, b long"), "links")
        drop(now)
        now, before, state = new, state, _state(new)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    """A sum that tells two sets of links apart."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).collect()[0])
