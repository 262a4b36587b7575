"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them.

Method. Vectors become unit vectors in double precision; equal vectors are one
point with a count. Spherical k-means on a bounded sample gives centres, and each
point is at home in the cell of its nearest one. Near points can have different
homes a and b; the plane between the two centres then passes between the points,
so one of them is within half their distance's projection of it. A point is
therefore copied into every other cell whose plane is within ``reach``, and a
pair meets in the cell of one of the two. Cells are cut into blocks, and each
pair of blocks is one matrix product, so a cell with a third of all points is
many tasks. A block pair emits counts and a spanning forest, never its pairs. A
pair with two homes that meets in both cells counts in the lower one only.
Components come from the forests' links; a group's smallest id represents it.

``reach`` is half of the longest distance that the threshold allows, at every size
and in every dimension, so no pair is lost. Where vectors fill many directions
alike, that copies most points into most cells; the number of cells (down to a
single one, in which every block meets every other) is therefore the one that
has the fewest pairs to compare on the sample. It decides the cost only.

Bounds: ``sample`` points or ``ROOTS`` times the root of their number, whichever is
more, in ``SAMPLE_BYTES`` at most (those with the smallest hash), fit the centres:
one for each ``cell_points`` points, and no more than a sample of ``PER_CELL`` points
each can fit. So cells grow with the root of the input, and every point is indexed.
Each length of vectors has centres of its own; one that the sample does not hold is
a single cell. A block has at most ``block_points`` points and ``BLOCK_BYTES``.

Defined cases: a vector that is null, zero, or holds a null or a non-finite
number links with nothing and is kept; vectors of different lengths never link;
rows that repeat an id are vectors of their own; equal vectors link, and of a
group's rows that share its smallest id all are kept; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, save, semi_join
from .components import components, least_of


#: Bytes of vectors that a block holds at most.
BLOCK_BYTES = 32 << 20
#: The sample: roots of the number of points, bytes at most, and points for a centre at least.
ROOTS, SAMPLE_BYTES, PER_CELL = 8, 128 << 20, 20


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; null for what links with nothing."""
    for b in batches:
        units = []
        for x in b.column("vector").to_pylist():
            unit = None
            if x and None not in x:
                v = np.array(x, np.float64)
                if np.isfinite(v).all() and (most := np.abs(v).max()) > 0:
                    v = v / most
                    unit = (v / math.sqrt(float(v @ v)) + 0.0).tobytes()
            units.append(unit)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(units, pa.binary())], names=["vec_id", "unit"])


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centres of at most ``cells`` cells of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[low : low + 1024] @ centres.T).argmax(axis=1) for low in range(0, len(x), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def _cells(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's cell, and the cells it is in as (vector, cell), sorted."""
    s = x @ c.T
    home = s.argmax(axis=1)
    best = s[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[home]
    return home, *np.nonzero(best[:, None] - s <= reach * apart + 1e-12)


def _fit(x: np.ndarray, cells: int, reach: float) -> np.ndarray | None:
    """Centres of at most ``cells`` cells, as many as have the fewest pairs to compare; None for a single cell."""
    fitted, fewest = None, float(len(x)) ** 2
    while cells > 1:
        c = spherical_kmeans(x, cells)
        held = np.zeros(len(c))
        for low in range(0, len(x), 1024):
            held += np.bincount(_cells(x[low : low + 1024], c, reach)[2], minlength=len(c))
        if held @ held < fewest:
            fitted, fewest = c, float(held @ held)
        cells //= 4
    return fitted


def _homes(centres, reach: float):
    """Each point's cell, and the cells into which it is copied."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = centres.value
        for b in batches:
            point, dims, units = b.column("point").to_numpy(), b.column("dim").to_numpy(), b.column("unit").to_pylist()
            rows: list[tuple[np.ndarray, ...]] = []
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(units[i] for i in which.tolist()), np.float64).reshape(-1, dim)
                c = by_dim.get(dim)
                if c is None:
                    none = np.zeros(len(which), np.int64)
                    rows.append((which, none, none, [none[:1].astype(np.int32).tobytes()] * len(which)))
                    continue
                home, i, cell = _cells(x, c, reach)
                ends = np.searchsorted(i, np.arange(len(x) + 1)).tolist()
                own = [cell[u:v].astype(np.int32).tobytes() for u, v in zip(ends[:-1], ends[1:])]
                rows.append((which[i], home[i], cell, [own[k] for k in i.tolist()]))
            if not rows:
                continue
            at, home, cell = (np.concatenate(z) for z in list(zip(*rows))[:3])
            cells = [x for r in rows for x in r[3]]
            yield pa.RecordBatch.from_arrays([pa.array(point[at]), pa.array(dims[at].astype(np.int32)), pa.array(cell.astype(np.int64)), pa.array(home.astype(np.int64)), pa.array(cells, pa.binary()), pa.array([units[i] for i in at.tolist()], pa.binary())], names=["point", "dim", "cell", "home", "cells", "unit"])

    return run


def _compare(threshold: float):
    """All pairs between two blocks of a cell (or within one): links counted, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        point, home, side, times = (table[c].to_numpy() for c in ("point", "home", "side", "times"))
        order = np.argsort(point, kind="stable")
        point, home, side, times = point[order], home[order], side[order], times[order]
        cell = table["cell"][0].as_py()
        units = table["unit"].to_pylist()
        dim = table["dim"][0].as_py()
        x = np.frombuffer(b"".join(units[i] for i in order.tolist()), np.float64).reshape(-1, dim)
        own = table["i"][0].as_py() == table["j"][0].as_py()
        rows, columns = (np.arange(len(point)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        cells = table["cells"].to_pylist()
        in_cells = [np.frombuffer(cells[i], np.int32) for i in order.tolist()]
        present = (np.repeat(np.arange(len(point)), [len(c) for c in in_cells]) << 32) | np.concatenate(in_cells)  # sorted
        count = np.zeros(len(point), np.int64)
        label = np.arange(len(point))
        for low in range(0, len(rows), 512):
            r = rows[low : low + 512]
            i, j = np.nonzero(x[r] @ x[columns].T >= threshold)
            i, j = r[i], columns[j]
            ok = i < j if own else np.ones(len(i), bool)
            # copies of two points from elsewhere do not count here; a point at home and a copy do, unless
            # they meet in the copy's home too and that is the lower cell
            at_home, other = home[i] == cell, home[j] == cell
            ok &= at_home | other
            away = np.where(at_home, home[j], home[i])
            key = (np.where(at_home, i, j) << 32) | away
            ok &= (away >= cell) | (present[np.minimum(np.searchsorted(present, key), len(present) - 1)] != key)
            i, j = i[ok], j[ok]
            np.add.at(count, i, times[j])
            np.add.at(count, j, times[i])
            if len(i):
                label = least_of(np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label]), len(label))
        linked = label != np.arange(len(label))
        kind = np.concatenate([np.zeros(int((count > 0).sum()), np.int32), np.ones(int(linked.sum()), np.int32)])
        return pa.table({"kind": kind, "a": np.concatenate([point[count > 0], point[linked]]), "b": np.concatenate([count[count > 0], point[label[linked]]])}, schema=pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))

    return run


def link(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, sample: int = 20_000, cell_points: int = 2000, block_points: int = 8192, reach: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    spark = df.sparkSession
    vectors = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    vectors = save(vectors.mapInArrow(_units, "vec_id long, unit binary"), "units")
    points = vectors.filter("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    points = save(points.withColumn("point", F.monotonically_increasing_id()).withColumn("dim", F.expr("cast(octet_length(unit) div 8 as int)")), "points")
    n, widest = points.agg(F.count(F.lit(1)), F.max("dim")).collect()[0]
    rows = min(max(sample, ROOTS * math.isqrt(n)), max(1, SAMPLE_BYTES // (8 * (widest or 1))))
    picked = points.orderBy(F.xxhash64("unit"), "point").limit(rows).select("dim", "unit").toArrow()
    dims, units = picked["dim"].to_numpy(), picked["unit"].to_pylist()
    centres = {}
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 if reach is None else reach
    for dim in np.unique(dims).tolist():
        own = [units[i] for i in np.flatnonzero(dims == dim).tolist()]
        cells = min(n * len(own) // len(units) // cell_points, len(own) // PER_CELL)
        if cells > 1 and (fitted := _fit(np.frombuffer(b"".join(own), np.float64).reshape(-1, dim), cells, reach)) is not None:
            centres[dim] = fitted
    homes = points.mapInArrow(_homes(spark.sparkContext.broadcast(centres), reach), "point long, dim int, cell long, home long, cells binary, unit binary")
    homes = save(homes, "cells")
    # a row for each cell
    blocks = homes.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.least(F.lit(block_points), F.expr(f"{BLOCK_BYTES} div (8 * dim)")))).cast("int").alias("blocks"))
    dealt = homes.join(blocks, ["dim", "cell"]).join(points.select("point", "times"), "point").withColumn("own", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1)).select("dim", "cell", "i", "j", "point", "home", "side", "times", "cells", "unit")
    found = save(dealt.groupBy("dim", "cell", "i", "j").applyInArrow(_compare(threshold), "kind int, a long, b long"), "found")
    counts = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "point")
    groups = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "point")
    known = points.select("unit", "point", "times", "least").join(counts, "point", "left").join(groups, "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("unit", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = vectors.join(known, "unit", "left").withColumn("component_id", F.coalesce("component_id", "vec_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    mark = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return out.select(mark.alias("vec_id"), "n_links", F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def dedup_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``df``'s rows that represent their group."""
    kept = link(df, id_col, vector_col, **options).filter("kept").select("vec_id").distinct()
    return semi_join(df, kept, F.col(f"`{id_col}`").cast("long"))
