"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Method. The training run is a stream of T words, T the words of all documents.
Source s has a target G(s) of them and a weight schedule over the run's time
t in [0, 1], w(t) = G * (1 - b + 2*b*t) with a slope b between -1/2 and 1/2. The
schedule's integral is the source's cumulative demand D(t) = G*((1-b)*t + b*t^2).
A source's documents follow one another in a fixed pseudo-random order, pass
after pass; the pass that the target ends in stops at the target's word. A
document that begins c words into its source's stream takes the training position
T * D^-1(c), and the result is sorted by range on that position.

A source's order is cut into blocks, so that no source is summed in one task:
words are summed by (source, block), the blocks' sums give each block its base,
and only within a block do documents follow one another in a window.

A row for each source is ranked in one task; documents are not.

Defined cases: a null text has no words; a text is counted where it is read, however
long; null is a source of its own and comes last; a document without words takes
none; rows that repeat an id are documents of their own, and their places differ if
their sizes do; of rows with one id, source and size it does not matter which
comes first; sources with one cap for their weight are capped in code point order;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, partitions, save

WEIGHTS = (5, 2, 1)
#: Slopes of the schedules, repeating over the sources as the weights do: late, even, early.
SLOPES = (0.5, 0.0, -0.5, 0.25)
#: Rows of a source that one block holds, about.
BLOCK_ROWS = 50_000
_PRIME = 2147483647


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size, rank, target) of a table (source, size) of documents.

    Sources share all words by weight; a target stops at ``cap`` times its source
    and the rest is shared again by weight. That ends where the sources with the
    least cap for their weight are at their cap and the others get one factor
    times their weight, so one pass over the sources in that order finds it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("rank", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*(F.lit(w).cast("double") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("all_words", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    ranked = ranked.withColumn("most_before", F.coalesce(F.sum("most").over(up), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    share = (F.col("all_words") - F.col("most_before")) * F.col("weight") / (F.col("all_weight") - F.col("weight_before"))
    ranked = ranked.withColumn("capped", F.col("most") <= share)
    open_weight, open_words = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.col("all_words") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("most")).otherwise(open_words * F.col("weight") / open_weight)
    return ranked.withColumn("target", target).select("source", "source_size", "rank", "all_words", "target")


def _position(before):
    """T * D^-1(before): D(t) = G*((1-b)*t + b*t*t) = before, solved for t; b = 0 is the plain share."""
    c = F.when(F.col("target") > 0, F.least(before / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    b = F.col("slope")
    t = F.when(b == 0, c).otherwise((F.sqrt((1 - b) * (1 - b) + 4 * b * c) - (1 - b)) / (2 * b))
    return F.floor(F.col("all_words") * t).cast("long")


def _plan(df: DataFrame, weights, slopes, cap: int, seed: int, id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    # a few short columns of all documents: what follows reads them more than once, the texts once
    docs = save(docs, "mix-sizes")
    id_ = F.coalesce(F.pmod("doc_id", F.lit(_PRIME)), F.lit(0))
    # the size as well, so that rows of one id (null, say) are dealt to many blocks
    docs = docs.withColumn("turn", F.pmod(id_ * seed + F.pmod("size", F.lit(65536)) * 1566083941 + 12345, F.lit(_PRIME)))
    blocks = max(partitions(df.sparkSession), docs.count() // BLOCK_ROWS)
    docs = docs.withColumn("block", F.expr(f"turn * {blocks} div {_PRIME}"))
    by_source = targets(docs, weights, cap)
    words = docs.groupBy("source", "block").agg(F.sum("size").alias("words"))
    base = F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each source and block
    bases = words.withColumn("base", F.coalesce(base, F.lit(0))).join(by_source, words["source"].eqNullSafe(by_source["source"]))
    bases = bases.select(words["source"].alias("of"), F.col("block").alias("of_block"), "base", "source_size", "rank", "all_words", "target")
    docs = docs.join(bases, docs["source"].eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    before = F.sum("size").over(Window.partitionBy("source", "block").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    docs = docs.withColumn("before", F.col("base") + F.coalesce(before, F.lit(0))).withColumn("wanted", F.floor(F.col("target") + 0.5).cast("long"))
    docs = docs.withColumn("full", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)))
    docs = docs.withColumn("rest", F.col("wanted") - F.col("full") * F.col("source_size") - F.col("before"))
    last = F.when(F.col("rest") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.least(F.greatest("rest", F.lit(0)), "size")
    last = F.when(F.col("full") >= cap, F.lit(0)).otherwise(last)
    docs = docs.withColumn("taken", (F.col("full") * F.col("size") + last).cast("long"))
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    slope = F.element_at(F.array(*(F.lit(float(x)) for x in slopes)), (F.col("rank") % len(slopes) + 1).cast("int"))
    return docs.withColumn("passes", passes).withColumn("slope", slope)


def mix(df: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = 3, seed: int = 1103515245, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, position), sorted by position.

    ``taken``: the words that the mix takes of the document, repeats counted.
    ``passes``: how often it is taken, the last time perhaps in part.
    ``position``: the training word at which it is taken first. With ``whole`` a
    document is taken whole or not in the last pass (taken, if the target reaches
    its middle).
    """
    plan = _plan(df, weights, slopes, cap, seed, id_col, text_col, source_col, whole).withColumn("position", _position(F.col("before")))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position").orderBy("position", "doc_id")


def apply_mix(df: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = 3, seed: int = 1103515245, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``df``'s rows, each as often as the mix takes it whole, sorted by training position.

    Rows that agree in id, source and number of words share their passes: each
    is taken as often as the one that is taken most.
    """
    plan = _plan(df, weights, slopes, cap, seed, id_col, text_col, source_col, whole=True).filter("passes > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.max(F.struct("passes", "before", "source_size", "target", "all_words", "slope")).alias("x")).select("doc_id", "source", "size", "x.*")
    plan = plan.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))).withColumn("position", _position(F.col("before") + F.col("pass") * F.col("source_size")))
    names = free_names(df, "doc_id", "source", "size", "position")
    plan = plan.select("doc_id", "source", "size", "position").toDF(*names)
    doc_id, source, size, position = (F.col(f"`{x}`") for x in names)
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(doc_id) & F.col(f"`{source_col}`").cast("string").eqNullSafe(source) & (word_count(F.col(f"`{text_col}`")) == size)
    return df.join(plan.hint("shuffle_hash"), on).orderBy(position, doc_id).select(*(F.col(f"`{c}`") for c in df.columns))


#: The words of a document, and the mix without its positions, in SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (source_size * 3)::DOUBLE AS most FROM s),
x AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS all_words, sum(weight) OVER () AS all_weight,
  coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most_before,
  coalesce(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
y AS (SELECT *, most <= (all_words - most_before) * weight / (all_weight - weight_before) AS capped FROM x),
z AS (SELECT source, source_size, all_words, rank, CASE WHEN capped THEN most ELSE
  (all_words - coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0)) * weight / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target FROM y),
o AS (SELECT d.doc_id, d.size, z.source_size, z.target, z.all_words,
  CASE z.rank % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN -0.5::DOUBLE ELSE 0.25::DOUBLE END AS b,
  CAST(floor(z.target + 0.5) AS BIGINT) AS wanted,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY (coalesce(((d.doc_id % 2147483647) + 2147483647) % 2147483647, 0) * 1103515245 + (d.size % 65536) * 1566083941 + 12345) % 2147483647, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes, CASE WHEN target > 0 THEN least(before::DOUBLE / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS c FROM o)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + CASE WHEN passes >= 3 THEN 0 ELSE least(greatest(wanted - passes * source_size - before, 0), size) END AS BIGINT) AS taken,
  CAST(floor(all_words * CASE WHEN b = 0 THEN c ELSE (sqrt((1 - b) * (1 - b) + 4 * b * c) - (1 - b)) / (2 * b) END) AS BIGINT) AS position
FROM p
"""
