"""A training corpus from raw documents: five operators of tessera.llm, one after the other.

Each stage reads what its predecessor has written, works on all of it and hands
on the columns of ``documents``; the last one gives the packed pieces.

1. quality rules: documents that the rules or the isolation forest reject go;
2. line dedup: a line that many documents hold stays in one of them;
3. MinHash near-dedup: one document of each group of near copies stays;
4. mixing: documents are taken as often as their source's target asks for, in
   the order of the curriculum;
5. best-fit packing: token pieces in sequences of 2048.

Defined cases: a null or empty text has no words, so the first stage rejects it; a
null id is an id like others; rows that repeat an id are judged each by its text,
and rows that repeat an id and a text are one document from the third stage on,
each row of which stays or goes with the others; long texts go through whole; of
near copies the one with the smallest id stays, and ties are those of the
operators; columns besides those of ``documents``, whatever their names, are handed
on untouched up to the last stage; ``n_chars`` follows the text where it is there;
without labels of both kinds the first stage applies its fixed rules only; an empty
table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash, mixing, packing, quality
from tessera.llm.common import drop, save
from tessera.session import ship

#: The forest is learned and the packing is arithmetic on ids of a tokenizer: no SQL says the same.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.dedup_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup),
    ("mixing", mixing_stage),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
