"""The dialect's SELECT over unbounded tables.

The dialect has one-shot statements only; a streaming DataFrame registered as a
table runs the same plans, as far as Structured Streaming can: filters and
projections in append mode, aggregates in complete mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..plans.nodes import Aggregate
from ..plans.parser import parse
from ..sources.store import Store


def select_stream(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A SELECT over the given frames, batch or streaming."""
    store = Store(spark)
    for name, df in tables.items():
        store.register(name, df)
    return store.sql(sql)


def write_stream(spark: SparkSession, sql: str, **tables: DataFrame) -> DataStreamWriter:
    """The same as a writer in the output mode that the statement needs."""
    x = parse(sql)
    grouped = bool(x.group) or any(isinstance(y, Aggregate) for o in x.outputs or () for y in o.x.walk())
    return select_stream(spark, sql, **tables).writeStream.outputMode("complete" if grouped else "append")
