"""Tables and indexes as immutable entries; a catalog is a dict of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as c
from ..functions import values as v
from ..functions.columns import BLOB, DYN, INT, NULL, REAL, TEXT, Val
from ..operators.select import ROW, Source
from ..plans.nodes import ColumnDef

_TYPES = {INT: T.LongType(), REAL: T.DoubleType(), TEXT: T.StringType(), BLOB: T.BinaryType(), DYN: c.DYN_TYPE}
#: The class of an empty column of an affinity.
_BY_AFFINITY = {"INTEGER": INT, "REAL": REAL, "TEXT": TEXT, "BLOB": BLOB, "NUMERIC": INT}


def class_of(x: Any) -> str:
    return NULL if x is None else INT if isinstance(x, int) else REAL if isinstance(x, float) else TEXT if isinstance(x, str) else BLOB


def dyn_value(x: Any) -> tuple | None:
    """A value as a row of the DYN struct."""
    if x is None:
        return None
    k = {INT: 0, REAL: 1, TEXT: 2, BLOB: 3}[class_of(x)]
    return (k + 1, *(x if j == k else None for j in range(4)))


def python_value(x: Any) -> Any:
    """A collected cell as a value."""
    if isinstance(x, T.Row) and "cls" in x.__fields__:
        x = x[x["cls"]]
    if isinstance(x, bool):
        return int(x)
    return bytes(x) if isinstance(x, bytearray) else x


class Rows:
    """Rows in memory, never changed. A version with a row more shares what it has with the one before.

    Beside the rows stand, made when first asked for, the places of unique keys
    and the rows' text in a manifest.
    """

    __slots__ = ("_all", "_n", "_places", "_texts")

    def __init__(self, rows: Iterable[tuple] = ()):
        self._all, self._places, self._texts = list(rows), {}, []
        self._n = len(self._all)

    def __len__(self) -> int:
        return self._n

    def __iter__(self) -> Iterator[tuple]:
        return islice(self._all, self._n)

    def plus(self, row: tuple) -> "Rows":
        own = self if self._n == len(self._all) else Rows(self)  # another version has gone on from here
        new = Rows.__new__(Rows)
        new._all, new._places, new._texts, new._n = own._all, own._places, own._texts, own._n + 1
        for key_of, known in own._places.values():
            if (key := key_of(row)) is not None:
                known.setdefault(key, own._n)
        own._all.append(row)
        return new

    def places(self, name: tuple, key_of: Callable[[tuple], Any]) -> dict:
        """The first place of each key; there may be keys of later versions' rows, at places past the end."""
        if name in self._places:
            return self._places[name][1]
        known: dict = {}
        for i, r in enumerate(self):
            if (key := key_of(r)) is not None:
                known.setdefault(key, i)
        if self._n == len(self._all):
            self._places[name] = key_of, known
        return known

    def texts(self, text_of: Callable[[tuple], str]) -> Iterator[str]:
        """Each row as text, made once."""
        self._texts += map(text_of, self._all[len(self._texts) : self._n])
        return islice(self._texts, self._n)


@dataclass(frozen=True)
class Table:
    """A table: rows in files (``parts``, each with classes of its columns), then rows in memory.

    Files are immutable and shared by every version of the table that has them.
    """

    name: str
    columns: tuple[ColumnDef, ...]
    #: Groups of columns that are unique together, besides the columns that are so themselves.
    keys: tuple[tuple[str, ...], ...]
    sql: str
    parts: tuple["Part", ...] = ()
    rows: Rows = field(default_factory=Rows, compare=False)
    #: Row numbers of ``rows`` begin here.
    base: int = 0
    #: A registered table: a frame that is not ours to change.
    frame: Any = None
    #: Whether the frame is Parquet files as they are, whose rows have a place.
    in_files: bool = False
    cache: dict = field(default_factory=dict, compare=False)

    @property
    def affinities(self) -> list[str]:
        return [v.affinity(x.type) for x in self.columns]

    def with_rows(self, rows: Iterable[tuple]) -> "Table":
        return replace(self, rows=Rows(rows), cache={})

    def source(self, spark: SparkSession) -> Source:
        if self.frame is not None:
            vals = [(f.name, c.column_of(f, F.col(f"`{f.name}`"))) for f in self.frame.schema.fields]
            if self.in_files:
                first = F.struct("_metadata.file_path", "_metadata.row_index")
            else:
                first = F.struct(*(c.plain(x) for _, x in vals if x.cls != "OPAQUE"))
            return Source(self.frame, vals, first=first)
        if "source" not in self.cache:
            self.cache["source"] = self._source(spark)
        return self.cache["source"]

    def _source(self, spark: SparkSession) -> Source:
        n = len(self.columns)
        pieces = [(p.classes, p.read(spark, n)) for p in self.parts]
        if len(self.rows) or not pieces:
            classes = []
            for i, aff in enumerate(self.affinities):
                met = {class_of(r[i]) for r in self.rows} - {NULL}
                classes.append(met.pop() if len(met) == 1 else DYN if met else _BY_AFFINITY[aff])
            pieces.append((tuple(classes), local_frame(spark, self.rows, tuple(classes), self.base)))
        classes = tuple(k[0] if len(set(k)) == 1 else DYN for k in zip(*(p for p, _ in pieces)))
        df = None
        for own, piece in pieces:
            piece = piece.select(ROW, *((c.dyn(Val(F.col(f"c{i}"), a, leaf=True)) if a != b else F.col(f"c{i}")).alias(f"c{i}") for i, (a, b) in enumerate(zip(own, classes))))
            df = piece if df is None else df.unionByName(piece)
        vals = [(col.name, Val(F.col(f"c{i}"), k, aff=aff, leaf=True)) for i, (col, k, aff) in enumerate(zip(self.columns, classes, self.affinities))]
        return Source(df, vals, numbered=True)


def local_frame(spark: SparkSession, rows: Iterable[tuple], classes: tuple[str, ...], base: int) -> DataFrame:
    schema = T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(f"c{i}", _TYPES[k]) for i, k in enumerate(classes))])
    data = [(base + j, *(dyn_value(x) if k == DYN else x for x, k in zip(r, classes))) for j, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


@dataclass(frozen=True)
class Part:
    """A folder of Parquet files with columns __row, c0, c1, ..."""

    path: str
    classes: tuple[str, ...]
    rows: int = 0

    def read(self, spark: SparkSession, columns: int) -> DataFrame:
        schema = T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(f"c{i}", _TYPES[k]) for i, k in enumerate(self.classes))])
        return _read(spark, self.path, schema.json())


@lru_cache(maxsize=1024)
def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    import json

    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path)


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple[tuple[str, bool], ...]
    unique: bool
    sql: str


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def put(self, table: Table, old: str | None = None) -> "Catalog":
        tables = {(table.name if k == old else k): (table if k in (old, table.name) else x) for k, x in self.tables.items()}
        tables.setdefault(table.name, table)
        return replace(self, tables=tables)

    def without(self, name: str) -> "Catalog":
        return Catalog({k: t for k, t in self.tables.items() if k != name}, {k: i for k, i in self.indexes.items() if i.table.lower() != name.lower()})

    def master(self) -> tuple[tuple, ...]:
        """The rows of sqlite_master, by type and name."""
        rows = [("table", t.name, t.name, 0, t.sql) for t in self.tables.values()] + [("index", i.name, i.table, 0, i.sql) for i in self.indexes.values()]
        return tuple(sorted(rows))


_MASTER = Table("sqlite_master", tuple(ColumnDef(n, t) for n, t in (("type", "TEXT"), ("name", "TEXT"), ("tbl_name", "TEXT"), ("rootpage", "INT"), ("sql", "TEXT"))), (), "")


def find(catalog: Catalog, name: str) -> Table | None:
    """A table by its name (case counts), or the catalog as one (case does not)."""
    if name in catalog.tables:
        return catalog.tables[name]
    return _MASTER.with_rows(catalog.master()) if name.lower() == "sqlite_master" else None
