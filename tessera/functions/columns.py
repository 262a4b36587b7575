"""Scalar semantics as columns.

Every compiled expression is a ``Val``: a column with its storage class. Where
the class is known, the column has the class's own type (INT long or shorter,
REAL double, TEXT string, BLOB binary), so filters reach the scan and aggregates
stay in generated code. Where the class depends on the data (an integer sum that
may not fit, a column that mixes classes), the class is DYN and the column a
struct (cls, i, r, t, b); NULL is a null struct.

Integer expressions carry bounds; an operation whose result's bounds fit 64 bits
stays INT. Predicates carry their boolean column, so WHERE, AND, OR and NOT never
see the 0 and 1 that a projection shows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SQLError
from ..plans.nodes import Aggregate, Between, Binary, Cast, Column, Expr, In, Like, Literal, Unary
from . import values as v
from .evaluate import evaluate

INT, REAL, TEXT, BLOB, NULL, DYN = "INT", "REAL", "TEXT", "BLOB", "NULL", "DYN"
LOW, HIGH = v.LOW, v.HIGH
_SAFE = 2**53
DYN_TYPE = T.StructType([T.StructField("cls", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("b", T.BinaryType())])
_NUMBER = r"^[ \t\n\r]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_WHOLE = _NUMBER + r"[ \t\n\r]*$"
_INTEGER = r"^[ \t\n\r]*([+-]?[0-9]+)"


@dataclass
class Val:
    col: SparkColumn
    cls: str
    low: int = LOW
    high: int = HIGH
    aff: str | None = None
    pred: SparkColumn | None = None
    #: A constant's value (in a tuple, as NULL is one).
    const: tuple | None = None
    #: The timestamp that a TEXT shows.
    time: SparkColumn | None = None
    #: A column of a frame or a constant: what may stand several times in a plan.
    leaf: bool = False
    #: A DYN that is never a text or a blob.
    numeric: bool = False


def let(x: Val, f) -> SparkColumn:
    """f of a value's column, which stands in the plan once however often f uses it."""
    if x.leaf:
        return f(x.col)
    return F.element_at(F.transform(F.array(x.col), lambda y: f(y)), 1)


def null_of(kind: str) -> SparkColumn:
    return F.lit(None).cast(kind)


def constant(x: Any) -> Val:
    if x is None:
        return Val(null_of("string"), NULL, const=(None,), leaf=True)
    if isinstance(x, int):
        return Val(F.lit(x).cast("int" if abs(x) < 2**31 else "bigint"), INT, x, x, const=(x,), leaf=True)
    if isinstance(x, float):
        return Val(F.lit(x).cast("double"), REAL, const=(x,), leaf=True)
    if isinstance(x, bytes):
        return Val(F.lit(bytearray(x)), BLOB, const=(x,), leaf=True)
    if any(0xD800 <= ord(y) <= 0xDFFF for y in x):  # a text of bytes that are no UTF-8
        return Val(F.unhex(F.lit(x.encode("utf-8", "surrogateescape").hex())).cast("string"), TEXT, const=(x,), leaf=True)
    return Val(F.lit(x), TEXT, const=(x,), leaf=True)


def boolean(pred: SparkColumn) -> Val:
    return Val(pred.cast("int"), INT, 0, 1, pred=pred)


def column_of(field_: T.StructField, col: SparkColumn, aff: str | None = None) -> Val:
    """A table's column by its Spark type."""
    out = _column_of(field_, col, aff)
    out.leaf = True
    return out


def _column_of(field_: T.StructField, col: SparkColumn, aff: str | None) -> Val:
    t = field_.dataType
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(t)]
        return Val(col, INT, -(2**bits), 2**bits - 1, aff or "INTEGER")
    if isinstance(t, T.BooleanType):
        return Val(col.cast("int"), INT, 0, 1, aff or "INTEGER", pred=col)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return Val(col.cast("double") if isinstance(t, T.FloatType) else col, REAL, aff=aff or "REAL")
    if isinstance(t, T.DecimalType):
        return Val(col.cast("double"), REAL, aff=aff or "NUMERIC")
    if isinstance(t, T.StringType):
        return Val(col, TEXT, aff=aff or "TEXT")
    if isinstance(t, T.BinaryType):
        return Val(col, BLOB, aff=aff or "BLOB")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Val(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"), TEXT, aff=aff or "TEXT", time=col.cast("timestamp_ntz"))
    if isinstance(t, T.DateType):
        return Val(F.date_format(col, "yyyy-MM-dd"), TEXT, aff=aff or "TEXT")
    if t == DYN_TYPE:
        return Val(col, DYN, aff=aff or "BLOB")
    return Val(col, "OPAQUE", aff=aff)


# classes and conversions


def int_col(x: Val) -> SparkColumn:
    return x.col.cast("bigint")


def dyn(x: Val) -> SparkColumn:
    """Any value as a tagged struct."""
    if x.cls == DYN:
        return x.col
    if x.cls == NULL:
        return null_of(DYN_TYPE.simpleString())
    return let(x, lambda col: F.when(col.isNotNull(), _struct(x.cls, col)))


def _struct(cls: str, col: SparkColumn) -> SparkColumn:
    n = {INT: 1, REAL: 2, TEXT: 3, BLOB: 4}[cls]
    part = {1: ("i", "bigint"), 2: ("r", "double"), 3: ("t", "string"), 4: ("b", "binary")}
    return F.struct(F.lit(n).cast("tinyint").alias("cls"), *((col.cast(kind) if k == n else null_of(kind)).alias(name) for k, (name, kind) in part.items()))


def sort_key(x: Val) -> SparkColumn:
    """A struct that orders and groups like values do: numbers, texts, blobs; 1 with 1.0. Null for NULL."""
    two63 = F.lit(float(2**63))

    def key(rank: int, dbl, over, exact, t, b) -> SparkColumn:
        return F.struct(F.lit(rank).cast("tinyint").alias("rank"), dbl.alias("dbl"), over.cast("tinyint").alias("over"), exact.alias("exact"), t.alias("t"), b.alias("b"))

    none = (F.lit(0.0), F.lit(0), F.lit(0).cast("bigint"))
    no_t, no_b = F.lit(""), F.lit(bytearray(b""))

    def of_int(i):
        return key(1, i.cast("double"), F.lit(0), i.cast("bigint"), no_t, no_b)

    def of_real(r):
        inside = (r < two63) & (r >= -two63)
        return key(1, r, F.when(r >= two63, 1).otherwise(0), F.when(inside, F.when(inside, r).otherwise(0.0).cast("bigint")).otherwise(F.lit(0).cast("bigint")), no_t, no_b)

    def of_text(t):
        return key(2, *none, t, no_b)

    def of_blob(b):
        return key(3, *none, no_t, b)

    if x.cls == NULL:
        return F.when(F.lit(False), of_text(F.lit("")))
    def of_dyn(c):
        i, r = F.coalesce(c["i"], F.lit(0).cast("bigint")), F.coalesce(c["r"], F.lit(0.0))
        out = F.when(c["cls"] == 1, of_int(i)).when(c["cls"] == 2, of_real(r))
        return out.when(c["cls"] == 3, of_text(F.coalesce(c["t"], no_t))).when(c["cls"] == 4, of_blob(F.coalesce(c["b"], no_b)))

    if x.cls == DYN:
        return let(x, of_dyn)
    make = {INT: of_int, REAL: of_real, TEXT: of_text, BLOB: of_blob}[x.cls]
    return let(x, lambda col: F.when(col.isNotNull(), make(col)))


def plain(x: Val) -> SparkColumn:
    """The column that a result shows; INT is long."""
    return int_col(x) if x.cls == INT else x.col


def group_key(x: Val) -> SparkColumn:
    return sort_key(x) if x.cls == DYN else x.col


def _real_text(x: SparkColumn) -> SparkColumn:
    """15 significant digits without the zeros that Java leaves at their end, and always a point.

    Whole numbers, and those that Java writes plainly in 15 digits at most, are
    right as they are; only others are formatted.
    """

    def shown(r):
        digits = F.regexp_replace(F.format_string("%.15g", r), r"(\.[0-9]*?)0+(e[+-][0-9]+)?$", "$1$2")
        digits = F.regexp_replace(digits, r"\.(e|$)", ".0$1")
        inf = F.lit(float("inf"))
        size, short = F.abs(r), r.cast("string")
        whole = F.when(size < 1e15, r).cast("bigint")
        digits = F.when((size < 1e15) & (whole.cast("double") == r), F.concat(whole.cast("string"), F.lit(".0"))).when((size >= 1e-3) & (size < 1e7) & (F.length(short) <= 16), short).otherwise(digits)
        return F.when(r == inf, "Inf").when(r == -inf, "-Inf").when(F.isnan(r), "").when(r == 0, "0.0").when(r.isNotNull(), digits)

    return let(Val(x, REAL), shown)


@F.arrow_udf(T.BooleanType())
def _like_rows(x: pa.Array, pattern: pa.Array, escape: pa.Array, op: pa.Array) -> pa.Array:
    texts, patterns = ([None if y is None else y.decode("utf-8", "surrogateescape") for y in z.cast(pa.binary()).to_pylist()] for z in (x, pattern))
    return pa.array([v.like(o, a, p, e) for a, p, e, o in zip(texts, patterns, escape.to_pylist(), op.to_pylist())], pa.bool_())


def text(x: Val) -> SparkColumn:
    """A value as text."""
    if x.cls == TEXT:
        return x.col
    if x.cls == NULL:
        return null_of("string")
    if x.cls == INT:
        return x.col.cast("string")
    if x.cls == REAL:
        return _real_text(x.col)
    if x.cls == BLOB:
        return x.col.cast("string")
    return let(x, lambda c: F.coalesce(c["i"].cast("string"), _real_text(c["r"]), c["t"], c["b"].cast("string")))


def _leading(t: SparkColumn, pattern: str = _NUMBER) -> SparkColumn:
    """The number that a text begins with, '' if none."""
    return F.regexp_extract(t, pattern, 1)


def _number_of_text(t: Val) -> SparkColumn:
    """The leading number of a text as a DYN of INT or REAL, 0 if there is none."""

    def of_lead(lead):
        whole = F.when(lead.rlike(r"^[+-]?[0-9]+$"), lead.try_cast("bigint"))
        return F.when(lead == "", _struct(INT, F.lit(0))).when(whole.isNotNull(), _struct(INT, whole)).when(lead.isNotNull(), _struct(REAL, lead.try_cast("double")))

    return let(Val(_leading(t.col), TEXT), of_lead)


def number(x: Val) -> Val:
    """An operand of arithmetic: INT, REAL, NULL, or a DYN of the two."""
    if x.cls in (INT, REAL, NULL) or x.numeric:
        return x
    if x.const:
        return constant(v.number(x.const[0]))
    if x.cls in (TEXT, BLOB):
        return Val(_number_of_text(Val(text(x), TEXT)), DYN, numeric=True)

    def of_dyn(c):
        t = F.coalesce(c["t"], c["b"].cast("string"))
        return F.when(c["cls"] <= 2, c).otherwise(_number_of_text(Val(t, TEXT)))

    return Val(let(x, of_dyn), DYN, numeric=True)


def real(x: Val) -> SparkColumn:
    """A value as a double."""
    x = number(x)
    if x.cls == NULL:
        return null_of("double")
    if x.cls == DYN:
        return let(x, lambda c: F.coalesce(c["r"], c["i"].cast("double")))
    return x.col.cast("double")


def _saturated(x: SparkColumn) -> SparkColumn:
    """A double cut to a long, without an overflow."""
    return let(Val(x, REAL), _cut)


def _cut(r: SparkColumn) -> SparkColumn:
    inside = (r > F.lit(-float(2**63))) & (r < F.lit(float(2**63)))
    return F.when(r.isNull(), null_of("bigint")).when(inside, F.when(inside, r).otherwise(0.0).cast("bigint")).when(r > 0, F.lit(HIGH)).otherwise(F.lit(LOW))


def truth(x: Val) -> SparkColumn:
    if x.pred is not None:
        return x.pred
    if x.const:
        t = v.truth(x.const[0])
        return null_of("boolean") if t is None else F.lit(t)
    if x.cls == INT:
        return x.col != F.lit(0)
    return real(x) != F.lit(0.0)


# arithmetic


def _bounds(op: str, a: Val, b: Val) -> tuple[int, int] | None:
    if op == "+":
        return a.low + b.low, a.high + b.high
    if op == "-":
        return a.low - b.high, a.high - b.low
    if op == "*":
        corners = [x * y for x in (a.low, a.high) for y in (b.low, b.high)]
        return min(corners), max(corners)
    if op == "/":
        most = max(abs(a.low), abs(a.high))
        return -most, most
    most = min(max(abs(a.low), abs(a.high)), max(abs(b.low), abs(b.high)))
    return -most, most


def arithmetic(op: str, a: Val, b: Val) -> Val:
    a, b = number(a), number(b)
    if NULL in (a.cls, b.cls):
        return constant(None)
    if a.cls == INT and b.cls == INT:
        return _int_arithmetic(op, a, b)
    if DYN in (a.cls, b.cls):

        def both(x, y):
            p, q = _bound(a, x), _bound(b, y)
            as_real = _real_arithmetic(op, real(p), real(q))
            ints = [Val(z.col["i"], INT, leaf=True) if z.cls == DYN else z if z.cls == INT else None for z in (p, q)]
            if None in ints:
                return dyn(Val(as_real, REAL))
            whole = F.lit(True)
            for z in (p, q):
                if z.cls == DYN:
                    whole = whole & (z.col["cls"] == 1)
            return F.when(whole, dyn(_int_arithmetic(op, *ints))).otherwise(dyn(Val(as_real, REAL)))

        return Val(let(a, lambda x: let(b, lambda y: both(x, y))), DYN, numeric=True)
    return Val(_real_arithmetic(op, real(a), real(b)), REAL)


def _bound(x: Val, col: SparkColumn) -> Val:
    """A value by another name for its column."""
    return Val(col, x.cls, x.low, x.high, x.aff, leaf=True, numeric=x.numeric)


def _int_arithmetic(op: str, a: Val, b: Val) -> Val:
    low, high = _bounds(op, a, b)  # type: ignore[misc]
    fits = low >= LOW and high <= HIGH
    x, y = int_col(a), int_col(b)
    if op in ("+", "-", "*") and fits:
        return Val(x + y if op == "+" else x - y if op == "-" else x * y, INT, low, high)
    if op == "%":
        return Val(F.try_mod(x, y), INT, low, high)
    if op == "/":
        if b.const:
            if b.const[0] == 0:
                return Val(null_of("bigint"), INT, low, high)
            if fits:
                return Val(F.call_function("div", x, y), INT, low, high)
        if fits:
            return Val(F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint"))), INT, low, high)

        def divided(p, q):
            p, q = p.cast("bigint"), q.cast("bigint")
            over = (p == LOW) & (q == -1)
            whole = F.call_function("div", F.when(~over, p), F.when(q != 0, q))
            return F.when(over, _struct(REAL, F.lit(float(2**63)))).otherwise(dyn(Val(whole, INT)))

        return Val(let(a, lambda p: let(b, lambda q: divided(p, q))), DYN, numeric=True)
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]

    def promoted(p, q):
        p, q = p.cast("bigint"), q.cast("bigint")
        u, w = p.cast("double"), q.cast("double")
        wide = u + w if op == "+" else u - w if op == "-" else u * w
        # a double tells but for a narrow band around 2^63 whether the result fits; the checked
        # operation raises and catches for each row that does not
        size = F.abs(wide)
        plain_ = p + q if op == "+" else p - q if op == "-" else p * q
        whole = F.when(size < F.lit(9.2e18), plain_).when(size < F.lit(9.3e18), f(p, q))
        return F.when(p.isNull() | q.isNull(), null_of(DYN_TYPE.simpleString())).when(whole.isNotNull(), _struct(INT, whole)).otherwise(_struct(REAL, wide))

    return Val(let(a, lambda p: let(b, lambda q: promoted(p, q))), DYN, numeric=True)


def _real_arithmetic(op: str, x: SparkColumn, y: SparkColumn) -> SparkColumn:
    if op == "%":
        return F.try_mod(_saturated(x), _saturated(y)).cast("double")
    if op == "/":
        return F.nanvl(F.try_divide(x, y), null_of("double"))
    out = x + y if op == "+" else x - y if op == "-" else x * y
    return F.nanvl(out, null_of("double"))


# comparison


def _apply(x: Val, aff: str | None) -> Val:
    """The conversion that a comparison makes of one side."""
    if aff is None or x.cls in (NULL, BLOB):
        return x
    if x.const:
        return constant(v.for_comparison(x.const[0], aff))
    if aff == "TEXT":
        if x.cls in (INT, REAL):
            return Val(text(x), TEXT)
        return Val(F.when(x.col["cls"] <= 2, _struct(TEXT, text(x))).otherwise(x.col), DYN) if x.cls == DYN else x
    if x.cls in (INT, REAL):
        return x
    if x.cls == TEXT:
        return Val(let(x, lambda t: F.coalesce(F.when(t.rlike(_WHOLE), _number_of_text(Val(t, TEXT, leaf=True))), _struct_or_null(TEXT, t))), DYN)

    def of_dyn(c):
        return F.when((c["cls"] == 3) & c["t"].rlike(_WHOLE), _number_of_text(Val(c["t"], TEXT, leaf=True))).otherwise(c)

    return Val(let(x, of_dyn), DYN)


def _struct_or_null(cls: str, col: SparkColumn) -> SparkColumn:
    return F.when(col.isNotNull(), _struct(cls, col))


_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_RANK = {INT: 1, REAL: 1, TEXT: 2, BLOB: 3}
_TURNED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def compare(op: str, a: Val, b: Val, listed: bool = False) -> SparkColumn:
    """A boolean column; ``listed``: b is an item of a list and brings no affinity."""
    if a.const and b.time is not None:
        a, b, op = b, a, _TURNED.get(op, op)
    if a.time is not None and b.const and (out := _time_with_text(op, a.time, b.const[0])) is not None:
        return out
    to_a, to_b = v.comparison_affinity(a.aff, None if listed else b.aff)
    a, b = _apply(a, to_a), _apply(b, to_b)
    if op in ("IS", "ISNOT"):
        same = _same(a, b)
        return same if op == "IS" else ~same
    if NULL in (a.cls, b.cls):
        return null_of("boolean")
    if DYN in (a.cls, b.cls):
        return _OPS[op](sort_key(a), sort_key(b))
    if _RANK[a.cls] != _RANK[b.cls]:
        fixed = F.lit(bool(_OPS[op](_RANK[a.cls], _RANK[b.cls])))
        return F.when(a.col.isNotNull() & b.col.isNotNull(), fixed)
    if a.cls == b.cls:
        return _OPS[op](a.col, b.col)
    # INT with REAL
    if a.cls == REAL:
        a, b, op = b, a, _TURNED[op]
    if b.const and (out := _int_with_real(op, a, b.const[0])) is not None:
        return out
    if max(abs(a.low), abs(a.high)) <= _SAFE:
        return _OPS[op](a.col.cast("double"), b.col)
    return _OPS[op](sort_key(a), sort_key(b))


def _int_with_real(op: str, a: Val, r: float) -> SparkColumn | None:
    """An integer column with a real constant, as integers: the scan can use that."""
    import math

    known = a.col.isNotNull()
    if r != r:
        return None
    if r >= 2**63 or r < -(2**63):
        return F.when(known, F.lit(op == "!=" or (op in ("<", "<=")) == (r > 0) and op not in ("=",)))
    if r == int(r):
        return _OPS[op](a.col, constant(int(r)).col)
    if op in ("=", "!="):
        return F.when(known, F.lit(op == "!="))
    return a.col <= constant(math.floor(r)).col if op in ("<", "<=") else a.col >= constant(math.ceil(r)).col


def _time_with_text(op: str, time: SparkColumn, text_: Any) -> SparkColumn | None:
    """A timestamp shown as text against a constant text, as timestamps: the scan can use that.

    A date alone is a prefix of its day's texts, and so comes before all of them.
    """
    import re

    m = re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2})( [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6})?", text_) if isinstance(text_, str) else None
    if not m or op not in _OPS:
        return None
    try:
        datetime.fromisoformat(text_)
        at = F.lit(text_ if m[2] else text_ + " 00:00:00").cast("timestamp_ntz")
    except ValueError:
        return None
    if m[2]:
        return _OPS[op](time, at)
    if op in ("=", "!="):
        return None
    return time >= at if op in (">", ">=") else time < at


def _same(a: Val, b: Val) -> SparkColumn:
    """IS: never null."""
    if a.cls == NULL and b.cls == NULL:
        return F.lit(True)
    if NULL in (a.cls, b.cls):
        return (a if b.cls == NULL else b).col.isNull()
    if a.cls == b.cls and a.cls != DYN:
        return a.col.eqNullSafe(b.col)
    if DYN not in (a.cls, b.cls) and _RANK[a.cls] != _RANK[b.cls]:
        return a.col.isNull() & b.col.isNull()
    return sort_key(a).eqNullSafe(sort_key(b))


# patterns and casts


def like(op: str, x: Val, pattern: Val, escape: str | None) -> SparkColumn:
    if NULL in (x.cls, pattern.cls):
        return null_of("boolean")
    if pattern.const:
        regex = v.like_regex(op, v.as_text(pattern.const[0]), escape)
        return text(x).rlike(regex + r"\z")
    return _like_rows(text(x), text(pattern), F.lit(escape), F.lit(op))


def cast(x: Val, type_name: str) -> Val:
    aff = v.affinity(type_name)
    if x.cls == NULL:
        return Val(x.col, NULL, aff=aff, const=x.const)
    if x.const:
        out = constant(v.cast(x.const[0], type_name))
        out.aff = aff
        return out
    if aff == "TEXT":
        return Val(text(x), TEXT, aff=aff)
    if aff == "BLOB":
        return Val(x.col if x.cls == BLOB else text(x).cast("binary"), BLOB, aff=aff)
    if aff == "REAL":
        return Val(real(x), REAL, aff=aff)
    if aff == "INTEGER":
        if x.cls == INT:
            return Val(x.col, INT, x.low, x.high, aff, x.pred)
        if x.cls == REAL:
            return Val(_saturated(x.col), INT, aff=aff)

        def whole(t):
            def of_lead(lead):
                past = F.when(lead.startswith("-"), F.lit(LOW)).otherwise(F.lit(HIGH))
                return F.when(lead == "", F.lit(0).cast("bigint")).when(lead.isNotNull(), F.coalesce(lead.try_cast("bigint"), past))

            return let(Val(_leading(t, _INTEGER), TEXT), of_lead)

        if x.numeric:
            return Val(let(x, lambda c: F.coalesce(c["i"], _cut(c["r"]))), INT, aff=aff)
        if x.cls == DYN:
            return Val(let(x, lambda c: F.when(c["cls"] == 1, c["i"]).when(c["cls"] == 2, _saturated(c["r"])).otherwise(whole(F.coalesce(c["t"], c["b"].cast("string"))))), INT, aff=aff)
        return Val(whole(text(x)), INT, aff=aff)
    if x.cls in (INT, REAL):
        return Val(x.col, x.cls, x.low, x.high, aff)

    def exact(n):
        r = n["r"]
        small = F.abs(r) < F.lit(float(2**51))
        whole = small & (r == F.floor(F.when(small, r)).cast("double"))
        return F.when(whole, _struct(INT, _saturated(r))).otherwise(n)

    if x.cls == DYN:  # numbers stay as they are
        return Val(let(x, lambda c: F.when(c["cls"] <= 2, c).otherwise(let(Val(_number_of_text(Val(F.coalesce(c["t"], c["b"].cast("string")), TEXT)), DYN), exact))), DYN, aff=aff)
    return Val(let(number(x), exact), DYN, aff=aff)


# expressions


@dataclass
class Scope:
    """What names and aggregates mean where an expression stands."""

    columns: dict[str, Val]
    #: Expressions that are known as a whole: group keys and aggregates, after grouping.
    known: dict[Expr, Val] = field(default_factory=dict)
    #: What a column that is none of these says.
    missing: str = "no such column: {}"
    aggregates: str = "misuse of aggregate: {}()"


def compile_expr(x: Expr, scope: Scope) -> Val:
    if x in scope.known:
        return scope.known[x]
    if isinstance(x, Literal):
        return constant(x.value)
    if isinstance(x, Column):
        if x.name.lower() not in scope.columns:
            raise SQLError(scope.missing.format(x.name))
        return scope.columns[x.name.lower()]
    if isinstance(x, Aggregate):
        if any(isinstance(y, Aggregate) for y in (x.x.walk() if x.x else ())):
            raise SQLError("aggregate outside group context")
        raise SQLError(scope.aggregates.format(x.name))
    if isinstance(x, Like) and x.escape is not None and isinstance(x.escape, Literal):
        v.escape_of(x.escape.value)
    children = [compile_expr(c, scope) for c in x.children()]
    for c in children:
        if c.cls == "OPAQUE":
            raise_opaque()
    if all(c.const for c in children) and not any(c.aff for c in children) and not isinstance(x, Cast):
        return constant(evaluate(_with_constants(x, children)))
    if isinstance(x, Unary):
        a = children[0]
        if x.op == "NOT":
            return boolean(~truth(a))
        return arithmetic("-", constant(0), a) if x.op == "-" else a
    if isinstance(x, Cast):
        return cast(children[0], x.type)
    if isinstance(x, Binary):
        a, b = children
        if x.op == "AND":
            return boolean(truth(a) & truth(b))
        if x.op == "OR":
            return boolean(truth(a) | truth(b))
        if x.op in ("IS", "ISNOT") and isinstance(x.b, Literal) and x.b.boolean:
            same = F.coalesce(truth(a) == F.lit(bool(x.b.value)), F.lit(False))
            return boolean(same if x.op == "IS" else ~same)
        if x.op in "+-*/%":
            return arithmetic(x.op, a, b)
        return boolean(compare(x.op, a, b))
    if isinstance(x, Between):
        a, low, high = children
        both = compare(">=", a, low) & compare("<=", a, high)
        return boolean(~both if x.negated else both)
    if isinstance(x, In):
        return boolean(_in(children[0], children[1:], x.negated))
    if isinstance(x, Like):
        escape = None
        if x.escape is not None:
            e = children[2]
            if not e.const:
                raise SQLError("ESCAPE expression must be a single character")
            if e.const[0] is None:
                return constant(None)
            escape = v.escape_of(e.const[0])
        hit = like(x.op, children[0], children[1], escape)
        return boolean(~hit if x.negated else hit)
    raise TypeError(x)


def raise_opaque() -> None:
    from ..errors import UnsupportedError

    raise UnsupportedError("expression over a nested column")


def _with_constants(x: Expr, children: list[Val]) -> Expr:
    """The expression over its children's values."""
    from dataclasses import fields, replace

    from ..plans.nodes import literal

    it = iter(children)
    new = {}
    for f in fields(x):  # type: ignore[arg-type]
        y = getattr(x, f.name)
        if isinstance(y, Expr):
            c = next(it)
            new[f.name] = y if isinstance(y, Literal) else literal(c.const[0])  # type: ignore[index]
        elif isinstance(y, tuple) and y and isinstance(y[0], Expr):
            new[f.name] = tuple(z if isinstance(z, Literal) else literal(c.const[0]) for z, c in ((z, next(it)) for z in y))  # type: ignore[index]
    return replace(x, **new)  # type: ignore[type-var]


def _in(a: Val, items: list[Val], negated: bool) -> SparkColumn:
    if not items:
        return F.lit(negated)
    if a.cls in (INT, TEXT) and all(i.const and i.cls == a.cls for i in items):
        hit = a.col.isin([i.const[0] for i in items])  # type: ignore[index]
    else:
        hit = compare("=", a, items[0], listed=True)
        for i in items[1:]:
            hit = hit | compare("=", a, i, listed=True)
    return ~hit if negated else hit
