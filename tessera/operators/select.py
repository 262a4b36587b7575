"""SELECT as one DataFrame plan.

Scan, filter, group, project, distinct, sort and limit are declared in this
order and left to Catalyst. Tables of a store carry a hidden row number, which
orders rows where the dialect says "insertion order", at every size; what reads
the result as a set (an aggregate, a join) makes Spark drop that sort. Registered
tables have no row number and no order of their own: no sort is added to them,
and the first row, where a bare column asks for it, is the first by file and place
in it (Parquet) or by value (other frames).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SQLError
from ..functions import columns as c
from ..functions import values as v
from ..functions.columns import DYN, INT, NULL, REAL, Scope, Val
from ..functions.evaluate import constant
from ..plans.nodes import Aggregate, Column, Expr, Literal, Order, Output, Select, has_aggregate

ROW = "__row"


@dataclass
class Source:
    """A table as a plan sees it."""

    df: DataFrame
    #: Column names as declared, with values over ``df``; the first of equal names counts.
    columns: list[tuple[str, Val]]
    #: Whether ``df`` has the hidden row number.
    numbered: bool = False
    #: What the first row is the least by, where there is no row number.
    first: SparkColumn | None = None

    def scope(self) -> dict[str, Val]:
        out: dict[str, Val] = {}
        for name, val in self.columns:
            out.setdefault(name.lower(), val)
        return out


@dataclass
class Plan:
    df: DataFrame
    names: list[str]
    classes: list[str] = field(default_factory=list)
    #: Which of the DYN columns hold numbers only.
    numeric: list[bool] = field(default_factory=list)


def output_name(o: Output) -> str:
    if o.alias:
        return o.alias
    x = o.x
    if isinstance(x, Literal):
        return v.render(x.value)
    if isinstance(x, Column):
        return x.name
    if isinstance(x, Aggregate):
        return "COUNT(*)" if x.x is None else f"{x.name}(expr)"
    return "expr"


def limits(s: Select) -> tuple[int | None, int]:
    """(rows or None for all, rows to skip)."""

    def whole(x: Expr | None) -> int | None:
        if x is None:
            return None
        n = constant(x)
        n = v.apply_affinity(n, "INTEGER")
        if not isinstance(n, int):
            raise SQLError("datatype mismatch")
        return n

    n, skip = whole(s.limit), whole(s.offset)
    return (None if n is None or n < 0 else n), max(skip or 0, 0)


def plan_select(spark: SparkSession, s: Select, source: Source | None) -> Plan:
    rows, skip = limits(s)
    if source is None:
        source = Source(spark.range(1).select(), [])
    scope = Scope(source.scope())
    outputs = s.outputs
    if outputs is None:
        outputs = tuple(Output(Column(name), name) for name, _ in source.columns)
    df = source.df
    if s.where is not None:
        if has_aggregate(s.where):
            raise SQLError("misuse of aggregate: " + next(y.name for y in s.where.walk() if isinstance(y, Aggregate)) + "()")
        df = df.filter(c.truth(c.compile_expr(s.where, scope)))
    grouped = bool(s.group) or any(has_aggregate(o.x) for o in outputs) or s.having is not None and has_aggregate(s.having) or any(has_aggregate(o.x) for o in s.order)
    if s.having is not None and not grouped:
        raise SQLError("HAVING clause on a non-aggregate query")
    numbered = source.numbered
    if grouped:
        df, scope = _group(df, s, outputs, scope, source)
        if s.having is not None:
            df = df.filter(c.truth(c.compile_expr(s.having, scope)))
    # project: outputs, then what only ORDER BY needs
    star = s.outputs is None
    vals = [val for _, val in source.columns] if star and not grouped else [c.compile_expr(o.x, scope) for o in outputs]
    names = [output_name(o).encode("utf-8", "surrogateescape").decode("utf-8", "replace") for o in outputs]  # a blob's bytes may be no text
    cols = [c.plain(x).alias(f"o{i}") for i, x in enumerate(vals)]
    shown = [_after(x, F.col(f"o{i}")) for i, x in enumerate(vals)]
    order, extra = _order(s.order, names, shown, scope, outputs)
    if s.distinct and extra:
        raise SQLError(f"no such column: {next(y.name for o in s.order for y in o.x.walk() if isinstance(y, Column) and y.name.lower() not in {n.lower() for n in names})}")
    if numbered:
        extra = [*extra, F.col(ROW)]
    df = df.select(*cols, *extra)
    if s.distinct:
        df = _distinct(df, shown, numbered)
    if numbered:
        order = [*order, F.col(ROW).asc()]
    if order:
        df = df.orderBy(*order)
    if skip and rows != 0:
        df = df.offset(skip)
    if rows is not None:
        df = df.limit(rows)
    df = df.select(*(F.col(f"o{i}") for i in range(len(vals)))).toDF(*names)
    return Plan(df, names, [x.cls for x in vals], [x.numeric for x in vals])


def _after(x: Val, col: SparkColumn) -> Val:
    """A value once it is a column of a new frame."""
    return Val(col, x.cls, x.low, x.high, x.aff, leaf=True, numeric=x.numeric)


def _group(df: DataFrame, s: Select, outputs: tuple[Output, ...], scope: Scope, source: Source) -> tuple[DataFrame, Scope]:
    keys = [c.compile_expr(g, scope) for g in s.group]
    exprs = [o.x for o in outputs] + ([s.having] if s.having is not None else [])
    names = {output_name(o).lower() for o in outputs}
    exprs += [o.x for o in s.order if not (isinstance(o.x, Column) and o.x.name.lower() in names) and o.ordinal is None]
    inside = {y for g in s.group for y in g.walk() if isinstance(y, Column)}
    aggregates: dict[Aggregate, int] = {}
    bare: dict[Column, int] = {}

    def collect(x: Expr) -> None:
        if x in s.group:
            return
        if isinstance(x, Aggregate):
            aggregates.setdefault(x, len(aggregates))
            return
        if isinstance(x, Column):
            if x.name.lower() not in scope.columns:
                if x.name.lower() in names:
                    return
                raise SQLError(f"no such column: {x.name}")
            if s.group and x not in inside:
                raise SQLError(f"not a GROUP BY column: {x.name}")
            bare.setdefault(x, len(bare))
        for y in x.children():
            collect(y)

    for x in exprs:
        collect(x)
    numbered = source.numbered
    first = F.col(ROW) if numbered else source.first
    aggs, known, columns = [], {}, {}
    for a, i in aggregates.items():
        col, val = _aggregate(a, scope)
        aggs.append(col.alias(f"a{i}"))
        known[a] = _after(val, F.col(f"a{i}"))
    for b, i in bare.items():
        val = scope.columns[b.name.lower()]
        aggs.append((F.min_by(c.plain(val), first) if first is not None else F.first(c.plain(val))).alias(f"b{i}"))
        columns[b.name.lower()] = _after(val, F.col(f"b{i}"))
    group_cols = []
    for i, (g, k) in enumerate(zip(s.group, keys)):
        known[g] = _after(k, F.col(f"k{i}"))
        if k.cls == DYN:  # equal values of two classes are one group, shown by its first row's
            group_cols.append(c.sort_key(k).alias(f"g{i}"))
            aggs.append((F.min_by(k.col, first) if first is not None else F.first(k.col)).alias(f"k{i}"))
        else:
            group_cols.append(c.plain(k).alias(f"k{i}"))
    if numbered:
        aggs.append(F.min(ROW).alias(ROW))
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("rows_of_group")]
    df = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    return df, Scope(columns, known)


def _aggregate(a: Aggregate, scope: Scope) -> tuple[SparkColumn, Val]:
    """The aggregate's column, and its class and bounds."""
    if a.x is None:
        return F.count(F.lit(1)), Val(F.lit(0), INT, 0, c.HIGH)
    if has_aggregate(a.x):
        raise SQLError("aggregate outside group context")
    x = c.compile_expr(a.x, scope)
    if x.cls == "OPAQUE":
        c.raise_opaque()
    if a.name == "COUNT":
        if x.cls == NULL:
            return F.count(F.when(F.lit(False), 1)), Val(F.lit(0), INT, 0, c.HIGH)
        key = c.group_key(x)
        return (F.count_distinct(key) if a.distinct else F.count(key)), Val(F.lit(0), INT, 0, c.HIGH)
    if a.name in ("MIN", "MAX"):
        if x.cls == DYN:
            return (F.min_by if a.name == "MIN" else F.max_by)(x.col, c.sort_key(x)), Val(F.lit(0), DYN)
        return (F.min if a.name == "MIN" else F.max)(c.plain(x)), Val(F.lit(0), x.cls, x.low, x.high)
    if x.cls == NULL:
        return F.max(F.lit(None).cast("double")), Val(F.lit(0), REAL)
    n = c.number(x)
    if a.name == "AVG":
        return (_distinct_reals(x, F.avg) if a.distinct else F.avg(c.real(n))), Val(F.lit(0), REAL)
    if n.cls == REAL:
        return (F.sum_distinct(n.col) if a.distinct else F.sum(n.col)), Val(F.lit(0), REAL)
    if n.cls == INT:
        if -(2**31) <= n.low and n.high < 2**31:
            whole = c.int_col(n)
            if a.distinct:  # no set of such values adds up to more than a long holds
                return F.sum_distinct(whole), Val(F.lit(0), INT)
            # upper and lower halves in a long each: enough for 2 ** 47 rows, and the sum of both may leave a long
            high, low = F.sum(F.shiftright(whole, 16)).cast("decimal(38,0)"), F.sum(whole.bitwiseAND(F.lit(65535)))
            return _sum_or_real(high * 65536 + low.cast("decimal(38,0)")), Val(F.lit(0), DYN, numeric=True)
        wide = n.col.cast("decimal(38,0)")
        return _sum_or_real(F.sum_distinct(wide) if a.distinct else F.sum(wide)), Val(F.lit(0), DYN, numeric=True)
    whole, reals = n.col["i"].cast("decimal(38,0)"), c.real(n)
    # texts add up to a REAL; so do any REALs
    kept = x.col["cls"] == 1 if x.cls == DYN else F.lit(False)
    if a.distinct:
        total = _distinct_reals(x, F.sum)
        only = F.min(F.when(n.col.isNotNull(), kept))
        return F.when(total.isNotNull(), F.when(only, c._struct(INT, total.cast("bigint"))).otherwise(c._struct(REAL, total))), Val(F.lit(0), DYN)
    only = F.min(F.when(n.col.isNotNull(), kept))
    return F.when(only, _sum_or_real(F.sum(whole))).otherwise(F.when(F.sum(reals).isNotNull(), c._struct(REAL, F.sum(reals)))), Val(F.lit(0), DYN)


def _distinct_reals(x: Val, f) -> SparkColumn:
    """An aggregate of a double over distinct values; equal values are the same double."""
    return f(c.real(x)) if x.cls == NULL else (F.sum_distinct(c.real(x)) if f is F.sum else F.try_divide(F.sum_distinct(c.real(x)), F.count_distinct(c.real(x))))


def _sum_or_real(total: SparkColumn) -> SparkColumn:
    fits = (total >= F.lit(c.LOW).cast("decimal(38,0)")) & (total <= F.lit(c.HIGH).cast("decimal(38,0)"))
    return F.when(fits, c._struct(INT, F.when(fits, total).cast("bigint"))).when(total.isNotNull(), c._struct(REAL, total.cast("double")))


def _order(order: tuple[Order, ...], names: list[str], shown: list[Val], scope: Scope, outputs: tuple[Output, ...]) -> tuple[list[SparkColumn], list[SparkColumn]]:
    """Sort columns over the projection, and what the projection has to carry for them."""
    by_name: dict[str, Val] = {}
    for name, val in zip(names, shown):
        by_name.setdefault(name.lower(), val)
    known = {o.x: val for o, val in zip(outputs, shown)}
    out, extra = [], []
    for k, o in enumerate(order):
        if o.ordinal is not None:
            if not 1 <= o.ordinal <= len(shown):
                raise SQLError(f"{_nth(k + 1)} ORDER BY term out of range - should be between 1 and {len(shown)}")
            val = shown[o.ordinal - 1]
        elif isinstance(o.x, Column) and o.x.name.lower() in by_name:
            val = by_name[o.x.name.lower()]
        elif o.x in known:
            val = known[o.x]
        else:
            # names of outputs first, then of the source
            try:
                val = c.compile_expr(o.x, Scope(by_name, known))
            except SQLError:
                own = Scope({**scope.columns}, scope.known, scope.missing, scope.aggregates)
                below = c.compile_expr(_inlined(o.x, outputs, names, own), own)
                extra.append(c.plain(below).alias(f"s{k}"))
                val = _after(below, F.col(f"s{k}"))
        if val.const or val.cls == "OPAQUE":
            continue
        col = c.group_key(val)
        out.append(col.desc() if o.descending else col.asc())
    return out, extra


def _inlined(x: Expr, outputs: tuple[Output, ...], names: list[str], scope: Scope) -> Expr:
    """An ORDER BY expression with output names replaced by what they stand for."""
    from dataclasses import fields, replace

    if isinstance(x, Column):
        for o, name in zip(outputs, names):
            if name.lower() == x.name.lower():
                return o.x
        return x
    if isinstance(x, Aggregate):
        return x
    new = {}
    for f in fields(x):  # type: ignore[arg-type]
        y = getattr(x, f.name)
        if isinstance(y, Expr):
            new[f.name] = _inlined(y, outputs, names, scope)
        elif isinstance(y, tuple):
            new[f.name] = tuple(_inlined(z, outputs, names, scope) if isinstance(z, Expr) else z for z in y)
    return replace(x, **new)  # type: ignore[type-var]


def _nth(n: int) -> str:
    return f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def _distinct(df: DataFrame, shown: list[Val], numbered: bool) -> DataFrame:
    if not numbered and all(x.cls != DYN for x in shown):
        return df.distinct()
    keys = [c.group_key(x).alias(f"d{i}") for i, x in enumerate(shown)]
    row = F.struct(*(x.col for x in shown))
    kept = F.min_by(row, F.col(ROW)) if numbered else F.first(row)
    aggs = [kept.alias("row"), *([F.min(ROW).alias(ROW)] if numbered else [])]
    return df.groupBy(*keys).agg(*aggs).select("row.*", *([F.col(ROW)] if numbered else []))


def collapse(plan: Plan, types: str) -> DataFrame:
    """The result with each column of a DYN class turned into the type asked for: I, R or T."""
    cols = []
    names = [f"c{i}" for i in range(len(plan.names))]
    df = plan.df.toDF(*names)
    for name, cls, numeric, kind in zip(names, plan.classes, plan.numeric, types):
        col = F.col(name)
        if cls == DYN:
            x = Val(col, DYN, leaf=True, numeric=numeric)
            col = {"I": lambda: c.cast(x, "INTEGER").col, "R": lambda: c.real(x), "T": lambda: c.text(x)}[kind]()
        cols.append(col)
    return df.select(*cols).toDF(*plan.names)


