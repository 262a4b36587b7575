import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.functions import values as v
from tessera.functions.evaluate import evaluate
from tessera.plans.parser import parse_expression
from tessera.sources.catalog import class_of, dyn_value, python_value

LITERALS = ["1", "0", "-3", "2.5", "'abc'", "'12'", "'12x'", "''", "NULL", "x'3132'", "1e20", "9223372036854775807", "-9223372036854775808", "' 7 '", "'A%b'", "'é'", "5.5", "'-4.0'", "'abd'"]


def expression(rng, depth, leaves):
    if not depth:
        return rng.choice(leaves)
    g = lambda: expression(rng, depth - 1, leaves)
    k = rng.random()
    if k < 0.3:
        return f"({g()} {rng.choice('+ - * /'.split())} {g()})"
    if k < 0.5:
        return f"({g()} {rng.choice('= != < <= > >='.split())} {g()})"
    if k < 0.58:
        return f"({g()} {rng.choice(['AND', 'OR'])} {g()})"
    if k < 0.64:
        return f"(NOT {g()})"
    if k < 0.7:
        return f"({g()} {rng.choice(['IS', 'IS NOT'])} {g()})"
    if k < 0.75:
        return f"({g()} {rng.choice(['', 'NOT '])}BETWEEN {g()} AND {g()})"
    if k < 0.82:
        return f"({g()} {rng.choice(['', 'NOT '])}IN ({g()}, {g()}))"
    if k < 0.97:
        return f"CAST({g()} AS {rng.choice(['INTEGER', 'REAL', 'TEXT', 'NUMERIC', 'BLOB'])})"
    return f"(- {g()})"


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    return type(a) is type(b) and a == b


def test_evaluator_against_sqlite():
    db, rng = sqlite3.connect(":memory:"), random.Random(11)
    for _ in range(4000):
        e = expression(rng, rng.randint(1, 3), LITERALS)
        assert same(db.execute("SELECT " + e).fetchone()[0], evaluate(parse_expression(e))), e


def test_patterns_against_sqlite():
    db, rng = sqlite3.connect(":memory:"), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("abAB%_!]-^é") for _ in range(rng.randint(0, 5)))
        like = "".join(rng.choice("aB%_!é") for _ in range(rng.randint(0, 5)))
        glob = "".join(rng.choice(["a", "B", "*", "?", "[ab]", "[^a]", "[a-b]", "[]]", "[^]b]", "[", "]", "-"]) for _ in range(rng.randint(0, 4)))
        assert db.execute("SELECT ? LIKE ?", (text, like)).fetchone()[0] == v.like("LIKE", text, like), (text, like)
        if not like.endswith("!"):
            assert db.execute("SELECT ? LIKE ? ESCAPE '!'", (text, like)).fetchone()[0] == v.like("LIKE", text, like, "!"), (text, like)
        assert db.execute("SELECT ? GLOB ?", (text, glob)).fetchone()[0] == v.like("GLOB", text, glob), (text, glob)


VALUES = [None, 0, 1, -7, 2**53, 2**53 + 1, 2**63 - 1, -(2**63), 0.0, 1.0, -2.5, 2.0**53, 2.0**63, -(2.0**63), 1e300, float("inf"), "", "1", "1.0", "abc", "abcd", "ABC", "12x", " 7 ", "é", b"", b"abc", b"\xff"]


def test_columns_against_the_evaluator(spark):
    """The same expressions over a column of each class and over one that mixes them."""
    rng = random.Random(3)
    rows = [(rng.choice(VALUES), rng.choice([1, -5, 2**40, None]), rng.choice([0.5, -2.0, 3.75, None]), rng.choice(["a", "12", "-3.5x", "", None]), rng.choice(VALUES[:16]), k) for k in range(120)]
    df = spark.createDataFrame([(dyn_value(d), i, r, t, dyn_value(n), k) for d, i, r, t, n, k in rows], c.T.StructType([c.T.StructField("d", c.DYN_TYPE), c.T.StructField("i", c.T.LongType()), c.T.StructField("r", c.T.DoubleType()), c.T.StructField("t", c.T.StringType()), c.T.StructField("n", c.DYN_TYPE), c.T.StructField("k", c.T.LongType())])).repartition(2).cache()
    affinity = {"d": "BLOB", "i": "INTEGER", "r": "REAL", "t": "TEXT", "n": "NUMERIC"}
    scope = c.Scope({f.name: c.column_of(f, F.col(f.name), affinity.get(f.name)) for f in df.schema.fields})
    leaves = ["d", "i", "r", "t", "n", "d", "i", "r", "t", "1", "2.5", "'12'", "NULL", "'abc'"]
    expressions = [expression(rng, rng.randint(1, 2), leaves) for _ in range(150)]
    expressions += [f"({a} {op} {b})" for a in ("d", "t", "i") for op in ("LIKE", "GLOB") for b in ("'%1%'", "'[a-c]*'", "t")] + ["d", "i % 3", "d % 4", "r % 2", "- i", "i * i", "i + 9223372036854775807", "CAST(r AS TEXT)", "d IN ()", "t NOT IN ()"]
    # a blob's bytes that are no UTF-8 become other text in a column than in Python
    parsed = [parse_expression(e) for e in expressions]
    for low in range(0, len(parsed), 40):
        some = parsed[low : low + 40]
        vals = [c.compile_expr(x, scope) for x in some]
        got = {r["k"]: r for r in df.select("k", *(c.plain(x).alias(f"x{j}") for j, x in enumerate(vals))).collect()}
        for d, i, r, t, n, k in rows:
            if d == b"\xff":
                continue
            row = {name: (value, affinity[name]) for name, value in zip("dirtn", (d, i, r, t, n))}
            for j, x in enumerate(some):
                want, have = evaluate(x, row), python_value(got[k][f"x{j}"])
                assert same(want, have), (expressions[low + j], row, want, have)


def test_sort_key_orders_and_groups(spark):
    rng = random.Random(7)
    values = [x for x in VALUES if x is not None] + [rng.randint(-(2**63), 2**63 - 1) for _ in range(60)] + [float(rng.randint(2**52, 2**54)) for _ in range(20)] + [rng.randint(2**52, 2**54) for _ in range(20)]
    df = spark.createDataFrame([(k, dyn_value(x)) for k, x in enumerate(values)], c.T.StructType([c.T.StructField("k", c.T.LongType()), c.T.StructField("d", c.DYN_TYPE)]))
    key = c.sort_key(c.Val(F.col("d"), c.DYN))
    got = [values[r.k] for r in df.orderBy(key).collect()]
    assert all(v.compare(a, b) <= 0 for a, b in zip(got, got[1:]))
    groups = 1 + sum(v.compare(a, b) != 0 for a, b in zip(got, got[1:]))
    assert df.groupBy(key).count().count() == groups


@pytest.mark.parametrize("name, aff", [("VARCHAR", "TEXT"), ("BIGINT", "INTEGER"), ("CHARINT", "INTEGER"), ("FLOAT", "REAL"), ("DECIMAL", "NUMERIC"), ("DATE", "NUMERIC"), ("BOOLEAN", "NUMERIC"), ("STRING", "NUMERIC"), ("CLOB", "TEXT"), ("BLOB", "BLOB"), ("DOUBLE", "REAL"), ("POINT", "INTEGER")])
def test_affinity(name, aff):
    assert v.affinity(name) == aff


@pytest.mark.parametrize("value, text", [(1e15, "1.0e+15"), (1e-5, "1.0e-05"), (0.1 + 0.2, "0.3"), (-0.0, "0.0"), (1.0, "1.0"), (float("inf"), "Inf"), (float("-inf"), "-Inf"), (float("nan"), ""), (123456.789, "123456.789")])
def test_real_text(value, text):
    assert v.real_text(value) == text


def test_render():
    assert [v.render_slt(x, k) for x, k in ((None, "I"), (1.9, "I"), ("12x", "I"), (1, "R"), ("abc", "R"), ("", "T"), ("a\tb", "T"), ("é", "T"), (1.5, "T"))] == ["NULL", "1", "12", "1.000", "0.000", "(empty)", "a@b", "@@", "1.5"]
    assert class_of(1.0) == "REAL"
