"""Queries for the rest of the dialect's surface: its API, constraints, transactions, tools and messages.

What a statement gives is said in one line of text: for a SELECT its rows, for
any other one the number of rows it affects, else the error. The oracle lists what
each statement has to say.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .errors import SQLError, UnsupportedError
from .functions.values import affinity, render, render_slt
from .plans.lexer import split_statements, tokenize
from .plans.nodes import has_aggregate
from .plans.parser import parse, parse_expression
from .slt import Options, parse_file, run_file
from .slt.runner import hash_of, shown
from .sources.store import Store
from .streaming import write_stream

Query = Callable[[SparkSession, str], DataFrame]


def _cell(x: object) -> str:
    return "NULL" if x is None else repr(x) if not isinstance(x, str) else x


def _said(conn, sql: str) -> str:
    try:
        out = conn.execute(sql)
        return str(out.affected) if out.plan is None else "; ".join(", ".join(map(_cell, r)) for r in out.rows)
    except UnsupportedError as e:
        return f"unsupported: {e.feature}"
    except SQLError as e:
        return f"error: {e}"


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "n long, said string")


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(lines: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'(CAST({n} AS BIGINT), {_text(x)})' for n, x in enumerate(lines))}) t(n, said)"


_T = [("CREATE TABLE t (a INTEGER, b TEXT)", "0"), ("INSERT INTO t VALUES (1, 'x')", "1"), ("INSERT INTO t VALUES (2, 'y')", "1")]

#: Statements of one store, each with what it says. "2: " before a statement: on a second connection.
STATEMENTS: dict[str, list[tuple[str, str]]] = {
    # sources, projection
    "where_needs_from": [("SELECT 1 WHERE 1", "error: syntax error near WHERE"), ("SELECT 1", "1")],
    "values_source": [*_T, ("INSERT INTO t VALUES (NULL, 7)", "1"), ("INSERT INTO t VALUES (DEFAULT, X'41')", "1"), ("SELECT a, b FROM t", "1, x; 2, y; NULL, 7; NULL, b'A'")],
    "insertion_order": [*_T, ("INSERT INTO t VALUES (0, 'z')", "1"), ("SELECT a FROM t", "1; 2; 0"), ("SELECT a FROM t WHERE a < 2", "1; 0"), ("SELECT b FROM t LIMIT 1 OFFSET 2", "z"), ("UPDATE t SET a = 9 WHERE a = 1", "1"), ("SELECT a FROM t", "9; 2; 0")],
    # aggregation
    "bare_column_check": [*_T, ("SELECT b FROM t GROUP BY a", "error: not a GROUP BY column: b"), ("SELECT a, b FROM t GROUP BY a, b", "1, x; 2, y"), ("SELECT a, b, COUNT(*) FROM t GROUP BY a + b", "1, x, 1; 2, y, 1")],
    "aggregate_nested": [*_T, ("SELECT SUM(COUNT(*)) FROM t", "error: aggregate outside group context"), ("SELECT MAX(a + MIN(a)) FROM t", "error: aggregate outside group context"), ("SELECT MAX(a) + MIN(a) FROM t", "3")],
    "aggregate_misuse": [*_T, ("SELECT SUM(*) FROM t", "error: misuse of aggregate SUM(*)"), ("SELECT AVG(*) FROM t", "error: misuse of aggregate AVG(*)"), ("SELECT MIN(a, b) FROM t", "error: syntax error near ,"), ("SELECT COUNT(*) FROM t", "2")],
    "sum_past_64_bits": [("CREATE TABLE w (a INTEGER)", "0"), ("INSERT INTO w VALUES (9223372036854775807)", "1"), ("SELECT SUM(a) FROM w", "9223372036854775807"), ("INSERT INTO w VALUES (1)", "1"), ("SELECT SUM(a) FROM w", "9.223372036854776e+18"), ("SELECT SUM(a) - 1 FROM w WHERE a > 1", "9223372036854775806")],
    # order
    "order_classes": [("CREATE TABLE m (x BLOB)", "0"), *((f"INSERT INTO m VALUES ({x})", "1") for x in ("'b'", "2", "X'00'", "NULL", "1.5", "'a'", "10")), ("SELECT x FROM m ORDER BY x", "NULL; 1.5; 2; 10; a; b; b'\\x00'"), ("SELECT x FROM m ORDER BY x DESC", "b'\\x00'; b; a; 10; 2; 1.5; NULL"), ("SELECT MIN(x), MAX(x), COUNT(DISTINCT x) FROM m", "1.5, b'\\x00', 6")],
    "order_stable": [("CREATE TABLE s (k INTEGER, v TEXT)", "0"), *((f"INSERT INTO s VALUES ({k}, '{v}')", "1") for k, v in ((2, "d"), (1, "c"), (2, "a"), (1, "b"))), ("SELECT v FROM s ORDER BY k", "c; b; d; a"), ("SELECT v FROM s ORDER BY k DESC", "d; a; c; b"), ("SELECT DISTINCT k FROM s", "2; 1"), ("SELECT k, COUNT(*) FROM s GROUP BY k", "2, 2; 1, 2")],
    "offset_alone": [*_T, ("SELECT a FROM t OFFSET 1", "error: OFFSET requires a LIMIT clause"), ("SELECT a FROM t LIMIT 5 OFFSET 1", "2")],
    "distinct_classes": [("CREATE TABLE m (x BLOB)", "0"), *((f"INSERT INTO m VALUES ({x})", "1") for x in ("1", "1.0", "'1'", "NULL", "NULL", "X'31'")), ("SELECT DISTINCT x FROM m", "1; 1; NULL; b'1'"), ("SELECT x, COUNT(*) FROM m GROUP BY x", "1, 2; 1, 1; NULL, 2; b'1', 1")],
    # expressions
    "least_integer": [("SELECT -9223372036854775808", "-9223372036854775808"), ("SELECT 9223372036854775808", "9.223372036854776e+18"), ("SELECT -9223372036854775808 - 1", "-9.223372036854776e+18"), ("SELECT 9223372036854775807 + 1", "9.223372036854776e+18"), ("SELECT 9223372036854775807", "9223372036854775807")],
    "arith_text_numbers": [("SELECT '12' + 1, '12abc' + 1, 'abc' + 1, '1.5' * 2, '-3e1x' + 0, ' 7' - 1, X'3132' + 0", "13, 13, 1, 3.0, -30.0, 6, 12")],
    "cast_null": [("SELECT CAST(NULL AS INTEGER), CAST(NULL AS REAL), CAST(NULL AS TEXT), CAST(NULL AS BLOB), CAST(NULL AS NUMERIC)", "NULL, NULL, NULL, NULL, NULL")],
    "cast_text_numbers": [("SELECT CAST('12abc' AS INTEGER), CAST('-7.9' AS INTEGER), CAST('x' AS INTEGER), CAST('99999999999999999999' AS INTEGER)", "12, -7, 0, 9223372036854775807"), ("SELECT CAST('1.5e2x' AS REAL), CAST('.5' AS REAL), CAST('' AS REAL)", "150.0, 0.5, 0.0"), ("SELECT CAST('1.0' AS NUMERIC), CAST('1.5' AS NUMERIC), CAST('7' AS NUMERIC), CAST('z' AS NUMERIC)", "1, 1.5, 7, 0"), ("SELECT CAST(1e300 AS INTEGER), CAST(-1.9 AS INTEGER), CAST(2 AS BLOB)", "9223372036854775807, -1, b'2'")],
    # changes
    "constraint_not_null": [("CREATE TABLE n (a INTEGER NOT NULL, b TEXT)", "0"), ("INSERT INTO n (b) VALUES ('x')", "error: NOT NULL constraint failed: n.a"), ("INSERT INTO n VALUES (1, NULL)", "1"), ("UPDATE n SET a = NULL", "error: NOT NULL constraint failed: n.a"), ("SELECT a, b FROM n", "1, NULL")],
    "constraint_check": [("CREATE TABLE k (a INTEGER CHECK (a > 0))", "0"), ("INSERT INTO k VALUES (0)", "error: CHECK constraint failed: k"), ("INSERT INTO k VALUES (NULL)", "1"), ("INSERT INTO k VALUES (5)", "1"), ("UPDATE k SET a = a - 5", "error: CHECK constraint failed: k"), ("SELECT a FROM k", "NULL; 5")],
    "constraint_unique": [("CREATE TABLE u (id INTEGER PRIMARY KEY, v TEXT UNIQUE)", "0"), ("INSERT INTO u VALUES (1, 'a')", "1"), ("INSERT INTO u VALUES (1, 'b')", "error: UNIQUE constraint failed: u.id"), ("INSERT INTO u VALUES (2, 'a')", "error: UNIQUE constraint failed: u.v"), ("INSERT INTO u VALUES (NULL, NULL)", "1"), ("INSERT INTO u VALUES (NULL, NULL)", "1"), ("SELECT COUNT(*) FROM u", "3")],
    "constraint_composite": [("CREATE TABLE c (a INTEGER, b INTEGER, PRIMARY KEY (a, b))", "0"), ("INSERT INTO c VALUES (1, 2)", "1"), ("INSERT INTO c VALUES (1, 3)", "1"), ("INSERT INTO c VALUES (1, 2)", "error: UNIQUE constraint failed: c.a, c.b"), ("INSERT INTO c VALUES (1, NULL)", "1"), ("INSERT INTO c VALUES (1, NULL)", "1")],
    "constraint_unique_index": [("CREATE TABLE x (a INTEGER, b INTEGER)", "0"), ("CREATE UNIQUE INDEX ix ON x (a, b DESC)", "0"), ("INSERT INTO x VALUES (1, 2)", "1"), ("INSERT INTO x VALUES (1, 2)", "error: UNIQUE constraint failed: x.ix"), ("INSERT INTO x VALUES (2, 2)", "1"), ("CREATE UNIQUE INDEX iy ON x (b)", "error: UNIQUE constraint failed: x.b")],
    "constraint_of_table": [("CREATE TABLE o (a INTEGER, b INTEGER, UNIQUE (b), UNIQUE (a, b))", "0"), ("INSERT INTO o VALUES (1, 1)", "1"), ("INSERT INTO o VALUES (2, 1)", "error: UNIQUE constraint failed: o.b"), ("SELECT sql FROM sqlite_master", "CREATE TABLE o (a INTEGER, b INTEGER, UNIQUE (b), UNIQUE (a, b))")],
    "insert_arity": [*_T, ("INSERT INTO t VALUES (1)", "error: table t has 2 columns but 1 values were supplied"), ("INSERT INTO t (a) VALUES (1, 2)", "error: INSERT has more expressions than target columns"), ("INSERT INTO t (c) VALUES (1)", "error: no such column: c"), ("SELECT COUNT(*) FROM t", "2")],
    "insert_select": [*_T, ("INSERT INTO t SELECT 1, 2", "unsupported: INSERT ... SELECT"), ("INSERT INTO t (a) SELECT a FROM t", "unsupported: INSERT ... SELECT")],
    "affected_rows": [*_T, ("UPDATE t SET a = a + 1 WHERE a > 1", "1"), ("UPDATE t SET b = 'z'", "2"), ("DELETE FROM t WHERE a > 5", "0"), ("DELETE FROM t", "2")],
    # definitions
    "create_table_twice": [*_T, ("CREATE TABLE t (c TEXT)", 'error: table "t" already exists'), ("CREATE TABLE T (c TEXT)", "0")],
    "drop_index": [*_T, ("CREATE INDEX i ON t (a)", "0"), ("CREATE INDEX i ON t (b)", 'error: index "i" already exists'), ("DROP INDEX i", "0"), ("DROP INDEX i", "error: no such index: i"), ("SELECT name FROM sqlite_master", "t")],
    "drop_table": [*_T, ("CREATE INDEX i ON t (a)", "0"), ("DROP TABLE t", "0"), ("SELECT COUNT(*) FROM sqlite_master", "0"), ("SELECT a FROM t", "error: no such table: t"), ("DROP TABLE t", "error: no such table: t")],
    "ddl_text": [("CREATE TABLE d (a integer primary key, b varchar(9) not null default 'it''s', c real default (1 + 2) check (c > 0), e blob default x'0a')", "0"), ("CREATE UNIQUE INDEX i ON d (b desc, c)", "0"), ("SELECT sql FROM sqlite_master", "CREATE UNIQUE INDEX i ON d (b DESC, c); CREATE TABLE d (a INTEGER PRIMARY KEY, b VARCHAR NOT NULL DEFAULT 'it''s', c REAL DEFAULT ((1 + 2)) CHECK ((c > 0)), e BLOB DEFAULT X'0A')")],
    "alter_errors": [*_T, ("ALTER TABLE t ADD COLUMN c INTEGER NOT NULL", "error: Cannot add a NOT NULL column with default value NULL"), ("ALTER TABLE t ADD COLUMN c INTEGER PRIMARY KEY", "error: Cannot add a PRIMARY KEY column"), ("ALTER TABLE t ADD COLUMN c INTEGER UNIQUE", "error: Cannot add a UNIQUE column"), ("ALTER TABLE t ADD COLUMN c INTEGER NOT NULL DEFAULT 4", "0"), ("SELECT * FROM t", "1, x, 4; 2, y, 4"), ("ALTER TABLE q RENAME TO z", "error: no such table: q")],
    "views": [("CREATE VIEW v AS SELECT 1", "unsupported: CREATE VIEW"), ("DROP VIEW v", "unsupported: DROP VIEW"), ("VIEW", "unsupported: VIEW")],
    # transactions
    "connections": [*_T, ("2: SELECT COUNT(*) FROM t", "2"), ("2: INSERT INTO t VALUES (3, 'z')", "1"), ("SELECT COUNT(*) FROM t", "3")],
    "tx_statement_atomicity": [("CREATE TABLE u (a INTEGER UNIQUE)", "0"), ("INSERT INTO u VALUES (1)", "1"), ("INSERT INTO u VALUES (2)", "1"), ("UPDATE u SET a = 5", "error: UNIQUE constraint failed: u.a"), ("SELECT a FROM u", "1; 2"), ("BEGIN", "0"), ("UPDATE u SET a = a + 10", "2"), ("UPDATE u SET a = 0", "error: UNIQUE constraint failed: u.a"), ("COMMIT", "0"), ("SELECT a FROM u", "11; 12")],
    "tx_snapshot": [*_T, ("BEGIN", "0"), ("DELETE FROM t", "2"), ("2: SELECT COUNT(*) FROM t", "2"), ("SELECT COUNT(*) FROM t", "0"), ("COMMIT", "0"), ("2: SELECT COUNT(*) FROM t", "0")],
    "tx_write_lock": [*_T, ("BEGIN", "0"), ("INSERT INTO t VALUES (3, 'z')", "1"), ("2: DELETE FROM t", "error: database is locked"), ("2: SELECT COUNT(*) FROM t", "2"), ("ROLLBACK", "0"), ("2: DELETE FROM t", "2")],
    "tx_errors": [("COMMIT", "error: cannot commit - no transaction is active"), ("ROLLBACK", "0"), ("BEGIN", "0"), ("BEGIN", "error: cannot start a transaction within a transaction"), ("COMMIT", "0"), ("BEGIN TRANSACTION", "error: syntax error near TRANSACTION")],
    # what the dialect leaves out
    "no_comma_join": [("SELECT a FROM t, u", "unsupported: JOIN")],
    "no_join": [("SELECT a FROM t JOIN u", "unsupported: JOIN")],
    "no_join_kinds": [(f"SELECT a FROM t {x} JOIN u", "unsupported: JOIN") for x in ("INNER", "LEFT", "LEFT OUTER", "RIGHT", "FULL", "CROSS")],
    "no_natural_join": [("SELECT a FROM t NATURAL JOIN u", "error: syntax error near NATURAL"), ("SELECT a FROM t x JOIN u", "error: syntax error near x")],
    "no_set_operations": [(f"SELECT 1 {x} SELECT 2", "unsupported: UNION") for x in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT")],
    "no_case": [("SELECT CASE WHEN 1 THEN 2 END", "unsupported: CASE expression"), ("SELECT CASE 1 WHEN 1 THEN 2 ELSE 3 END", "unsupported: CASE expression")],
    "no_exists": [*_T, ("SELECT a FROM t WHERE EXISTS (SELECT 1)", "unsupported: EXISTS subquery")],
    "no_scalar_subquery": [("SELECT (SELECT 1)", "unsupported: subquery"), ("SELECT 1 + (SELECT 1)", "unsupported: subquery")],
    "no_from_subquery": [("SELECT a FROM (SELECT 1)", "error: expected identifier, got ("), ("SELECT a FROM f(1)", "unsupported: subquery in FROM")],
    "no_in_select": [*_T, ("SELECT a FROM t WHERE a IN (SELECT 1)", "error: expected a value, got SELECT")],
    "no_qualified_names": [*_T, ("SELECT t.a FROM t", "unsupported: qualified column reference"), ("SELECT a FROM s.t", "unsupported: qualified column reference")],
    "no_table_alias": [*_T, ("SELECT a FROM t AS x", "error: syntax error near AS"), ("SELECT a FROM t x", "error: syntax error near x")],
    "no_functions": [(f"SELECT {x} FROM t", "unsupported: function call") for x in ("abs(a)", "coalesce(a, b)", "length(b)", "upper(b)", "date('now')", "json_extract(b, 'x')", "group_concat(a)", "total(a)")],
    "no_windows": [*_T, ("SELECT COUNT(*) OVER () FROM t", "error: syntax error near ("), ("SELECT row_number() OVER (ORDER BY a) FROM t", "unsupported: function call")],
    "no_grouping_sets": [*_T, ("SELECT a FROM t GROUP BY ROLLUP(a)", "unsupported: function call"), ("SELECT a FROM t GROUP BY CUBE(a, b)", "unsupported: function call")],
    "no_user_functions": [*_T, ("SELECT mine(a) FROM t", "unsupported: function call")],
    "no_with": [("WITH x AS (SELECT 1) SELECT 1", "error: syntax error near WITH"), ("EXPLAIN SELECT 1", "error: syntax error near EXPLAIN"), ("REPLACE INTO t VALUES (1)", "error: syntax error near REPLACE")],
    "no_admin": [(f"{x} y", f"unsupported: {x}") for x in ("PRAGMA", "VACUUM", "ATTACH", "DETACH", "REINDEX", "ANALYZE")],
    "no_other_signs": [("SELECT 'a' || 'b'", "error: unexpected character '|' at position 11"), ("SELECT 1 & 2", "error: unexpected character '&' at position 9"), ('SELECT "a"', "error: unexpected character '\"' at position 7"), ("SELECT ?", "error: unexpected character '?' at position 7")],
    "no_collate": [*_T, ("SELECT a FROM t ORDER BY b COLLATE NOCASE", "error: syntax error near COLLATE"), ("SELECT a FROM t ORDER BY a NULLS FIRST", "error: syntax error near NULLS"), ("SELECT a IS DISTINCT FROM b FROM t", "error: expected a value, got DISTINCT"), ("SELECT a ISNULL FROM t", "1; 2")],
    # messages
    "errors_lexical": [("SELECT 'abc", "error: unterminated string literal"), ("SELECT X'12", "error: unterminated blob literal"), ("SELECT x'1'", "error: malformed blob literal"), ("SELECT X'0g'", "error: malformed blob literal"), ("SELECT #", "error: unexpected character '#' at position 7")],
    "errors_syntax": [("", "error: empty statement"), ("SELEC 1", "error: syntax error near SELEC"), ("SELECT 1 FROM", "error: expected identifier, got end of input"), ("SELECT (1", "error: expected ), got end of input"), ("SELECT , 1", "error: expected a value, got ,")],
    "errors_numbers": [("INSERT INTO t VALUES (9223372036854775808)", "error: invalid integer 9223372036854775808"), ("SELECT 1e999", "error: invalid number 1e999")],
    "errors_statements": [("INSERT t VALUES (1)", "error: expected INTO after INSERT"), ("UPDATE t a = 1", "error: expected SET in UPDATE"), ("UPDATE t SET a > 1", "error: expected = in SET clause"), ("DELETE t", "error: expected FROM after DELETE")],
    "errors_definitions": [("CREATE t", "error: expected TABLE after CREATE"), ("ALTER t", "error: expected TABLE after ALTER"), ("DROP t", "error: expected TABLE after DROP"), ("CREATE UNIQUE TABLE t (a INT)", "error: expected INDEX"), ("CREATE INDEX i t (a)", "error: expected ON after index name"), ("ALTER TABLE t DROP a", "error: expected RENAME or ADD"), ("ALTER TABLE t RENAME a", "error: expected TO after RENAME"), ("ALTER TABLE t ADD a INT", "error: expected COLUMN after ADD")],
    "errors_clauses": [("SELECT a FROM t GROUP a", "error: expected BY after GROUP"), ("SELECT a FROM t ORDER a", "error: expected BY after ORDER"), ("SELECT 1 BETWEEN 1 OR 2", "error: expected AND in BETWEEN"), ("SELECT CAST(1 INTEGER)", "error: expected AS in CAST"), ("SELECT SUM a FROM t", "error: expected ( after SUM"), ("SELECT CAST(1 AS VARCHAR(x))", "error: expected size in CAST type"), ("CREATE TABLE t (a VARCHAR(x))", "error: expected size in type declaration")],
    "errors_names": [*_T, ("SELECT a FROM q", "error: no such table: q"), ("SELECT c FROM t", "error: no such column: c"), ("DELETE FROM t WHERE c = 1", "error: no such column: c"), ("UPDATE t SET c = 1", "error: no such column: c"), ("DROP INDEX i", "error: no such index: i")],
    "errors_exists": [*_T, ("CREATE TABLE t (a INT)", 'error: table "t" already exists'), ("CREATE INDEX i ON t (a)", "0"), ("CREATE INDEX i ON t (a)", 'error: index "i" already exists')],
    "errors_grouping": [*_T, ("SELECT a FROM t HAVING a > 1", "error: HAVING clause on a non-aggregate query"), ("SELECT b FROM t GROUP BY a", "error: not a GROUP BY column: b"), ("SELECT MAX(*) FROM t", "error: misuse of aggregate MAX(*)"), ("SELECT SUM(MAX(a)) FROM t", "error: aggregate outside group context")],
    "errors_select": [*_T, ("SELECT *", "error: SELECT * requires a FROM clause"), ("SELECT a FROM t OFFSET 1", "error: OFFSET requires a LIMIT clause"), ("SELECT a, b FROM t ORDER BY 3", "error: 1st ORDER BY term out of range - should be between 1 and 2"), ("SELECT a, b FROM t ORDER BY 1, 9", "error: 2nd ORDER BY term out of range - should be between 1 and 2")],
    "errors_escape": [*_T, ("SELECT b LIKE 'x' ESCAPE 'ab' FROM t", "error: ESCAPE expression must be a single character"), ("SELECT b LIKE '%!%' ESCAPE '!' FROM t", "0; 0")],
    # smaller parts
    "keywords_any_case": [("cReAtE tAbLe Cased (Abc integer)", "0"), ("iNsErT iNtO Cased VALUES (1)", "1"), ("sElEcT aBC fRoM Cased wHeRe ABC iS nOt NuLl", "1"), ("SELECT abc FROM cased", "error: no such table: cased"), ("SELECT a_1 FROM Cased", "error: no such column: a_1")],
    "like_operands": [("SELECT 'ÄB' LIKE 'äb', 'AB' LIKE 'ab', 'AB' GLOB 'ab', 12 LIKE '1%', 1.5 LIKE '1._', NULL LIKE '%', X'6162' LIKE 'AB'", "0, 1, 0, 1, 1, NULL, 1")],
    "real_text": [("SELECT CAST(1e15 AS TEXT), CAST(123456789012345.0 AS TEXT), CAST(0.1 AS TEXT), CAST(1e-5 AS TEXT), CAST(100.25 AS TEXT), CAST(-0.0 AS TEXT), CAST(1.0/3 AS TEXT)", "1.0e+15, 123456789012345.0, 0.1, 1.0e-05, 100.25, 0.0, 0.333333333333333")],
}


def _run_statements(statements: list[tuple[str, str]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark)
        second = store.connect()
        return _lines(spark, [_said(second, s[3:]) if s.startswith("2: ") else _said(store, s) for s, _ in statements])

    return run


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{Store(spark).folder.uri}-durable-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the API


def new_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = Store(spark), Store(spark)
    return _lines(spark, [_said(a, "CREATE TABLE t (a INTEGER)"), _said(a, "SELECT COUNT(*) FROM t"), _said(b, "SELECT COUNT(*) FROM t")])


def durable_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store = Store.open(spark, path)
    store.import_table("orders", _table(spark, sf_dir, "orders"))
    for s in ("UPDATE orders SET o_orderstatus = 'X' WHERE o_totalprice > 200000", "DELETE FROM orders WHERE o_orderstatus = 'P'", "BEGIN", "DELETE FROM orders", "ROLLBACK"):
        store.execute(s)
    return Store.open(spark, path).sql("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")


def durable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, said = _folder(spark), []
    for s in ("CREATE TABLE t (a INTEGER UNIQUE, b TEXT DEFAULT 'd' CHECK (b <> ''))", "INSERT INTO t (a) VALUES (1)", "INSERT INTO t VALUES (1, 'x')", "INSERT INTO t VALUES (2, '')", "BEGIN", "INSERT INTO t VALUES (3, 'lost')", "SELECT a, b FROM t", "INSERT INTO t VALUES (2, 'y')", "CREATE INDEX i ON t (b)", "SELECT name, sql FROM sqlite_master"):
        if s != "BEGIN" and said[-1:] != ["open"]:
            store = Store.open(spark, path)  # each statement sees what the ones before have left in the folder
        if s == "BEGIN":
            store.execute(s)
            said.append("open")
            continue
        said.append(_said(store, s))
    return _lines(spark, said)


def value_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store = Store.open(spark, path)
    store.execute("CREATE TABLE t (x BLOB)")
    store.load("t", [(x,) for x in (None, 0, -(2**63), 2**63 - 1, 0.1, 1e300, -0.0, "é\n'", "", b"\x00\xff", b"")])
    return _lines(spark, [f"{type(x).__name__} {x!r}" for (x,) in Store.open(spark, path).execute("SELECT x FROM t").rows])


def connection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.register_parquet("nation", f"{sf_dir}/nation.parquet")
    return store.connect().execute("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey").df


def result_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    insert, select = store.execute("INSERT INTO t VALUES (1, 'x')"), store.execute("SELECT a AS k, b FROM t")
    return _lines(spark, [str(insert.affected), str(insert.rows), ",".join(select.columns), str(select.rows), ",".join(select.df.columns)])


def values_in_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = Store(spark).execute("SELECT 1, 1.5, 't', X'00FF', NULL, 1 = 1").rows[0]
    return _lines(spark, [f"{type(x).__name__} {x!r}" for x in row])


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = []
    for s in ("SELECT", "SELECT a FROM t JOIN u"):
        try:
            Store(spark).execute(s)
        except (SQLError, UnsupportedError) as e:
            said.append(f"{type(e).__name__}: {e}")
    return _lines(spark, said)


def default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.register_parquet("part", f"{sf_dir}/part.parquet")
    return _lines(spark, store.execute("SELECT 1, 'x', 1.50, NULL, COUNT(*), SUM(p_size), p_Size, p_size + 1, p_name AS n, p_brand m FROM part").columns)


def bare_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.register_parquet("customer", f"{sf_dir}/customer.parquet")
    return store.sql("SELECT c_custkey, c_name, COUNT(*) AS n FROM customer")


def ordered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the first rows of an order: what a comparison of sets of rows cannot see."""
    store = Store(spark)
    store.register_parquet("customer", f"{sf_dir}/customer.parquet")
    rows = store.execute("SELECT c_custkey FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey LIMIT 100").rows
    return spark.createDataFrame([(i, k) for i, (k,) in enumerate(rows)], "n long, c_custkey long")


def stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table of more rows than memory holds comes in the order of its rows."""
    store = Store(spark)
    store.execute("CREATE TABLE t (a INTEGER)")
    store.load("t", [((i * 7919) % 12_007,) for i in range(12_007)])
    got = [a for (a,) in store.execute("SELECT a FROM t WHERE a > 100").rows]
    return _lines(spark, [str(got == [x for i in range(12_007) if (x := (i * 7919) % 12_007) > 100]), str(len(got))])


def pattern_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    parts = _table(spark, sf_dir, "part")
    store.register("part", parts.select("p_partkey", "p_brand", F.concat(F.lit("%#"), (F.col("p_size") % 5).cast("string"), F.lit("_")).alias("p_like"), F.concat(F.lit("*#"), (F.col("p_size") % 5).cast("string"), F.lit("?")).alias("p_glob")))
    return store.sql("SELECT p_partkey, p_brand LIKE p_like AS l, p_brand GLOB p_glob AS g FROM part")


# tools

_SCRIPT = "CREATE TABLE t (a INTEGER, b TEXT); -- a ; comment\nINSERT INTO t VALUES (1, 'x;y'); INSERT INTO t VALUES (NULL, 'z');\nSELECT a, b FROM t; SELECT 1e15, X'41';"
_RECORDS = """statement ok
CREATE TABLE t (a INTEGER, b TEXT)

statement ok
INSERT INTO t VALUES (2, 'y')

statement ok
INSERT INTO t VALUES (1, 'x')

query IT rowsort
SELECT a, b FROM t
----
1
x
2
y

query I nosort
SELECT a FROM t
----
1
2

statement error
SELECT c FROM t

query I nosort
SELECT abs(a) FROM t
----
1

onlyif otherdb
query I nosort
SELECT 1
----
5

halt

statement ok
SELECT nothing FROM nowhere
"""


def cli_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, split_statements(_SCRIPT))


def cli_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    cli.run(Store(spark), _SCRIPT, out)
    return _lines(spark, out.getvalue().split("\n")[:-1])


def cli_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, [render(x) for x in (None, 1, -5, 1.0, 1e15, 1e-5, 0.1, 123456.789, "t", b"A")])


def slt_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, [render_slt(x, k) for x, k in ((None, "I"), (1.9, "I"), ("7x", "I"), (2, "R"), (1.23456, "R"), ("abc", "R"), ("", "T"), ("é\n", "T"), (1.0, "T"), (b"\x00B", "T"))])


def _records() -> Path:
    path = Path(tempfile.mkdtemp(prefix="tessera-slt-")) / "records.test"  # read by the driver only
    path.write_text(_RECORDS)
    return path


def slt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, [f"{r.kind} {r.line} {r.types} {r.sort} {r.expects_error} {len(r.expected)}" for r in parse_file(_records())])


def slt_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _records()
    return _lines(spark, [f"{s.passed} {s.failed} {s.waived} {s.total} {[f.line for f in s.failures]}" for s in (run_file(spark, path), run_file(spark, path, Options(strict=True)))])


def slt_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(2, "b"), (10, "a"), (1, "c")]
    return _lines(spark, [" ".join(shown(rows, "IT", how)) for how in ("nosort", "rowsort", "valuesort")])


def slt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.register_parquet("nation", f"{sf_dir}/nation.parquet")
    rows = store.execute("SELECT n_nationkey FROM nation ORDER BY 1").rows
    return _lines(spark, [hash_of(shown(rows, "I", "nosort"))])


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, [f"{t.kind} {t.text}" for t in tokenize("SELECT a_1, 'it''s' <= 1.5e3 -- c\n!= x'0A' /* d */ == .5;")])


def affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, [f"{t} {affinity(t)}" for t in ("INTEGER", "TINYINT", "VARCHAR", "CLOB", "TEXT", "BLOB", "REAL", "DOUBLE", "FLOAT", "NUMERIC", "DECIMAL", "DATE", "CHARINT")])


def stored_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.execute("CREATE TABLE t (i INTEGER, r REAL, t TEXT, n NUMERIC, b BLOB)")
    for x in ("'12'", "'1.0'", "'1.5'", "'12x'", "3", "2.0", "2.5", "X'31'"):
        store.execute(f"INSERT INTO t VALUES ({x}, {x}, {x}, {x}, {x})")
    return _lines(spark, [" ".join(map(repr, r)) for r in store.execute("SELECT * FROM t").rows])


def finds_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, [str(has_aggregate(parse_expression(x))) for x in ("a + 1", "1 + COUNT(*)", "a IN (1, MAX(b))", "CAST(SUM(a) AS TEXT) LIKE 'x'", "NOT a BETWEEN 1 AND 2")])


def reparsed_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.printer import table_text

    once = table_text(parse("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT DEFAULT 'x' CHECK (b LIKE 'a%' ESCAPE '!'), c REAL NOT NULL DEFAULT ((-1.5) + 2), UNIQUE (a, b))"))
    return _lines(spark, [once, str(table_text(parse(once)) == once)])


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialect over a stream: read as files come, written as Parquet."""
    events = _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a pattern, not a file
    out = _folder(spark)
    q = write_stream(spark, "SELECT event_id, user_id, value * 2 AS twice FROM events WHERE value > 50", events=stream).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


#: Each with its oracle: lines that it says, or SQL.
CALLS: dict[str, tuple[Query, list[str] | str]] = {
    "new_store": (new_store, ["0", "0", "error: no such table: t"]),
    "durable_store": (durable_store, "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 200000 OR o_orderstatus <> 'P'"),
    "durable_commits": (durable_commits, ["0", "1", "error: UNIQUE constraint failed: t.a", "error: CHECK constraint failed: t", "open", "1", "1, d", "1", "0", "i, CREATE INDEX i ON t (b); t, CREATE TABLE t (a INTEGER UNIQUE, b TEXT DEFAULT 'd' CHECK ((b != '')))"]),
    "value_codec": (value_codec, ["NoneType None", "int 0", "int -9223372036854775808", "int 9223372036854775807", "float 0.1", "float 1e+300", "float -0.0", "str \"é\\n'\"", "str ''", "bytes b'\\x00\\xff'", "bytes b''"]),
    "connection_runs": (connection_runs, "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM nation GROUP BY 1"),
    "result_parts": (result_parts, ["1", "[]", "k,b", "[(1, 'x')]", "k,b"]),
    "values_in_python": (values_in_python, ["int 1", "float 1.5", "str 't'", "bytes b'\\x00\\xff'", "NoneType None", "int 1"]),
    "error_kinds": (error_kinds, ["SQLError: expected a value, got end of input", "UnsupportedError: unsupported SQL construct: JOIN"]),
    "default_names": (default_names, ["1", "x", "1.5", "NULL", "COUNT(*)", "SUM(expr)", "p_Size", "expr", "n", "m"]),
    "bare_column": (bare_column, "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS n FROM customer LIMIT 1"),
    "ordered_positions": (ordered_positions, "SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal, c_custkey) - 1 AS n, c_custkey FROM customer QUALIFY n < 100"),
    "stored_order": (stored_order, ["True", "11906"]),
    "pattern_column": (pattern_column, "SELECT p_partkey, CAST(p_brand LIKE '%#' || (p_size % 5)::VARCHAR || '_' AS BIGINT) AS l, CAST(p_brand GLOB '*#' || (p_size % 5)::VARCHAR || '?' AS BIGINT) AS g FROM part"),
    "cli_split": (cli_split, ["CREATE TABLE t (a INTEGER, b TEXT)", "INSERT INTO t VALUES (1, 'x;y')", "INSERT INTO t VALUES (NULL, 'z')", "SELECT a, b FROM t", "SELECT 1e15, X'41'"]),
    "cli_script": (cli_script, ["1|x;y", "NULL|z", "1.0e+15|A"]),
    "cli_rendered": (cli_rendered, ["NULL", "1", "-5", "1.0", "1.0e+15", "1.0e-05", "0.1", "123456.789", "t", "A"]),
    "slt_rendered": (slt_rendered, ["NULL", "1", "7", "2.000", "1.235", "0.000", "(empty)", "@@@", "1.0", "@B"]),
    "slt_records": (slt_records, ["statement 1  nosort False 0", "statement 4  nosort False 0", "statement 7  nosort False 0", "query 10 IT rowsort False 4", "query 18 I nosort False 2", "statement 24  nosort True 0", "query 27 I nosort False 1"]),
    "slt_verdicts": (slt_verdicts, ["5 1 1 7 [18]", "5 2 0 7 [18, 27]"]),
    "slt_sorts": (slt_sorts, ["2 b 10 a 1 c", "1 c 10 a 2 b", "1 10 2 a b c"]),
    "slt_hash": (slt_hash, "SELECT CAST(0 AS BIGINT) AS n, md5(string_agg(n_nationkey::VARCHAR || chr(10), '' ORDER BY n_nationkey)) AS said FROM nation"),
    "tokens_of": (tokens_of, ["word SELECT", "word a_1", "sign ,", "text 'it''s'", "sign <=", "number 1.5e3", "sign !=", "blob x'0A'", "sign ==", "number .5", "sign ;", "end end of input"]),
    "affinities": (affinities, ["INTEGER INTEGER", "TINYINT INTEGER", "VARCHAR TEXT", "CLOB TEXT", "TEXT TEXT", "BLOB BLOB", "REAL REAL", "DOUBLE REAL", "FLOAT REAL", "NUMERIC NUMERIC", "DECIMAL NUMERIC", "DATE NUMERIC", "CHARINT INTEGER"]),
    "stored_affinity": (stored_affinity, ["12 12.0 '12' 12 '12'", "1 1.0 '1.0' 1 '1.0'", "1.5 1.5 '1.5' 1.5 '1.5'", "'12x' '12x' '12x' '12x' '12x'", "3 3.0 '3' 3 3", "2 2.0 '2.0' 2 2.0", "2.5 2.5 '2.5' 2.5 2.5", "b'1' b'1' b'1' b'1' b'1'"]),
    "finds_aggregates": (finds_aggregates, ["False", "True", "True", "True", "False"]),
    "reparsed_ddl": (reparsed_ddl, ["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT DEFAULT 'x' CHECK ((b LIKE 'a%' ESCAPE '!')), c REAL NOT NULL DEFAULT (((-1.5) + 2)), UNIQUE (a, b))", "True"]),
    "stream_append": (stream_append, "SELECT event_id, user_id, value * 2 AS twice FROM events WHERE value > 50"),
}


def queries() -> dict[str, Query]:
    return {name: _run_statements(s) for name, s in STATEMENTS.items()} | {name: f for name, (f, _) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: _values([x for _, x in s]) for name, s in STATEMENTS.items()}
    return out | {name: x if isinstance(x, str) else _values(x) for name, (_, x) in CALLS.items()}
