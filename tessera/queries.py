"""The dialect's operators over the test tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .sources.store import Store


class Query(NamedTuple):
    table: str | None
    sql: str
    oracle: str
    #: For results whose class depends on the data: the type of each column (I, R, T).
    types: str | None = None



QUERIES: dict[str, Query] = {
    "flagship": Query("lineitem", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2"),
    # sources and projection
    "scan_project": Query("nation", "SELECT n_nationkey, n_name FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "star": Query("region", "SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "alias_forms": Query("region", "SELECT r_regionkey AS k, r_name label FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS label FROM region"),
    "select_all": Query("region", "SELECT ALL r_name AS n FROM region", "SELECT r_name AS n FROM region"),
    "const_select": Query(None, "SELECT 1+2*3 AS x, 10/3 AS y, 1/0 AS z, -7/2 AS w, 7%-3 AS m", "SELECT CAST(7 AS BIGINT) AS x, CAST(3 AS BIGINT) AS y, CAST(NULL AS VARCHAR) AS z, CAST(-3 AS BIGINT) AS w, CAST(1 AS BIGINT) AS m"),
    "literals": Query(None, "SELECT 1.5 AS r, .5 AS h, 1e3 AS e, 'it''s' AS t, TRUE AS y, FALSE AS n", "SELECT 1.5::DOUBLE AS r, 0.5::DOUBLE AS h, 1000.0::DOUBLE AS e, 'it''s' AS t, CAST(1 AS BIGINT) AS y, CAST(0 AS BIGINT) AS n"),
    "timestamp_as_text": Query("orders", "SELECT o_orderkey, o_orderdate AS d FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'"),
    # comparison and logic
    "filter_eq": Query("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "filter_eq_double_sign": Query("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus == 'O'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"),
    "filter_ne": Query("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_lt": Query("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice < 50000", "SELECT o_orderkey FROM orders WHERE o_totalprice < 50000"),
    "filter_gt": Query("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 3.5", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber > 3.5"),
    "filter_le": Query("part", "SELECT p_partkey FROM part WHERE p_size <= 10", "SELECT p_partkey FROM part WHERE p_size <= 10"),
    "filter_ge": Query("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000"),
    "filter_and_or_not": Query("part", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40) AND p_retailprice > 950", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40) AND p_retailprice > 950"),
    "filter_truth": Query("part", "SELECT p_partkey FROM part WHERE p_size % 3", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0"),
    "comparison_value": Query("part", "SELECT p_partkey, p_size > 25 AS big, p_size = 7 AS seven FROM part", "SELECT p_partkey, CAST(p_size > 25 AS BIGINT) AS big, CAST(p_size = 7 AS BIGINT) AS seven FROM part"),
    "comparison_affinity": Query("part", "SELECT p_partkey FROM part WHERE p_size = '11'", "SELECT p_partkey FROM part WHERE p_size = 11"),
    "comparison_classes": Query("part", "SELECT p_partkey, p_size + 0 < 'a' AS l, p_size + 0 = '11' AS e, p_name > 5 AS g FROM part", "SELECT p_partkey, CAST(1 AS BIGINT) AS l, CAST(0 AS BIGINT) AS e, CAST(1 AS BIGINT) AS g FROM part"),
    "three_valued_logic": Query("part", "SELECT p_partkey, (p_size/(p_size-10)) > 0 AND p_size > 5 AS v, (p_size/(p_size-10)) > 0 OR p_size > 5 AS w, NOT (p_size/(p_size-10)) > 0 AS x FROM part", "SELECT p_partkey, CAST((p_size // nullif(p_size-10, 0)) > 0 AND p_size > 5 AS BIGINT) AS v, CAST((p_size // nullif(p_size-10, 0)) > 0 OR p_size > 5 AS BIGINT) AS w, CAST(NOT (p_size // nullif(p_size-10, 0)) > 0 AS BIGINT) AS x FROM part"),
    "is_null": Query("part", "SELECT p_partkey FROM part WHERE p_size / (p_size - 10) IS NULL", "SELECT p_partkey FROM part WHERE p_size = 10"),
    "is_not_null": Query("part", "SELECT p_partkey FROM part WHERE p_size / (p_size - 10) IS NOT NULL", "SELECT p_partkey FROM part WHERE p_size <> 10"),
    "is_value": Query("part", "SELECT p_partkey, p_size / (p_size - 10) IS 1 AS one, p_size IS NOT 10 AS other FROM part", "SELECT p_partkey, CAST((p_size // nullif(p_size - 10, 0)) IS NOT DISTINCT FROM 1 AS BIGINT) AS one, CAST(p_size IS DISTINCT FROM 10 AS BIGINT) AS other FROM part"),
    "in_list": Query("nation", "SELECT n_name FROM nation WHERE n_regionkey IN (0, 2)", "SELECT n_name FROM nation WHERE n_regionkey IN (0, 2)"),
    "not_in": Query("nation", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 2)", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 2)"),
    "in_with_null": Query("part", "SELECT p_partkey, p_size IN (1, 2, NULL) AS a, p_size NOT IN (1, 2, NULL) AS b, p_size IN (p_size, 3) AS c FROM part", "SELECT p_partkey, CAST(p_size IN (1, 2, NULL) AS BIGINT) AS a, CAST(p_size NOT IN (1, 2, NULL) AS BIGINT) AS b, CAST(1 AS BIGINT) AS c FROM part"),
    "between": Query("lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 10", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 10"),
    "not_between": Query("lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45"),
    # arithmetic
    "arith_int": Query("lineitem", "SELECT l_orderkey, l_linenumber + 1 AS a, l_linenumber * 2 AS b, l_linenumber / 2 AS c, l_linenumber % 3 AS d, 0 - l_linenumber AS e FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber + 1 AS BIGINT) AS a, CAST(l_linenumber * 2 AS BIGINT) AS b, CAST(l_linenumber // 2 AS BIGINT) AS c, CAST(l_linenumber % 3 AS BIGINT) AS d, CAST(-l_linenumber AS BIGINT) AS e FROM lineitem"),
    "arith_int_wide": Query("orders", "SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey * 9223372036854775807 AS b FROM orders", "SELECT o_orderkey, o_orderkey + 1 AS a, CASE WHEN abs(o_orderkey) <= 1 THEN (o_orderkey * 9223372036854775807)::DOUBLE ELSE o_orderkey::DOUBLE * 9223372036854775807::DOUBLE END AS b FROM orders", "IIR"),
    "arith_real": Query("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS a, l_quantity / 7 AS b, l_quantity % 7 AS c FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice * (1 - l_discount) AS a, l_quantity / 7 AS b, CAST(CAST(trunc(l_quantity) AS BIGINT) % 7 AS DOUBLE) AS c FROM lineitem"),
    "arith_text": Query("orders", "SELECT o_orderkey, o_orderpriority + 10 AS a, o_orderpriority * 2.5 AS b, o_orderstatus - 1 AS c FROM orders", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) + 10 AS a, CAST(left(o_orderpriority, 1) AS DOUBLE) * 2.5 AS b, CAST(-1 AS BIGINT) AS c FROM orders", "IIRI"),
    "div_zero_null": Query("part", "SELECT p_partkey, p_size / (p_size - 10) AS q, p_retailprice / 0 AS r, p_size % 0 AS m FROM part", "SELECT p_partkey, CAST(p_size // nullif(p_size - 10, 0) AS BIGINT) AS q, CAST(NULL AS DOUBLE) AS r, CAST(NULL AS BIGINT) AS m FROM part"),
    "negate": Query("supplier", "SELECT s_suppkey, -s_acctbal AS n, +s_nationkey AS p FROM supplier", "SELECT s_suppkey, -s_acctbal AS n, CAST(s_nationkey AS BIGINT) AS p FROM supplier"),
    # patterns
    "like": Query("part", "SELECT p_partkey FROM part WHERE p_name LIKE '%RING%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%'"),
    "not_like": Query("part", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%a_%e%'", "SELECT p_partkey FROM part WHERE p_name NOT ILIKE '%a_%e%'"),
    "like_escape": Query("part", "SELECT p_partkey FROM part WHERE p_brand LIKE 'brand!#1%' ESCAPE '!'", "SELECT p_partkey FROM part WHERE p_brand ILIKE 'Brand#1%'"),
    "like_number": Query("part", "SELECT p_partkey FROM part WHERE p_size LIKE '1_'", "SELECT p_partkey FROM part WHERE p_size::VARCHAR LIKE '1_'"),
    "glob": Query("part", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[12]*'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[12]')"),
    "not_glob": Query("part", "SELECT p_partkey FROM part WHERE p_brand NOT GLOB '*#[^2-9]?'", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand, '#[^2-9].$')"),
    # casts
    "cast_int": Query("part", "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS v, CAST(p_brand AS INT) AS w FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS v, CAST(0 AS BIGINT) AS w FROM part"),
    "cast_text_int": Query("orders", "SELECT o_orderkey, CAST(o_orderpriority AS INTEGER) AS v, CAST(o_orderdate AS INTEGER) AS y FROM orders", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS v, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders"),
    "cast_text_real": Query("orders", "SELECT o_orderkey, CAST(o_orderpriority AS REAL) AS v, CAST(CAST(o_totalprice AS TEXT) AS REAL) AS w FROM orders", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS DOUBLE) AS v, o_totalprice AS w FROM orders"),
    "cast_real": Query("part", "SELECT p_partkey, CAST(p_size AS REAL) AS v FROM part", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS v FROM part"),
    "cast_text": Query("part", "SELECT p_partkey, CAST(p_size AS TEXT) AS v FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS v FROM part"),
    "cast_real_text": Query("lineitem", "SELECT l_orderkey, CAST(l_quantity AS TEXT) AS v FROM lineitem", "SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' AS v FROM lineitem"),
    "cast_numeric": Query("events", "SELECT event_id, CAST(user_id AS NUMERIC) AS v, CAST(value AS DECIMAL) AS w FROM events", "SELECT event_id, user_id AS v, value AS w FROM events"),
    "cast_text_numeric": Query("orders", "SELECT o_orderkey, CAST(o_orderpriority AS NUMERIC) AS v, CAST(CAST(o_totalprice AS TEXT) AS NUMERIC) AS w, CAST(o_orderstatus AS NUMERIC) AS x FROM orders", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS v, o_totalprice AS w, CAST(0 AS BIGINT) AS x FROM orders", "IIRI"),
    "cast_blob": Query("region", "SELECT r_regionkey, CAST(CAST(r_name AS BLOB) AS TEXT) AS v FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name AS v FROM region"),
    # aggregates
    "count_star": Query("lineitem", "SELECT COUNT(*) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem"),
    "count_expr": Query("part", "SELECT COUNT(p_size / (p_size - 10)) AS n, COUNT(ALL p_size) AS m FROM part", "SELECT count(nullif(p_size - 10, 0)) AS n, count(p_size) AS m FROM part"),
    "count_distinct": Query("orders", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders", "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "count_no_from": Query(None, "SELECT COUNT(*) AS n", "SELECT CAST(1 AS BIGINT) AS n"),
    "sum_int": Query("part", "SELECT SUM(p_size) AS s FROM part", "SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part", "I"),
    "sum_wide": Query("orders", "SELECT SUM(o_orderkey) AS s, SUM(o_custkey) AS c FROM orders", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS s, CAST(sum(o_custkey) AS BIGINT) AS c FROM orders", "II"),
    "sum_real": Query("lineitem", "SELECT SUM(l_quantity) AS s FROM lineitem", "SELECT sum(l_quantity) AS s FROM lineitem"),
    "sum_distinct": Query("part", "SELECT SUM(DISTINCT p_size) AS s FROM part", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part"),
    "avg": Query("part", "SELECT AVG(p_size) AS a FROM part", "SELECT avg(p_size) AS a FROM part"),
    "avg_distinct": Query("part", "SELECT AVG(DISTINCT p_size) AS a FROM part", "SELECT avg(DISTINCT p_size) AS a FROM part"),
    "min_max": Query("customer", "SELECT MIN(c_acctbal) AS lo, MAX(c_name) AS hi, MIN(c_custkey) AS k FROM customer", "SELECT min(c_acctbal) AS lo, max(c_name) AS hi, min(c_custkey) AS k FROM customer"),
    "agg_empty": Query("part", "SELECT COUNT(*) AS n, SUM(p_size) AS s, AVG(p_size) AS a, MIN(p_name) AS m FROM part WHERE p_size < 0", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a, min(p_name) AS m FROM part WHERE p_size < 0", "IIRT"),
    "agg_expression": Query("part", "SELECT SUM(p_size) / COUNT(*) AS a, MAX(p_size) - MIN(p_size) + 1 AS b FROM part", "SELECT CAST(sum(p_size) // count(*) AS BIGINT) AS a, CAST(max(p_size) - min(p_size) + 1 AS BIGINT) AS b FROM part", "II"),
    "group_by": Query("customer", "SELECT c_mktsegment, COUNT(*) AS n, MIN(c_acctbal) AS lo FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS lo FROM customer GROUP BY 1"),
    "group_by_multi": Query("orders", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"),
    "group_by_expr": Query("part", "SELECT p_size % 5 AS k, COUNT(*) AS n FROM part GROUP BY p_size % 5", "SELECT CAST(p_size % 5 AS BIGINT) AS k, count(*) AS n FROM part GROUP BY 1"),
    "group_by_unprojected": Query("part", "SELECT COUNT(*) AS n FROM part GROUP BY p_size", "SELECT count(*) AS n FROM part GROUP BY p_size"),
    "group_null_key": Query("part", "SELECT p_size / (p_size - 10) AS k, COUNT(*) AS n FROM part GROUP BY p_size / (p_size - 10)", "SELECT CAST(p_size // nullif(p_size - 10, 0) AS BIGINT) AS k, count(*) AS n FROM part GROUP BY 1"),
    "group_empty": Query("part", "SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size < 0 GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE p_size < 0 GROUP BY 1"),
    "having": Query("customer", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 60", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 60"),
    "having_unprojected": Query("customer", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING AVG(c_acctbal) > 4500 AND c_nationkey < 20", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer GROUP BY c_nationkey HAVING avg(c_acctbal) > 4500 AND c_nationkey < 20"),
    # distinct, sort, limit
    "distinct": Query("orders", "SELECT DISTINCT o_orderstatus FROM orders", "SELECT DISTINCT o_orderstatus FROM orders"),
    "distinct_multi": Query("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_expr": Query("part", "SELECT DISTINCT p_size / (p_size - 10) AS q FROM part", "SELECT DISTINCT CAST(p_size // nullif(p_size - 10, 0) AS BIGINT) AS q FROM part"),
    "order_ordinal": Query("customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1", "SELECT c_custkey, c_acctbal FROM customer"),
    "order_desc": Query("customer", "SELECT c_name AS n, c_acctbal FROM customer ORDER BY c_acctbal DESC, n ASC", "SELECT c_name AS n, c_acctbal FROM customer ORDER BY c_acctbal DESC, n"),
    "order_expr": Query("customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY -c_acctbal, c_custkey % 7, c_custkey", "SELECT c_custkey, c_acctbal FROM customer ORDER BY -c_acctbal, c_custkey % 7, c_custkey"),
    "order_hidden": Query("customer", "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey", "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey"),
    "order_nulls": Query("part", "SELECT p_size / (p_size - 10) AS q, p_partkey FROM part ORDER BY q, p_partkey", "SELECT CAST(p_size // nullif(p_size - 10, 0) AS BIGINT) AS q, p_partkey FROM part ORDER BY q NULLS FIRST, p_partkey"),
    "order_aggregate": Query("orders", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY COUNT(*) DESC, 1", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1"),
    "topk": Query("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10"),
    "limit_offset": Query("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5"),
    "limit_comma": Query("orders", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7, 4", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 4 OFFSET 7"),
    "limit_negative": Query("nation", "SELECT n_name FROM nation ORDER BY 1 LIMIT -1", "SELECT n_name FROM nation"),
    "limit_zero": Query("nation", "SELECT n_name FROM nation LIMIT 0", "SELECT n_name FROM nation LIMIT 0"),
    "limit_expr": Query("nation", "SELECT n_name FROM nation ORDER BY 1 LIMIT 2 + 3", "SELECT n_name FROM nation ORDER BY 1 LIMIT 5"),
}

#: Statements that change tables: the table they are given a copy of, the statements, the SELECT of the final state.
CHANGES: dict[str, tuple[str, list[str], str, str]] = {
    "dml_insert": ("region", ["INSERT INTO region VALUES (10, 'ATLANTIS')", "INSERT INTO region (r_name) VALUES ('MU')", "INSERT INTO region VALUES (-3, NULL)"], "SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL VALUES (10, 'ATLANTIS'), (NULL, 'MU'), (-3, NULL)"),
    "dml_update": ("customer", ["UPDATE customer SET c_acctbal = c_acctbal * 2, c_mktsegment = 'NONE' WHERE c_nationkey < 5 AND c_name LIKE '%1%'"], "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer", "SELECT c_custkey, CASE WHEN c_nationkey < 5 AND c_name LIKE '%1%' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey < 5 AND c_name LIKE '%1%' THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_update_swap": ("part", ["UPDATE part SET p_name = p_brand, p_brand = p_name WHERE p_size > 25"], "SELECT p_partkey, p_name, p_brand FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS p_brand FROM part"),
    "dml_delete": ("orders", ["DELETE FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_totalprice < 100000"], "SELECT o_orderkey, o_totalprice FROM orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') OR o_totalprice < 100000)"),
    "dml_delete_all": ("nation", ["DELETE FROM nation"], "SELECT COUNT(*) AS n FROM nation", "SELECT CAST(0 AS BIGINT) AS n"),
    "ddl_add_column": ("region", ["ALTER TABLE region ADD COLUMN note TEXT DEFAULT 'none'", "ALTER TABLE region ADD COLUMN n INTEGER", "UPDATE region SET n = r_regionkey * 10 WHERE r_regionkey > 2"], "SELECT r_regionkey, r_name, note, CAST(n AS INTEGER) AS n FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, 'none' AS note, CASE WHEN r_regionkey > 2 THEN CAST(r_regionkey * 10 AS BIGINT) END AS n FROM region"),
    "ddl_rename": ("supplier", ["CREATE INDEX by_nation ON supplier (s_nationkey DESC)", "ALTER TABLE supplier RENAME TO vendor"], "SELECT type, name, tbl_name, rootpage FROM sqlite_master", "SELECT * FROM (VALUES ('index', 'by_nation', 'vendor', CAST(0 AS BIGINT)), ('table', 'vendor', 'vendor', 0)) t(type, name, tbl_name, rootpage)"),
    "ddl_constraints": ("region", ["CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, qty INTEGER DEFAULT (2 + 3) CHECK (qty > 0))", "INSERT INTO items (id, name) VALUES (1, 'a')", "INSERT INTO items VALUES (2, 'b', 7)", "INSERT INTO items VALUES ('3', 'c', DEFAULT)"], "SELECT * FROM items", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(5 AS BIGINT)), (2, 'b', 7), (3, 'c', 5)) t(id, name, qty)"),
    "tx_commit": ("nation", ["BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "UPDATE nation SET n_name = 'X' WHERE n_regionkey = 2", "COMMIT"], "SELECT n_nationkey, n_name FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey = 2 THEN 'X' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 1"),
    "tx_rollback": ("nation", ["BEGIN", "DELETE FROM nation", "INSERT INTO nation VALUES (99, 'Y', 1)", "ROLLBACK"], "SELECT n_nationkey, n_name FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
}


def _select(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark)
        if q.table:
            store.register_parquet(q.table, f"{sf_dir}/{q.table}.parquet")
        return store.sql(q.sql, q.types)

    return run


def _change(table: str, statements: list[str], select: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark)
        store.import_table(table, spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        for s in statements:
            store.execute(s)
        return store.sql(select)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _select(q) for name, q in QUERIES.items()} | {name: _change(t, s, q) for name, (t, s, q, _) in CHANGES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in QUERIES.items()} | {name: o for name, (_, _, _, o) in CHANGES.items()}
