"""Queries in PostgreSQL's words, run through a Session: dialect, functions, naming, catalog, constraints and rights.

Each has the SQL it must agree with; where one text serves both sides it is given once.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import relational
from ..session import Session
from ..sources import copy_format, dump
from ..sources.storage import SqlError
from .statements import ORDERS, session, statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def pg(name: str, text: str, duck: str | None = None, params: list | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = session(spark, sf_dir, *(t for t in TABLES if t in text))
        return own.sql(text, params)

    QUERIES[f"pg_{name}"] = run
    ORACLES[f"pg_{name}"] = duck or text


# Default names, arithmetic, casts
pg("names", "SELECT count(*), sum(o_orderkey % 7), max(o_orderkey) AS top, min(o_orderkey) least FROM orders", "SELECT count(*) AS count, sum(o_orderkey % 7)::BIGINT AS sum, max(o_orderkey) AS top, min(o_orderkey) AS least FROM orders")
pg("names_expressions", "SELECT o_orderkey, CASE WHEN o_orderkey > 5 THEN 'a' ELSE 'b' END, upper(o_orderstatus), o_orderkey::text AS t, o_orderkey + 1 FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey > 5 THEN 'a' ELSE 'b' END AS \"case\", upper(o_orderstatus) AS upper, o_orderkey::VARCHAR AS t, o_orderkey + 1 AS \"?column?\" FROM orders")
pg("derived_names", "SELECT s.o_custkey, s.max FROM (SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey) s WHERE s.max > 100000", "SELECT s.o_custkey, s.max FROM (SELECT o_custkey, max(o_totalprice) AS max FROM orders GROUP BY o_custkey) s WHERE s.max > 100000")
pg("division_by_zero", "SELECT l_orderkey, l_linenumber, l_extendedprice / (l_linenumber - 1) AS q, (l_orderkey % (l_linenumber - 1))::bigint AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_extendedprice / (l_linenumber - 1) END AS q, CASE WHEN l_linenumber <> 1 THEN (l_orderkey % (l_linenumber - 1))::BIGINT END AS r FROM lineitem")
pg("integer_division", "SELECT n_nationkey FROM nation WHERE n_nationkey / 4 = 2 AND 7 / 2 = 3", "SELECT n_nationkey FROM nation WHERE n_nationkey // 4 = 2")
pg("product_overflow", "SELECT n_nationkey, (n_nationkey::bigint * 4611686018427387904) IS NULL AS over FROM nation", "SELECT n_nationkey, n_nationkey >= 2 AS over FROM nation")
pg("cast_forms", "SELECT CAST('12' AS integer) AS i, '2.5'::int AS h, CAST('x' AS int) AS bad, '1.25'::numeric(10,1)::text AS d, 't'::boolean AS b", "SELECT 12 AS i, 2 AS h, CAST(NULL AS INT) AS bad, '1.3' AS d, true AS b")
pg("escapes", r"SELECT E'a\tb\\c' AS e, trim(E'\t x \n') AS t, 'it''s' AS q, ltrim('xxa', 'x') AS l, trim(trailing 'z' from 'azz') AS r", "SELECT 'a' || chr(9) || 'b' || chr(92) || 'c' AS e, 'x' AS t, 'it''s' AS q, 'a' AS l, 'a' AS r")
pg("interval_arithmetic", "SELECT (INTERVAL '1 day 2 hours' + INTERVAL '22 hours' = INTERVAL '2 days') AS same, (INTERVAL '2 months' > INTERVAL '1 month') AS more, CAST(DATE '2024-01-31' + INTERVAL '1 month' AS DATE) AS d", "SELECT true AS same, true AS more, DATE '2024-02-29' AS d")
pg("parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $1 AND o_totalprice > $2", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000", ["F", 100000])
pg("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 3 ROWS FETCH FIRST 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 3")
pg("session_functions", "SELECT current_database() AS d, current_schema() AS s, version() LIKE 'PostgreSQL%' AS v", "SELECT 'default' AS d, 'public' AS s, true AS v")

# Predicates
pg("predicates", "SELECT n_name FROM nation WHERE n_name ILIKE 'a%' OR n_name ~ '^N.*1$' OR n_name ~* 'nation_2' OR n_regionkey = ANY(ARRAY[1, 3])", "SELECT n_name FROM nation WHERE n_name ILIKE 'a%' OR regexp_matches(n_name, '^N.*1$') OR regexp_matches(n_name, '(?i)nation_2') OR n_regionkey IN (1, 3)")
pg("truth", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000) IS TRUE AND (nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F')")
pg("row_constructors", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('P', '5-LOW'))")

# JSON, arrays, table functions
pg("json_access", "SELECT event_id, props -> 'k' AS a, props #>> '{k}' AS b, props ->> 'none' AS c FROM events", "SELECT event_id, props->>'$.k' AS a, props->>'$.k' AS b, CAST(NULL AS VARCHAR) AS c FROM events")
pg("json_containment", "SELECT event_id FROM events WHERE props @> '{\"k\": 42}'", "SELECT event_id FROM events WHERE json_contains(CAST(props AS JSON), CAST('{\"k\": 42}' AS JSON))")
pg("array_containment", "SELECT n_nationkey FROM nation WHERE ARRAY[0, 1, 2] @> ARRAY[n_regionkey, 1]", "SELECT n_nationkey FROM nation WHERE list_has_all([0, 1, 2], [n_regionkey, 1])")
pg("unnest_select_list", "SELECT n_nationkey, unnest(ARRAY[n_regionkey, 7]) AS v FROM nation", "SELECT n_nationkey, unnest([n_regionkey, 7]) AS v FROM nation")
pg("series_lateral", "SELECT r_regionkey, i FROM region, generate_series(0, 3) AS g(i) WHERE i <= r_regionkey", "SELECT r_regionkey, i FROM region, generate_series(0, 3) AS g(i) WHERE i <= r_regionkey")
pg("unnest_ordinality", "SELECT v, n FROM unnest(ARRAY['p', 'q', 'r']) WITH ORDINALITY AS u(v, n)", "SELECT * FROM (VALUES ('p', 1::BIGINT), ('q', 2), ('r', 3)) AS u(v, n)")
pg("split_to_table", "SELECT p_partkey, w FROM part, regexp_split_to_table(p_name, '[ #]') AS s(w)", "SELECT p_partkey, unnest(regexp_split_to_array(p_name, '[ #]')) AS w FROM part")

# Joins, aggregates, windows
pg("as_of_join", "SELECT c_custkey, o.o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) o ON TRUE")
pg("range_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey + 1 AND a.n_nationkey + 2")
pg("string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
pg("filtered_distinct", "SELECT n_regionkey, count(DISTINCT n_name) FILTER (WHERE n_nationkey > 5) AS n FROM nation GROUP BY n_regionkey")
pg("percentiles", "SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS middle, bool_and(o_totalprice > 0) AS positive FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS middle, bool_and(o_totalprice > 0) AS positive FROM orders GROUP BY o_orderstatus")
pg("groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders WHERE o_totalprice > 1000")
pg("named_window", "SELECT o_orderkey, (rank() OVER w)::bigint AS r, lag(o_totalprice, 1) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", "SELECT o_orderkey, rank() OVER w AS r, lag(o_totalprice, 1) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
pg("window_over_division", "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) > 0.5 AS most FROM orders")
pg("recursive", "WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT (r.n + 1) % 5 FROM r JOIN region ON r_regionkey = r.n) SELECT n FROM r", "SELECT r_regionkey::INT AS n FROM region")
pg("union_names", "SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM lineitem", "SELECT count(*) AS count FROM orders UNION ALL SELECT count(*) FROM lineitem")

# Statements
statement("update_subquery_result", *ORDERS, "SELECT count(*) FROM t", "UPDATE t SET total = 5 WHERE status = 'P'", "UPDATE t SET total = (SELECT min(total) FROM t) + 1, note = status WHERE id % 2 = 0", "SELECT id, round(total, 2) AS total, note FROM t", duck="SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 2 = 0 THEN (SELECT min(CASE WHEN o_orderstatus = 'P' THEN 5 ELSE o_totalprice END) FROM orders) + 1 WHEN o_orderstatus = 'P' THEN 5 ELSE o_totalprice END, 2) AS total, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS note FROM orders")
statement("insert_values_subquery_result", "CREATE TABLE u (x BIGINT)", "CREATE TABLE t (a BIGINT)", "INSERT INTO u VALUES (1)", "SELECT * FROM u", "INSERT INTO u SELECT count(*) FROM orders", "INSERT INTO t VALUES ((SELECT max(x) FROM u)), ((SELECT min(x) FROM u))", "SELECT a FROM t", duck="SELECT count(*) AS a FROM orders UNION ALL SELECT 1")
statement("update_from_result", *ORDERS, "CREATE TABLE big AS SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY o_custkey", "UPDATE t AS x SET note = 'top' FROM orders o, big WHERE o.o_orderkey = x.id AND big.k = o.o_custkey AND big.m = x.total", "SELECT id, note FROM t", duck="SELECT o_orderkey AS id, CASE WHEN o_totalprice = max(o_totalprice) OVER (PARTITION BY o_custkey) THEN 'top' END AS note FROM orders")
statement("delete_using_result", *ORDERS, "DELETE FROM t USING orders o WHERE o.o_orderkey = t.id AND o.o_orderpriority = '1-URGENT'", "SELECT id FROM t", duck="SELECT o_orderkey AS id FROM orders WHERE o_orderpriority <> '1-URGENT'")
statement("drop_table_result", *ORDERS, "DROP TABLE t", "CREATE TABLE t AS SELECT 1::int AS a", "SELECT a FROM t", duck="SELECT 1 AS a")
statement("index_catalog", ORDERS[0], "CREATE INDEX by_status ON t (status)", "SELECT i.relname, x.indisunique, x.indisprimary FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class r ON r.oid = x.indrelid WHERE r.relname = 't'", tables=(), duck="SELECT * FROM (VALUES ('t_pkey', true, true), ('by_status', false, false)) AS v(relname, indisunique, indisprimary)")
statement("column_types_catalog", ORDERS[0], "SELECT a.attname, format_type(a.atttypid, a.atttypmod) AS kind, a.attnotnull FROM pg_catalog.pg_attribute a JOIN pg_catalog.pg_class c ON c.oid = a.attrelid WHERE c.relname = 't'", tables=(), duck="SELECT * FROM (VALUES ('id', 'bigint', true), ('status', 'text', true), ('total', 'double precision', false), ('note', 'text', false)) AS v(attname, kind, attnotnull)")
statement("constraint_catalog", ORDERS[0], "CREATE TABLE c (id BIGINT REFERENCES t(id))", "SELECT conname, contype FROM pg_constraint", tables=(), duck="SELECT * FROM (VALUES ('t_pkey', 'p'), ('t_check', 'c'), ('c_id_fkey', 'f')) AS v(conname, contype)")
statement("schema_result", "CREATE SCHEMA s", "CREATE TABLE s.t AS SELECT o_orderkey AS id FROM orders", "SELECT table_schema, table_name FROM information_schema.tables", duck="SELECT 's' AS table_schema, 't' AS table_name")
statement("copy_statement_result", "CREATE TABLE t (id BIGINT, status TEXT)", "INSERT INTO t SELECT o_orderkey, nullif(o_orderstatus, 'P') FROM orders", "CREATE TABLE u (id BIGINT, status TEXT)", "COPY t TO '{scratch}/copied' (FORMAT csv, HEADER)", "COPY u FROM '{scratch}/copied' (FORMAT csv, HEADER)", "SELECT id, status FROM u", duck="SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') AS status FROM orders")
statement("setting_result", "SET application_name = 'x'", "SET TIME ZONE 'UTC'", "SHOW application_name", tables=(), duck="SELECT 'x' AS application_name")


def outcomes(name: str, prepare: list[str], *steps: tuple[str, str, str], tables: tuple[str, ...] = ()) -> None:
    """Register a query that runs steps (role, text, SQLSTATE or 'ok') and returns what came of each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = session(spark, sf_dir, *tables)
        for text in prepare:
            first.sql(text)
        sessions, rows = {"": first}, []
        for n, (role, text, _) in enumerate(steps):
            own = sessions.setdefault(role, Session(spark, first.store.root, role=role))
            try:
                own.sql(text)
                rows.append((n, "ok"))
            except SqlError as e:
                rows.append((n, e.sqlstate))
        return spark.createDataFrame(rows, "step int, outcome string")

    QUERIES[name] = run
    ORACLES[name] = "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{state}')" for n, (_, _, state) in enumerate(steps)) + ") AS v(step, outcome)"


outcomes(
    "constraint_outcomes",
    ["CREATE TABLE p (id INT PRIMARY KEY, email TEXT UNIQUE, age INT NOT NULL CHECK (age >= 0))", "CREATE TABLE c (id INT, pid INT REFERENCES p(id))", "INSERT INTO p VALUES (1, 'a', 5), (2, NULL, 6)"],
    ("", "INSERT INTO p VALUES (1, 'b', 1)", "23505"),
    ("", "INSERT INTO p VALUES (3, 'a', 1)", "23505"),
    ("", "INSERT INTO p VALUES (3, NULL, NULL)", "23502"),
    ("", "UPDATE p SET age = -1 WHERE id = 2", "23514"),
    ("", "INSERT INTO c VALUES (1, 9)", "23503"),
    ("", "INSERT INTO c VALUES (1, 1), (2, NULL)", "ok"),
    ("", "INSERT INTO nothing VALUES (1)", "42P01"),
    ("", "INSERT INTO p (id, colour) VALUES (1, 'x')", "42703"),
    ("", "CREATE TABLE p (id INT)", "42P07"),
    ("", "CREATE TABLE q.t (id INT)", "3F000"),
)
outcomes(
    "rights_outcomes",
    ["CREATE TABLE t (a INT)", "CREATE TABLE u (a INT)", "CREATE ROLE readers", "CREATE ROLE bob LOGIN", "CREATE ROLE eve LOGIN", "GRANT readers TO bob", "GRANT SELECT ON t TO readers", "CREATE VIEW v AS SELECT a FROM u", "GRANT SELECT ON v TO bob"],
    ("bob", "SELECT * FROM t", "ok"),
    ("bob", "SELECT * FROM v", "ok"),
    ("bob", "SELECT * FROM u", "42501"),
    ("bob", "INSERT INTO t VALUES (1)", "42501"),
    ("bob", "UPDATE t SET a = 1", "42501"),
    ("bob", "GRANT ALL ON u TO bob", "42501"),
    ("bob", "DROP TABLE u", "42501"),
    ("bob", "ALTER TABLE t ADD COLUMN b INT", "42501"),
    ("bob", "CREATE TABLE mine (a INT)", "42501"),
    ("bob", "CREATE ROLE other", "42501"),
    ("eve", "SELECT * FROM t", "42501"),
    ("", "GRANT CREATE ON SCHEMA public TO bob", "ok"),
    ("bob", "CREATE TABLE mine (a INT)", "ok"),
    ("bob", "INSERT INTO mine VALUES ((SELECT max(a) FROM u))", "42501"),
    ("bob", "GRANT SELECT ON mine TO eve", "ok"),
    ("eve", "SELECT * FROM mine", "ok"),
    ("", "GRANT ALL ON SYSTEM TO eve", "ok"),
    ("eve", "DROP TABLE u", "ok"),
    ("", "REVOKE readers FROM bob", "ok"),
    ("bob", "SELECT * FROM t", "42501"),
)
outcomes(
    "transaction_outcomes",
    ["CREATE TABLE t (a INT)", "CREATE TABLE u (a INT)"],
    ("", "COMMIT", "ok"),
    ("", "SAVEPOINT s", "25P01"),
    ("", "BEGIN", "ok"),
    ("", "BEGIN", "25001"),
    ("", "ROLLBACK", "ok"),
    ("", "BEGIN", "ok"),
    ("", "INSERT INTO t VALUES (1)", "ok"),
    ("postgres", "INSERT INTO t VALUES (2)", "ok"),
    ("", "COMMIT", "40001"),
    ("", "BEGIN", "ok"),
    ("", "INSERT INTO t VALUES (1)", "ok"),
    ("postgres", "INSERT INTO u VALUES (2)", "ok"),
    ("", "COMMIT", "ok"),
    ("", "SET statement_timeout = 100", "ok"),
    ("", "SELECT pg_sleep(1)", "57014"),
    ("", "SELECT " + "(SELECT " * 120 + "1" + ")" * 120, "54001"),
)


def made(name: str, duck: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLES[name] = f, duck
        return f

    return register


@made("cursor_parts", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY id LIMIT 7")
def cursor_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rows of a cursor, fetched in three parts."""
    own = session(spark, sf_dir, "orders")
    own.sql("BEGIN")
    own.sql("DECLARE c CURSOR FOR SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY id")
    parts = [own.sql(f"FETCH {n} FROM c").rows for n in (1, 4, 2)]
    own.sql("CLOSE c")
    own.sql("COMMIT")
    return parts[0].union(parts[1]).union(parts[2])


@made("backup_restore_result", "SELECT o_orderkey AS id FROM orders")
def backup_restore_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a backup, the loss of its rows, and a restore into the store."""
    own = session(spark, sf_dir, "orders")
    own.sql("CREATE TABLE t AS SELECT o_orderkey AS id FROM orders")
    folder = f"{relational.shared_dir(spark)}/backups/{uuid.uuid4().hex}"
    own.store.backup(folder)
    own.sql("DELETE FROM t")
    own.store.backup(folder)
    own.store.restore(folder, moment=own.store.read(1)["time"])
    return own.sql("SELECT id FROM t")


@made("copy_binary_rows", "SELECT * FROM (VALUES (1::BIGINT, 'a', true), (-7, NULL, false)) AS v(id, name, good)")
def copy_binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of a binary COPY file."""
    field = lambda b: struct.pack(">i", -1) if b is None else struct.pack(">i", len(b)) + b
    body = b"".join(struct.pack(">h", 3) + field(struct.pack(">q", i)) + field(n) + field(g) for i, n, g in ((1, b"a", b"\1"), (-7, None, b"\0")))
    own = session(spark, sf_dir)
    own.sql("CREATE TABLE t (id BIGINT, name TEXT, good BOOLEAN)")
    own.copy_in("COPY t FROM STDIN (FORMAT binary)", copy_format.SIGNATURE + struct.pack(">ii", 0, 0) + body + struct.pack(">h", -1))
    return own.sql("SELECT * FROM t")


@made("dump_result", "SELECT * FROM (VALUES (1, 'a' || chr(9) || 'b', 2.5::DOUBLE), (2, NULL, 0), (3, 'x', 1)) AS v(id, name, v)")
def dump_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of an SQL dump with a COPY block and an INSERT."""
    own = session(spark, sf_dir)
    dump.load(own, "SET x = 1;\nCREATE TABLE public.t (id integer NOT NULL, name text, v double precision DEFAULT 0);\nCOPY public.t (id, name, v) FROM stdin;\n1\ta\\tb\t2.5\n2\t\\N\t0\n\\.\n\nINSERT INTO t VALUES (3, 'x', 1);\nALTER TABLE ONLY public.t ADD CONSTRAINT t_pkey PRIMARY KEY (id);\n")
    return own.sql("SELECT * FROM t")
