"""One query per data-changing statement: it runs the statement over whole tables in a store of its own and returns what the table holds.

The SQL of each says the same final state as a SELECT.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import relational
from ..session import Session
from ..sources import copy_format

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The table most statements start from: all orders, keyed, with defaults for what an INSERT leaves out.
ORDERS = (
    "CREATE TABLE t (id BIGINT PRIMARY KEY, status TEXT DEFAULT 'new' NOT NULL, total DOUBLE PRECISION DEFAULT 0 CHECK (total >= 0), note TEXT)",
    "INSERT INTO t (id, status, total) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
STATE = "SELECT id, status, round(total, 2) AS total, note FROM t"


def session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    """A session over an empty store in the shared folder, with these tables of sf_dir in view."""
    own = Session(spark, f"{relational.shared_dir(spark)}/stores/{uuid.uuid4().hex}")
    for name in tables:
        own.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return own


def statement(name: str, *texts: str, duck: str, tables: tuple[str, ...] = ("orders",)) -> None:
    """Register a query that runs texts in order; the last gives the rows (a SELECT, or a statement with RETURNING)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = session(spark, sf_dir, *tables)
        for text in texts[:-1]:
            own.sql(text.replace("{scratch}", own.store.root))
        last = own.sql(texts[-1])
        return last if isinstance(last, DataFrame) else last.rows

    QUERIES[name] = run
    ORACLES[name] = duck


statement(
    "insert_default_result",
    ORDERS[0],
    "INSERT INTO t (id, total) SELECT o_orderkey, o_totalprice FROM orders",
    "INSERT INTO t VALUES (-1, DEFAULT, DEFAULT, upper('x')), (-2, 'F', 1.5, NULL)",
    STATE,
    duck="SELECT o_orderkey AS id, 'new' AS status, round(o_totalprice, 2) AS total, CAST(NULL AS VARCHAR) AS note FROM orders UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 'new', 0::DOUBLE, 'X'), (-2, 'F', 1.5, NULL))",
)
statement(
    "insert_returning",
    ORDERS[0],
    "INSERT INTO t (id, total) SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' RETURNING id, status, round(total * 2, 2) AS twice",
    duck="SELECT o_orderkey AS id, 'new' AS status, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_orderstatus <> 'P'",
)
statement(
    "update_result",
    *ORDERS,
    "UPDATE t SET total = t.total * 2, status = DEFAULT, note = status || '!' WHERE status = 'P' OR id % 10 = 0",
    STATE,
    duck="SELECT o_orderkey AS id, CASE WHEN hit THEN 'new' ELSE o_orderstatus END AS status, round(CASE WHEN hit THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS total, CASE WHEN hit THEN o_orderstatus || '!' END AS note FROM (SELECT *, o_orderstatus = 'P' OR o_orderkey % 10 = 0 AS hit FROM orders)",
)
statement(
    "update_returning",
    *ORDERS,
    "UPDATE t SET total = total + 1 WHERE status = 'F' RETURNING id, round(total, 2) AS total",
    duck="SELECT o_orderkey AS id, round(o_totalprice + 1, 2) AS total FROM orders WHERE o_orderstatus = 'F'",
)
statement(
    "delete_result",
    *ORDERS,
    "DELETE FROM t WHERE total < (SELECT avg(total) FROM t) OR id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')",
    STATE,
    duck="SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice, 2) AS total, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_totalprice >= (SELECT avg(o_totalprice) FROM orders) AND o_orderpriority <> '5-LOW'",
)
statement(
    "delete_returning",
    *ORDERS,
    "DELETE FROM t WHERE status = 'O' RETURNING id, status",
    duck="SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O'",
)
statement(
    "upsert_result",
    ORDERS[0],
    "INSERT INTO t (id, status, total) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'",
    "INSERT INTO t (id, status, total) SELECT o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderstatus <> 'O' ON CONFLICT (id) DO UPDATE SET total = t.total + EXCLUDED.total, note = EXCLUDED.status WHERE t.total > 1000",
    STATE,
    duck="SELECT o_orderkey AS id, o_orderstatus AS status, round(CASE WHEN o_orderstatus = 'P' THEN 1 WHEN hit THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS total, CASE WHEN hit THEN o_orderstatus END AS note FROM (SELECT *, o_orderstatus NOT IN ('O', 'P') AND o_totalprice > 1000 AS hit FROM orders)",
)
statement(
    "upsert_nothing_result",
    ORDERS[0],
    "INSERT INTO t (id, status) SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 2 = 0",
    "INSERT INTO t (id) SELECT o_orderkey FROM orders ON CONFLICT DO NOTHING",
    "SELECT id, status FROM t",
    duck="SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS status FROM orders",
)
statement("truncate_result", *ORDERS, "TRUNCATE TABLE t", "SELECT count(*) AS n, max(id) AS top FROM t", duck="SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE false")
statement(
    "alter_result",
    *ORDERS,
    "ALTER TABLE t ADD COLUMN n INT DEFAULT 7",
    "ALTER TABLE t RENAME COLUMN status TO state",
    "ALTER TABLE t DROP COLUMN note",
    "SELECT id, state, n FROM t",
    duck="SELECT o_orderkey AS id, o_orderstatus AS state, 7::INT AS n FROM orders",
)
statement(
    "view_result",
    *ORDERS,
    "CREATE VIEW high AS SELECT id, total FROM t WHERE total > 250000",
    "UPDATE t SET total = 1 WHERE id % 2 = 0",
    "SELECT id, round(total, 2) AS total FROM high",
    duck="SELECT o_orderkey AS id, round(o_totalprice, 2) AS total FROM orders WHERE o_totalprice > 250000 AND o_orderkey % 2 <> 0",
)
statement(
    "create_table_as",
    "CREATE TABLE t AS SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "SELECT status, n FROM t",
    duck="SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus",
)
statement(
    "transaction_result",
    *ORDERS,
    "BEGIN",
    "DELETE FROM t WHERE status = 'P'",
    "SAVEPOINT s",
    "UPDATE t SET status = 'gone'",
    "ROLLBACK TO SAVEPOINT s",
    "INSERT INTO t (id) VALUES (-1)",
    "COMMIT",
    "BEGIN",
    "DELETE FROM t",
    "ROLLBACK",
    "SELECT id, status FROM t",
    duck="SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -1, 'new'",
)
statement(
    "info_schema_columns",
    ORDERS[0],
    "SELECT column_name, ordinal_position, is_nullable, column_default IS NOT NULL AS has_default FROM information_schema.columns WHERE table_name = 't'",
    tables=(),
    duck="SELECT * FROM (VALUES ('id', 1, 'NO', false), ('status', 2, 'NO', true), ('total', 3, 'YES', true), ('note', 4, 'YES', false)) AS v(column_name, ordinal_position, is_nullable, has_default)",
)


def copied(name: str, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str, list[str]], DataFrame]) -> None:
    """Register a query that writes all customers in a COPY format and reads them again; fields come back as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{relational.shared_dir(spark)}/copies/{uuid.uuid4().hex}"
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS STRING) AS id", "concat(c_name, '\\t\\\\', c_mktsegment) AS name", "nullif(c_mktsegment, 'BUILDING') AS segment")
        write(rows, path)
        return read(spark, path, rows.columns)

    QUERIES[name] = run
    ORACLES[name] = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || chr(9) || chr(92) || c_mktsegment AS name, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"


copied("copy_text_round_trip", copy_format.write_text, copy_format.read_text)
copied("copy_csv_round_trip", copy_format.write_csv, copy_format.read_csv)
