"""One query per relational operator over the star-schema tables, each with the SQL it must agree with.

A text is Spark SQL in which {table} stands for a table of the directory the query runs over.  ``duck`` is given where
the other engine spells an operator differently; elsewhere one text serves both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pg
from ..operators import relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in sorted(set(re.findall(r"\{(\w+)\}", text)))}


def sql(name: str, text: str, duck: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark.sql(text, **tables(spark, sf_dir, text))
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duck or text)


def ordered(name: str, text: str, order: str) -> None:
    """A query that ends in ORDER BY, with the place of each row: on this side by the order the rows come in, on the other by ``order``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.sql(text, **tables(spark, sf_dir, text))
        # partitions of a sorted frame are in order, and monotonic ids rise within and across them
        placed = rows.withColumn("tl_at", F.monotonically_increasing_id())
        return placed.select(*rows.columns, F.row_number().over(Window.orderBy("tl_at")).cast("bigint").alias("place"))

    QUERIES[name] = run
    plain = re.sub(r"\{(\w+)\}", r"\1", text)
    ORACLES[name] = f"SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({plain})"


def frame(name: str, duck: str | None):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = f
        if duck:
            ORACLES[name] = duck
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Flagship: scan, two equi-joins, filters, arithmetic, hash aggregate, top-k.
sql(
    "flagship",
    """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate > TIMESTAMP '1995-01-01 00:00:00'
GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)

# Scans, projections, filters
sql("scan_project", "SELECT o_orderkey, o_totalprice AS price FROM {orders}")
sql("scan_star", "SELECT * FROM {nation}")
sql("scan_qualified_star", "SELECT n.*, r_name FROM {nation} n JOIN {region} ON n_regionkey = r_regionkey")
sql("point_get", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_custkey = 7")
sql("capped_scan", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 25")
sql("derived_table", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY c_mktsegment) t WHERE n > 0")
sql("filter_3vl", "SELECT c_custkey FROM {customer} WHERE NOT (nullif(c_nationkey, 3) = 5 OR nullif(c_mktsegment, 'BUILDING') = 'MACHINERY')")
sql("filter_compare", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity >= 49 AND l_discount <> 0 AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00'")
sql("filter_null", "SELECT c_custkey, nullif(c_nationkey, 3) IS NULL AS gone FROM {customer} WHERE nullif(c_nationkey, 3) IS NULL OR nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
sql("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%'")
sql("filter_ilike", "SELECT p_partkey FROM {part} WHERE p_type ILIKE '%STEEL%' OR p_name ILIKE 'PART%'")
sql("filter_in", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
sql("filter_in_null", "SELECT o_orderkey FROM {orders} WHERE nullif(o_orderstatus, 'P') NOT IN ('F')")
sql("filter_between", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 11 AND l_discount NOT BETWEEN 0.02 AND 0.08")
sql("filter_expr", "SELECT o_orderkey FROM {orders} WHERE o_orderkey % 7 = 2 AND length(o_orderstatus) + 1 = 2")
sql("filter_distinct_from", "SELECT c_custkey FROM {customer} WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 4")
sql("filter_literal", "SELECT n_name FROM {nation} WHERE TRUE AND NOT FALSE")
sql("filter_regex", "SELECT p_partkey FROM {part} WHERE regexp_like(p_brand, '[13]$')", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[13]$')")
sql("fromless", "SELECT 1 AS a, 'x' AS b, 2 + 3 AS c")
sql("fromless_where", "SELECT 1 AS a WHERE 1 = 2 OR EXISTS (SELECT 1 FROM {region})")
sql("values_inline", "SELECT a, upper(b) AS b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS t(a, b)", "SELECT a, upper(b) AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")

# Expressions
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM {orders}")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status FROM {orders}")
sql("case_general", "SELECT sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) + count(*) AS n FROM {orders}", "SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) + count(*) AS BIGINT) AS n FROM orders")
sql("arith_int_div", "SELECT o_orderkey, o_orderkey div 7 AS q, -o_orderkey div 7 AS nq FROM {orders}", "SELECT o_orderkey, o_orderkey // 7 AS q, -o_orderkey // 7 AS nq FROM orders")
sql("arith_mod", "SELECT o_orderkey, o_orderkey % 7 AS m, -o_orderkey % 7 AS nm FROM {orders}")
sql("arith_safe_div", "SELECT c_custkey, round(try_divide(c_acctbal, CAST(c_nationkey AS DOUBLE)), 6) AS r FROM {customer}", "SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END, 6) AS r FROM customer")
sql("arith_overflow", "SELECT o_orderkey, try_multiply(o_orderkey, 9223372036854775807L) AS p FROM {orders}", "SELECT o_orderkey, CASE WHEN o_orderkey IN (0, 1) THEN o_orderkey * 9223372036854775807 END AS p FROM orders")
sql("unary", "SELECT c_custkey, -c_acctbal AS m, NOT (c_acctbal > 0) AS neg FROM {customer}")
sql("cast_round", "SELECT o_orderkey, CAST(bround(o_totalprice) AS BIGINT) AS r, CAST(o_orderkey AS STRING) AS s FROM {orders}", "SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS r, CAST(o_orderkey AS VARCHAR) AS s FROM orders")
sql("cast_bad_text", "SELECT c_custkey, try_cast(c_mktsegment AS INT) AS i, try_cast(substr(c_name, -3) AS INT) AS j FROM {customer}", "SELECT c_custkey, try_cast(c_mktsegment AS INT) AS i, try_cast(right(c_name, 3) AS INT) AS j FROM customer")
sql("concat_op", "SELECT c_custkey, c_name || '/' || nullif(c_mktsegment, 'BUILDING') AS s FROM {customer}")
sql("string_funcs", "SELECT c_custkey, concat_ws('', c_name, nullif(c_mktsegment, 'BUILDING'), '!') AS c, upper(c_name) AS u, lower(c_mktsegment) AS l, char_length(c_name) AS n, replace(c_name, '#', '-') AS r, substring(c_name, 2, 4) AS s FROM {customer}",
    "SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING'), '!') AS c, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name)::INT AS n, replace(c_name, '#', '-') AS r, substring(c_name, 2, 4) AS s FROM customer")
sql("trim_funcs", "SELECT n_nationkey, trim(BOTH 'A' FROM n_name) AS b, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') AS r, trim(LEADING 'NA' FROM n_name) AS f FROM {nation}", "SELECT n_nationkey, trim(n_name, 'A') AS b, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') AS r, ltrim(n_name, 'NA') AS f FROM nation")
sql("substring_from_for", "SELECT p_partkey, substring(p_name FROM 3 FOR 2) AS s FROM {part}")
sql("coalesce_nullif", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS k, nullif(c_mktsegment, 'BUILDING') AS s FROM {customer}")
sql("math_funcs", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, round(c_acctbal, 1) AS r1 FROM {customer}")
sql("date_extract", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d FROM {orders}")
sql("time_extract", "SELECT event_id, CAST(extract(HOUR FROM ts) AS BIGINT) AS h, CAST(extract(MINUTE FROM ts) AS BIGINT) AS m, CAST(floor(extract(SECOND FROM ts)) AS BIGINT) AS s FROM {events}", "SELECT event_id, extract(HOUR FROM ts) AS h, extract(MINUTE FROM ts) AS m, extract(SECOND FROM ts) AS s FROM events")
sql("date_trunc_month", "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS m FROM {orders}", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m FROM orders")
sql("date_plus_interval", "SELECT o_orderkey, add_months(CAST(o_orderdate AS DATE), 1) AS m, CAST(o_orderdate AS DATE) + INTERVAL 10 DAYS AS d, o_orderdate + INTERVAL 3 HOURS AS h FROM {orders}", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS d, o_orderdate + INTERVAL 3 HOUR AS h FROM orders")
sql("date_compare", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '1996-02-29' AND o_orderdate < DATE '1996-02-29' + INTERVAL 1 YEAR")
sql("date_diff", "SELECT l_orderkey, l_linenumber, datediff(l_shipdate, o_orderdate) AS days FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey", "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS INT) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")

# Joins
sql("join_inner", "SELECT c_name, o_orderkey FROM {customer} JOIN {orders} ON c_custkey = o_custkey WHERE o_totalprice > 250000")
sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN (SELECT * FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice > 200000) o ON c_custkey = o_custkey")
sql("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice > 200000) o RIGHT JOIN {customer} ON c_custkey = o_custkey")


@frame("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_nationkey < 12) s FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 8) c ON s_nationkey = c_nationkey")
def join_full(spark, sf_dir):
    # few keys with very many rows each
    suppliers = read(spark, sf_dir, "supplier").where("s_nationkey < 12").select("s_suppkey", "s_nationkey")
    customers = read(spark, sf_dir, "customer").where("c_nationkey > 8").select("c_custkey", "c_nationkey")
    return relational.full_join(suppliers, customers, ["s_nationkey"], ["c_nationkey"]).select("s_suppkey", "c_custkey")


sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_comma", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
sql("join_using", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a JOIN (SELECT nullif(s_nationkey, 3) AS k, s_name FROM {supplier}) b USING (k)")
sql("join_natural", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM {supplier}) b")
sql("join_theta", "SELECT a.n_name AS one, b.n_name AS two FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_self", "SELECT a.o_orderkey AS one, b.o_orderkey AS two FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderstatus = 'P' AND b.o_orderstatus = 'P'")
sql("join_derived", "SELECT c_custkey, n FROM {customer} JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey")
sql("join_lateral_series", "SELECT n_nationkey, i FROM {nation}, LATERAL explode(sequence(1, n_regionkey + 1)) AS t(i)", "SELECT n_nationkey, i::INT AS i FROM nation, LATERAL (SELECT unnest(range(1, n_regionkey + 2)) AS i)")
sql("join_lateral_left", "SELECT n_nationkey, i FROM {nation} LATERAL VIEW OUTER explode(CASE WHEN n_regionkey > 0 THEN sequence(1, n_regionkey) ELSE CAST(array() AS ARRAY<INT>) END) t AS i", "SELECT n_nationkey, i::INT AS i FROM nation LEFT JOIN LATERAL (SELECT unnest(range(1, n_regionkey + 1)) AS i) ON true")
sql("semi_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
sql("anti_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
sql("in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)")
sql("not_in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)")
sql("not_in_subquery_null", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM {nation})")
sql("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
sql("corr_scalar_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql("select_list_subquery", "SELECT r_name, (SELECT count(*) FROM {nation} n WHERE n.n_regionkey = r.r_regionkey) AS nations FROM {region} r")

# Aggregation
sql("agg_global", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'P')) AS k, min(o_totalprice) AS lo, max(o_orderdate) AS hi, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total FROM {orders}")
sql("agg_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("agg_expr", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM {lineitem} GROUP BY l_returnflag")
sql("expr_over_agg", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*) * 2, 4) AS twice FROM {orders} GROUP BY o_orderstatus")
sql("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderstatus) AS m FROM {orders} WHERE o_orderkey < 0")
sql("agg_group_null", "SELECT nullif(c_nationkey, 3) AS k, count(*) AS n, count(nullif(c_mktsegment, 'BUILDING')) AS m FROM {customer} GROUP BY nullif(c_nationkey, 3)")
sql("agg_int_sum", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s, min(p_name) AS a, max(p_name) AS z FROM {part} GROUP BY p_brand")
sql("having_basic", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND NOT (min(o_totalprice) > 100000) AND avg(o_totalprice) > 1000")
sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM {orders} GROUP BY o_orderstatus")
sql("agg_filter", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS o FROM {orders}")
sql("group_by_expression", "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM {orders} GROUP BY 1")
sql("bool_aggs", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 300000) AS o FROM {orders} GROUP BY o_orderstatus")
sql("stddev_agg", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS s, round(var_pop(c_acctbal), 2) AS v FROM {customer} GROUP BY c_mktsegment")

# Windows
W_ORDER = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("win_row_number", f"SELECT o_orderkey, CAST(row_number() OVER {W_ORDER}) AS BIGINT) AS rn FROM {{orders}}")
sql("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r FROM {part}")
sql("win_dense_rank", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r FROM {part}")
sql("win_lag", f"SELECT o_orderkey, lag(o_totalprice) OVER {W_ORDER}) AS p, lag(o_totalprice, 2, -1.0D) OVER {W_ORDER}) AS p2 FROM {{orders}}", f"SELECT o_orderkey, lag(o_totalprice) OVER {W_ORDER}) AS p, lag(o_totalprice, 2, -1.0) OVER {W_ORDER}) AS p2 FROM orders")
sql("win_lead", f"SELECT o_orderkey, lead(o_totalprice) OVER {W_ORDER}) AS p FROM {{orders}}")
sql("win_ntile", f"SELECT o_orderkey, CAST(ntile(3) OVER {W_ORDER}) AS BIGINT) AS t FROM {{orders}}")
sql("win_first_last", f"SELECT o_orderkey, first_value(o_totalprice) OVER {W_ORDER}) AS f, last_value(o_totalprice) OVER {W_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {{orders}}")
sql("win_nth_value", f"SELECT o_orderkey, nth_value(o_totalprice, 2) OVER {W_ORDER}) AS v FROM {{orders}}")
sql("win_partition_agg", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM {orders}")
sql("win_rows_running", f"SELECT o_orderkey, round(sum(o_totalprice) OVER {W_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM {{orders}}")
sql("win_rows_moving", f"SELECT o_orderkey, round(avg(o_totalprice) OVER {W_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 5) AS a FROM {{orders}}")
sql("win_rows_centered", f"SELECT o_orderkey, min(o_totalprice) OVER {W_ORDER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM {{orders}}")
sql("win_range_peers", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {part}")
sql("win_range_offset", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM {part}")
sql("win_default_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM {part}")
sql("win_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS c FROM {part}")


@frame("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part")
def win_groups_frame(spark, sf_dir):
    return relational.groups_frame(read(spark, sf_dir, "part"), ["p_brand"], ["p_size"], F.count(F.lit(1)), "n", -1, 0).select("p_partkey", "n")


# Order, limits, set operations, common table expressions
# whole results in order: the place that each row has is what is compared
ordered("order_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer} ORDER BY k ASC NULLS FIRST, c_custkey DESC", "k ASC NULLS FIRST, c_custkey DESC")
ordered("order_nulls_last", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer} ORDER BY k DESC NULLS LAST, c_custkey", "k DESC NULLS LAST, c_custkey")
sql("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 20")
sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
ordered("order_by_aggregate", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey", "n DESC, o_custkey")
sql("union", "SELECT s_nationkey AS k FROM {supplier} UNION SELECT c_nationkey FROM {customer}")
sql("union_all", "SELECT s_nationkey AS k FROM {supplier} UNION ALL SELECT c_nationkey FROM {customer}")
sql("intersect", "SELECT s_nationkey AS k FROM {supplier} INTERSECT SELECT c_nationkey FROM {customer}")
sql("intersect_all", "SELECT s_nationkey AS k FROM {supplier} INTERSECT ALL SELECT c_nationkey FROM {customer}")
sql("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier}")
sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
ordered("setop_ordered", "(SELECT s_nationkey AS k FROM {supplier} UNION ALL SELECT n_nationkey FROM {nation}) ORDER BY k DESC", "k DESC")
sql("cte", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN {customer} ON c_custkey = o_custkey")
sql("cte_nested", "WITH a AS (WITH b AS (SELECT n_regionkey AS r FROM {nation}) SELECT r, count(*) AS n FROM b GROUP BY r) SELECT r_name, n FROM a JOIN {region} ON r = r_regionkey")
sql("cte_columns", "WITH a(x, y) AS (SELECT r_regionkey, r_name FROM {region}) SELECT x + 1 AS x, y FROM a")
sql("recursive_all", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t")


@frame("recursive_union", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r AS (SELECT 0 AS node UNION SELECT b FROM r JOIN e ON a = node) SELECT node FROM r")
def recursive_union(spark, sf_dir):
    edges = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.expr("(n_nationkey * 7 + 3) % 25").alias("b"))
    seed = spark.range(1).select(F.lit(0).alias("node"))
    return relational.recursive_union(seed, lambda new: new.join(edges, new.node == edges.a).select(F.col("b").alias("node")))


@frame("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return relational.distinct_on(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


# JSON, arrays, table functions
sql("json_extract_text", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, props->>'$.k' AS k FROM events")
sql("json_filter", "SELECT event_id FROM {events} WHERE CAST(get_json_object(props, '$.k') AS INT) > 90", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) > 90")
sql("json_object_field", "SELECT event_id, to_json(from_json(props, 'struct<k:int>')) AS j FROM {events}", "SELECT event_id, CAST(json_object('k', CAST(props->>'$.k' AS INT)) AS VARCHAR) AS j FROM events")
sql("array_contains", "SELECT vec_id FROM {embeddings} WHERE size(array_except(array(round(embedding[0], 0)), transform(slice(embedding, 1, 4), x -> round(x, 0)))) = 0", "SELECT vec_id FROM embeddings WHERE list_has_all(list_transform(embedding[1:4], lambda x: round(x, 0)), [round(embedding[1], 0)])")
sql("array_contained_by", "SELECT n_nationkey FROM {nation} WHERE size(array_except(array(n_regionkey, 1), array(0, 1, 2))) = 0", "SELECT n_nationkey FROM nation WHERE list_has_all([0, 1, 2], [n_regionkey, 1])")
sql("array_literal", "SELECT n_nationkey, size(array(n_nationkey, n_regionkey)) AS n, element_at(array(n_name, 'x'), 1) AS f FROM {nation}", "SELECT n_nationkey, CAST(len([n_nationkey, n_regionkey]) AS INT) AS n, [n_name, 'x'][1] AS f FROM nation")
sql("unnest", "SELECT vec_id, v FROM {embeddings} LATERAL VIEW explode(slice(embedding, 1, 3)) t AS v", "SELECT vec_id, unnest(embedding[1:3]) AS v FROM embeddings")
sql("unnest_multi", "SELECT a, b FROM (SELECT inline(arrays_zip(a, b)) FROM (SELECT array(1, 2, 3) AS a, array('x', 'y') AS b))", "SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b")
sql("unnest_ordinality", "SELECT vec_id, CAST(i + 1 AS BIGINT) AS ord, v FROM {embeddings} LATERAL VIEW posexplode(slice(embedding, 1, 3)) t AS i, v", "SELECT vec_id, unnest([1, 2, 3])::BIGINT AS ord, unnest(embedding[1:3]) AS v FROM embeddings")
sql("json_array_elements", "SELECT i, e FROM (SELECT 1 AS i, '[1,\"a\",{\"b\":2}]' AS j) LATERAL VIEW explode(from_json(j, 'array<string>')) t AS e", "SELECT 1 AS i, unnest(['1', 'a', '{\"b\":2}']) AS e")
sql("regexp_split", "SELECT p_partkey, w FROM {part} LATERAL VIEW explode(split(p_name, '[ #]')) t AS w", "SELECT p_partkey, unnest(regexp_split_to_array(p_name, '[ #]')) AS w FROM part")


@frame("series", "SELECT i FROM generate_series(1, 10, 3) t(i) UNION ALL SELECT i FROM generate_series(5, 1) t(i)")
def series(spark, sf_dir):
    one = spark.range(1)
    both = [one.select(F.explode(pg.generate_series(*(F.lit(x).cast("bigint") for x in bounds))).alias("i")) for bounds in ((1, 10, 3), (5, 1, 1))]
    return both[0].union(both[1])


def _unit(n: str, unit: str) -> str:
    return f"CASE WHEN {n} <> 0 THEN {n} || ' {unit}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END END"


@frame(
    "age",
    "SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(' ', " + ", ".join(_unit(f"extract({k} FROM i)", u) for k, u in (("YEAR", "year"), ("MONTH", "mon"), ("DAY", "day"))) + "), ''), '00:00:00') AS age"
    " FROM (SELECT l_orderkey, l_linenumber, age(l_shipdate, o_orderdate) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
)
def age(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.select("l_orderkey", "l_linenumber", pg.age(F.col("l_shipdate"), F.col("o_orderdate")).alias("age"))


@frame("substr_clamped", "SELECT p_partkey, substring(p_name, 1, 3) AS s FROM part")
def substr_clamped(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", pg.substr(F.col("p_name"), F.lit(-2), F.lit(3)).alias("s"))


# Beyond the reference: event-time windows of a bounded stream
@frame("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from ..streaming.windows import tumbling

    return tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
