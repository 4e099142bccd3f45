"""The query shapes a statement corpus sends to the engine, as DataFrame plans.

``SQL`` holds the same statements as text; they are the gold statements of the
pair corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmatch.plans.workload import Table

FIRST_YEAR, MONTHS = 1995, 84

SQL = {
    "q_filter_project": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'",
    "q_scalar_agg": "SELECT count(*) AS n, round(avg(c_acctbal), 4) AS avg_acctbal FROM customer WHERE c_acctbal > 0",
    "q_group_agg": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, "
        "round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_tax) AS max_tax "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus"
    ),
    "q_join_having": (
        "SELECT c_name, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey "
        "GROUP BY c_name HAVING sum(o_totalprice) > 3000000"
    ),
    "q_multi_join": (
        "SELECT c.c_name, n.n_name, r.r_name FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey "
        "JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 5000"
    ),
    "q_comma_join": (
        "SELECT o.o_orderkey, c.c_name FROM orders AS o, customer AS c "
        "WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000"
    ),
    "q_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "q_order_by": "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey",
    "q_in_subquery": (
        "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"
    ),
    "q_not_in_subquery": (
        "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN "
        "(SELECT l_partkey FROM lineitem WHERE l_quantity > 40)"
    ),
    "q_union": "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
    "q_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "q_intersect": "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "q_cte": (
        "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) "
        "SELECT o_custkey, round(total, 2) AS total FROM spend WHERE total > 2500000"
    ),
    "q_recursive_cte": (
        "WITH RECURSIVE cal(m) AS (SELECT 0 UNION ALL SELECT m + 1 FROM cal WHERE m < 83), "
        "placed AS (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS m, count(*) AS n "
        "FROM orders GROUP BY 1) "
        "SELECT cal.m AS month_no, coalesce(placed.n, 0) AS n FROM cal LEFT JOIN placed ON cal.m = placed.m"
    ),
    "q_cross_join": (
        "WITH segment AS (SELECT c_mktsegment, count(*) AS in_segment FROM customer GROUP BY c_mktsegment), "
        "place AS (SELECT c_nationkey, count(*) AS in_nation FROM customer GROUP BY c_nationkey) "
        "SELECT c_mktsegment, c_nationkey, in_segment, in_nation FROM segment CROSS JOIN place"
    ),
    "q_correlated": (
        "SELECT o.o_orderkey, o.o_totalprice FROM orders AS o WHERE o.o_totalprice > "
        "(SELECT 1.5 * avg(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)"
    ),
    "q_and_or_predicates": (
        "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem "
        "WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_discount >= 0.09)"
    ),
}


def q_filter_project(t: Table) -> DataFrame:
    return t("customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


def q_scalar_agg(t: Table) -> DataFrame:
    kept = t("customer").where(F.col("c_acctbal") > 0)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_acctbal"))


def q_group_agg(t: Table) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_tax").alias("max_tax"),
    )


def q_join_having(t: Table) -> DataFrame:
    """Orders are summed per customer before the join, so a customer with very many
    orders is one line in it."""
    spent = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("part"))
    joined = t("customer").join(spent, F.col("c_custkey") == F.col("o_custkey"))
    by_name = joined.groupBy("c_name").agg(F.sum("part").alias("spent"))
    return by_name.where(F.col("spent") > 3000000).select("c_name", F.round("spent", 2).alias("spent"))


def q_multi_join(t: Table) -> DataFrame:
    rich = t("customer").where(F.col("c_acctbal") > 5000)
    return (
        rich.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_name", "n_name", "r_name")
    )


def q_comma_join(t: Table) -> DataFrame:
    """The text names two tables and a WHERE; the optimizer makes an equi join of it."""
    orders, customer = t("orders"), t("customer")
    return orders.sparkSession.sql(
        "SELECT o.o_orderkey, c.c_name FROM {orders} AS o, {customer} AS c "
        "WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000",
        orders=orders,
        customer=customer,
    )


def q_top_k(t: Table) -> DataFrame:
    return (
        t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    )


def q_order_by(t: Table) -> DataFrame:
    return t("supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


def q_in_subquery(t: Table) -> DataFrame:
    """The list is made distinct on the map side before it is probed."""
    big = t("orders").where(F.col("o_totalprice") > 450000).select("o_custkey").distinct()
    return t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_name")


def not_in(left: DataFrame, key: str, listed: DataFrame, item: str) -> DataFrame:
    """``key NOT IN (SELECT item …)`` with SQL's three-valued meaning, as one lazy plan.

    The planner would broadcast the list, whatever its size, to test it for nulls.
    Here the join is an ordinary anti join with a distinct list, and a scalar subquery
    counts the list's rows and nulls: a null in the list removes every row, and a null
    key passes only an empty list.
    """
    counts = F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(item).isNull()).alias("nulls"))
    found = listed.agg(counts.alias("found")).scalar()
    values = listed.where(F.col(item).isNotNull()).select(F.col(item).alias("_v")).distinct()
    kept = left.join(values, F.col(key) == F.col("_v"), "left_anti")
    return kept.where((found["rows"] == 0) | ((found["nulls"] == 0) & F.col(key).isNotNull()))


def q_not_in_subquery(t: Table) -> DataFrame:
    used = t("lineitem").where(F.col("l_quantity") > 40)
    return not_in(t("part").select("p_partkey", "p_name"), "p_partkey", used, "l_partkey")


def q_union(t: Table) -> DataFrame:
    a = t("customer").select(F.col("c_nationkey").alias("nationkey"))
    return a.union(t("supplier").select("s_nationkey")).distinct()


def q_except(t: Table) -> DataFrame:
    done = t("orders").where(F.col("o_orderstatus") == "F").select("o_custkey").distinct()
    return t("customer").select("c_custkey").subtract(done)


def q_intersect(t: Table) -> DataFrame:
    a = t("customer").select(F.col("c_nationkey").alias("nationkey")).distinct()
    return a.intersect(t("supplier").select("s_nationkey").distinct())


def q_cte(t: Table) -> DataFrame:
    spend = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return spend.where(F.col("total") > 2500000).select("o_custkey", F.round("total", 2).alias("total"))


def q_recursive_cte(t: Table) -> DataFrame:
    """A recursive counter fills the calendar; orders are counted before they meet it."""
    orders = t("orders").select("o_orderdate")
    calendar = orders.sparkSession.sql(
        f"WITH RECURSIVE cal(m) AS (SELECT 0 UNION ALL SELECT m + 1 FROM cal WHERE m < {MONTHS - 1}) "
        "SELECT m FROM cal"
    )
    month = (F.year("o_orderdate") - FIRST_YEAR) * 12 + F.month("o_orderdate") - 1
    placed = orders.groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(placed, "m", "left").select(
        F.col("m").alias("month_no"), F.coalesce("n", F.lit(0)).alias("n")
    )


def q_cross_join(t: Table) -> DataFrame:
    """Both sides are group counts: as many lines as segments and as nations."""
    segment = t("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("in_segment"))
    place = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("in_nation"))
    return segment.crossJoin(place).select("c_mktsegment", "c_nationkey", "in_segment", "in_nation")


def q_correlated(t: Table) -> DataFrame:
    """The subquery becomes an aggregate per customer and a join with it."""
    orders = t("orders")
    return orders.sparkSession.sql(
        "SELECT o.o_orderkey, o.o_totalprice FROM {orders} AS o WHERE o.o_totalprice > "
        "(SELECT 1.5 * avg(i.o_totalprice) FROM {orders} AS i WHERE i.o_custkey = o.o_custkey)",
        orders=orders,
    )


def q_and_or_predicates(t: Table) -> DataFrame:
    kept = (F.col("l_quantity") > 45) & ((F.col("l_returnflag") == "R") | (F.col("l_discount") >= 0.09))
    return t("lineitem").where(kept).select("l_orderkey", "l_partkey", "l_quantity")


SHAPES = {name: globals()[name] for name in SQL}
