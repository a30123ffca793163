"""Relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliodor.queries import load, query


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def region_revenue(spark, sf_dir):
    lines, orders, customers, nations, regions = load(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    places = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    sold = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey).join(places, customers.c_nationkey == places.n_nationkey)
    return sold.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def line_cube(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995)")
def customers_without_orders(spark, sf_dir):
    """Customers without an order in 1995."""
    customers, orders = load(spark, sf_dir, "customer", "orders")
    placed = orders.where(F.year("o_orderdate") == 1995)
    return customers.join(placed, customers.c_custkey == placed.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_intersect(spark, sf_dir):
    customers, orders = load(spark, sf_dir, "customer", "orders")
    return customers.where("c_acctbal > 0").select("c_custkey").intersect(orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT l_suppkey % 50 AS k FROM lineitem EXCEPT ALL SELECT l_partkey % 50 FROM lineitem")
def set_except_all(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_suppkey") % 50).alias("k")).exceptAll(lines.select((F.col("l_partkey") % 50).alias("k")))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT n_name, coalesce(count(s_suppkey), 0) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def left_join_default(spark, sf_dir):
    nations, suppliers = load(spark, sf_dir, "nation", "supplier")
    return nations.join(suppliers, nations.n_nationkey == suppliers.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1")
def distinct_users(spark, sf_dir):
    """Distinct users of each event type, and whether the approximate count is within 5 % of them."""
    users, about = F.count("user_id"), F.approx_count_distinct("user_id", 0.02)
    # Counted over distinct pairs: beside count_distinct, each pair would carry a sketch of 3 kB through the shuffle.
    pairs = load(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    return pairs.groupBy("event_type").agg(users.alias("users"), (F.abs(about - users) <= 0.05 * users).alias("near"))
