"""Plain relational queries over the star schema and the event stream: companions, not memory operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrama.sources import tables as T

from .registry import query


@query("rel_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, sf):
    line = T.raw(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    orders = T.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    j = line.join(orders, "l_orderkey").join(T.raw(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return j.groupBy("c_nationkey").agg(F.sum("r").alias("r")).join(T.raw(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("rel_top_orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark, sf):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return T.raw(spark, sf, "orders").withColumn("r", r).where(F.col("r") <= 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("rel_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return T.raw(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("rel_customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf):
    return T.raw(spark, sf, "customer").join(T.raw(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("rel_asof_view", """e AS (SELECT event_id, user_id, ts, event_type FROM events) SELECT p.event_id, (SELECT max(v.event_id) FROM e v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.event_id < p.event_id) AS view_id FROM e p WHERE p.event_type = 'purchase'""")
def asof_view(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = T.raw(spark, sf, "events").select("event_id", "user_id", "event_type", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w).alias("view_id"))
    return e.where("event_type = 'purchase'").select("event_id", "view_id")


@query("rel_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly(spark, sf):
    return T.raw(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("rel_set_ops", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_ops(spark, sf):
    o = T.raw(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").selectExpr("o_custkey as k").intersect(o.where("o_orderstatus = 'O'").selectExpr("o_custkey")).exceptAll(T.raw(spark, sf, "customer").where("c_acctbal < 0").selectExpr("c_custkey")).distinct()
