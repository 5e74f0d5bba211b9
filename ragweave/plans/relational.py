"""Relational queries beside the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragweave.plans.registry import query, table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def relational_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def relational_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("""SELECT l_returnflag, l_suppkey, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_suppkey)""")
def relational_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_suppkey), ())""")
def relational_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"]
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_suppkey")], []]
    return rows.groupingSets(sets, *keys).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders)
    SELECT o_custkey, o_orderkey, ntile(4) OVER w::INTEGER AS quarter, rank() OVER p::INTEGER AS price_rank, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running,
    round(avg(o_totalprice) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS near FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def relational_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters, ranks, running totals and moving means of each customer's orders."""
    line, price = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    running = F.sum("o_totalprice").over(line.rowsBetween(Window.unboundedPreceding, 0))
    near = F.avg("o_totalprice").over(line.rowsBetween(-1, 1))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ntile(4).over(line).alias("quarter"), F.rank().over(price).alias("price_rank"), F.round(running, 2).alias("running"), F.round(near, 4).alias("near"))


@query("SELECT n_name, true AS near FROM nation")
def relational_distinct_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each nation's sketched number of customers is within a twentieth of the exact one."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "right")
    counts = customers.groupBy("n_name").agg(F.hll_sketch_estimate(F.hll_sketch_agg("c_custkey", 14)).alias("estimate"), F.countDistinct("c_custkey").alias("exact"))
    return counts.select("n_name", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("""SELECT doc_id FROM documents ORDER BY md5(concat(doc_id, ':17')), doc_id LIMIT 50""")
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by the order of a seeded hash: the same for every run and partitioning."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":17")).cast("binary")), "doc_id").limit(50)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred rows of a catalogue."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")
