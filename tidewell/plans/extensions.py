"""Native primitives beyond the parity set, over the star schema."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.plans.registry import query, table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '2000-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (1, 2)")
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT n.n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation n ON n.n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey = 1 GROUP BY 1""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region").filter("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    rows = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT user_id, event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts <= e.ts) AS last_click
FROM events e WHERE event_type = 'purchase'""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it, in one sorted pass."""
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").withColumn("last_click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return e.filter("event_type = 'purchase'").select("user_id", "event_id", "last_click")


@query("""SELECT e.event_type, p.phase, count(*) AS n FROM events e JOIN (VALUES ('baseline', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10'), ('fault', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20'),
('recovery', TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-01')) p(phase, lo, hi) ON e.ts >= p.lo AND e.ts < p.hi GROUP BY 1, 2""")
def phase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of an experiment are three literals, so the interval join is a projection."""
    day = F.col("ts").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    phase = F.when(day < at("2024-01-01"), None).when(day < at("2024-01-10"), "baseline").when(day < at("2024-01-20"), "fault").when(day < at("2024-02-01"), "recovery")
    return table(spark, sf_dir, "events").withColumn("phase", phase).filter("phase is not null").groupBy("event_type", "phase").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long") * F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
