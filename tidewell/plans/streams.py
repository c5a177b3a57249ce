"""Streams over the files of a table, drained and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.streaming import lifecycle, run, windows

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("SELECT event_id, user_id FROM events")
def dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event delivered twice has one effect."""
    e = run.parquet_stream(spark, sf_dir, "events")
    twice = windows.event_time(e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"))
    return run.drained(windows.deduplicated(twice, ["event_id"])).select("event_id", "user_id")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = windows.event_time(run.parquet_stream(spark, sf_dir, "events"))
    out = run.drained(windows.tumbling(e, "1 hour", ["event_type"]), "complete")
    return out.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n")


_FOLD = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'ready' ELSE 'fail' END AS action,
  row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type <> 'view'),
f AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS us, '' AS action, '' AS before, '' AS after, 0 AS attempts, CAST(0 AS BIGINT) AS started, true AS accepted FROM e UNION ALL
  SELECT id, n, us, action, before, CASE WHEN NOT accepted THEN before WHEN action = 'create' THEN 'PENDING' WHEN action = 'claim' THEN 'PROCESSING' WHEN action = 'ready' THEN 'READY' ELSE 'FAILED' END,
    attempts + CASE WHEN accepted AND action = 'claim' THEN 1 ELSE 0 END, CASE WHEN accepted AND action = 'claim' THEN us // 1000 ELSE started END, accepted
  FROM (SELECT e.*, f.after AS before, f.attempts, f.started, CASE e.action WHEN 'create' THEN f.after = '' WHEN 'claim' THEN f.after IN ('PENDING', 'FAILED') OR f.after = 'PROCESSING' AND f.started < e.us // 1000 - 600000 ELSE f.after = 'PROCESSING' END AS accepted
    FROM f JOIN e ON e.id = f.id AND e.n = f.n + 1))
SELECT id, us AS at, action, before, after, CAST(attempts AS INTEGER) AS attempts, accepted FROM f WHERE n > 0"""


@query(_FOLD)
def stateful_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are documents; signups create, clicks claim, purchases and errors end them."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        e = run.parquet_stream(spark, sf_dir, "events")
        action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "fail")
        rows = e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action")).filter("action is not null")
        return run.drained(lifecycle.lifecycle(rows)).select("id", F.unix_micros("ts").alias("at"), "action", "before", "after", "attempts", "accepted")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
