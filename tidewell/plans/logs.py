"""Log analytics over events rendered as JSON lines: a view has no message, so its line can't be parsed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import logs
from tidewell.plans.registry import query, table

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'DEBUG' END"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "click", "INFO").when(F.col("event_type") == "signup", "DEBUG")
    line = F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), level.alias("level"), F.when(level.isNotNull(), F.concat(F.lit("user "), F.col("user_id"))).alias("msg"), F.col("user_id").cast("string").alias("user"))
    return e.select(F.col("event_id").alias("line_no"), F.col("event_type"), F.to_json(line).alias("raw"))


@query("SELECT event_type, count(*) AS lines, count(*) FILTER (WHERE event_type <> 'view') AS parsed FROM events GROUP BY 1")
def log_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(log_lines(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("lines"), F.count_if("parse_ok").alias("parsed"))


@query(f"SELECT {_LEVEL} AS level, CAST(extract('day' FROM ts) AS INTEGER) AS day, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def log_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(log_lines(spark, sf_dir)).filter("parse_ok").groupBy("level", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n"))


@query(f"""SELECT event_id AS line_no, {_LEVEL} AS level, 'user ' || user_id AS msg FROM events
WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND contains(CAST(user_id AS VARCHAR), '7') ORDER BY event_id DESC LIMIT 200""")
def log_filter_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = logs.parse_lines(log_lines(spark, sf_dir))
    some = logs.matching(records, "WARN", F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).filter(F.contains(F.col("attrs")["user"], F.lit("7")))
    return logs.tail(some, 200).select("line_no", "level", "msg")


@query("SELECT count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS matched, count(*) FILTER (WHERE event_type = 'view') AS unparseable FROM events")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.counts(logs.parse_lines(log_lines(spark, sf_dir)), F.col("level_no") >= 2)


@query(f"""SELECT event_id AS line_no, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || {_LEVEL} || ' user ' || user_id || ' user=' || user_id AS line FROM events WHERE event_type <> 'view'""")
def log_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(log_lines(spark, sf_dir)).filter("parse_ok").select("line_no", T.render_record("ts", "level", "msg", "attrs").alias("line"))
