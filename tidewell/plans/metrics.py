"""Time-series queries over events: event types are metrics, users are series."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import metrics
from tidewell.operators.promql import TASK_SAMPLES
from tidewell.operators.store import dealt_out
from tidewell.plans.registry import query, table
from tidewell.streaming import windows

_US = "epoch_us({})"
_FIVE = "time_bucket(INTERVAL '5 minutes', ts)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def by_series(rows: DataFrame) -> DataFrame:
    return dealt_out(rows, rows.count(), TASK_SAMPLES, "user_id", "event_type")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per user and type that grows by each value and starts anew after every tenth event."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts")
    s = by_series(samples(spark, sf_dir)).withColumn("life", F.floor((F.row_number().over(w) - 1) / 10))
    grown = F.sum("value").over(Window.partitionBy("user_id", "event_type", "life").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("value", F.round(grown, 2)).drop("life")


_COUNTERS = """e AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) - 1) // 10 AS life FROM events),
c AS (SELECT user_id, event_type, ts, event_id, round(sum(value) OVER (PARTITION BY user_id, event_type, life ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS value FROM e),
p AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM c),
d AS (SELECT *, CASE WHEN value - before < 0 THEN value ELSE value - before END AS delta FROM p)"""


@query("""SELECT event_type, count(*) AS points, min(value) AS min, epoch_us(arg_min(ts, (value, ts))) AS min_at, max(value) AS max, epoch_us(arg_min(ts, (-value, ts))) AS max_at,
  round(avg(value), 6) AS mean, arg_max(value, ts) AS last FROM events GROUP BY 1""")
def series_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.describe(samples(spark, sf_dir), ["event_type"])
    return d.select("event_type", "points", "min", F.unix_micros("min_at").alias("min_at"), "max", F.unix_micros("max_at").alias("max_at"), F.round("mean", 6).alias("mean"), "last")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 20 OR EXISTS (SELECT 1 FROM range(20) t(j) WHERE j * (n - 1) // 19 = i)""")
def series_sample20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sample(samples(spark, sf_dir), ["user_id"]).select("user_id", "event_id")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(samples(spark, sf_dir), ["event_type"], 50, 95, 99)


_STATUS = "CASE WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 0 ELSE 504 END ELSE 201 END"


@query(f"""SELECT user_id, string_agg(CASE WHEN status = 0 THEN 'none' ELSE CAST(status AS VARCHAR) END || '×' || n, ' ' ORDER BY status) AS summary
FROM (SELECT user_id, {_STATUS} AS status, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") > 100, 0).otherwise(504)).otherwise(201)
    return metrics.status_summary(samples(spark, sf_dir).withColumn("status", status), ["user_id"])


@query("""WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS day, event_type, user_id FROM events), g AS (SELECT day, count(*) AS series, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS names FROM s GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, series, series > 50 AS refused, CASE WHEN series > 50 THEN names END AS names FROM g""")
def capped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's series are user and type; over fifty are refused with the names there are."""
    s = samples(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return metrics.series_caps(s, ["day"], ["event_type", "user_id"], "event_type")


@query("""WITH w AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS s, CASE WHEN event_id % 7 <> 0 THEN ts + to_minutes(CAST(event_id % 600 - 60 AS INTEGER)) END AS e FROM events)
SELECT event_id, CASE WHEN (s IS NULL) <> (e IS NULL) THEN 'together' WHEN e <= s THEN 'order' WHEN e - s > INTERVAL 6 HOUR THEN 'range' END AS problem FROM w""")
def checked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples(spark, sf_dir)
    start = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    end = F.when(F.col("event_id") % 7 != 0, F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 600 - 60) * 60_000_000))
    return e.select("event_id", metrics.window_problem(start, end).alias("problem"))


@query("""SELECT user_id, event_type, round(sum(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), 4) AS d_value FROM events GROUP BY 1, 2
HAVING count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') > 0""")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals at the end less totals on the 16th, without correction."""
    s = samples(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp")
    total = lambda rows: rows.groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    changed = s.filter(F.col("ts") >= cut).select("user_id", "event_type").distinct()
    return metrics.snapshot_delta(total(s.filter(F.col("ts") < cut)), total(s), ["user_id", "event_type"]).join(changed, ["user_id", "event_type"]).select("user_id", "event_type", F.round("d_value", 4).alias("d_value"))


@query("""SELECT event_type, count(*) FILTER (WHERE late) AS d_count, round(sum(value) FILTER (WHERE late), 4) AS d_sum, round(avg(value) FILTER (WHERE late), 6) AS mean
FROM (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM events) GROUP BY 1""")
def histogram_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    shot = lambda rows: rows.groupBy("event_type").agg(F.sum("value").alias("sum"), F.count("*").alias("count"))
    d = metrics.snapshot_delta(shot(s.filter("ts < timestamp '2024-01-16'")), shot(s), ["event_type"])
    return d.select("event_type", "d_count", F.round("d_sum", 4).alias("d_sum"), F.round("mean", 6).alias("mean"))


@query("SELECT count(*) AS requests FROM events WHERE user_id = 7 AND event_type = 'error' AND ts >= TIMESTAMP '2024-01-16'")
def status_class_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select(F.col("user_id").cast("string").alias("service"), F.lit("/").alias("route"), F.when(F.col("event_type") == "error", "503").otherwise("200").alias("status"), "ts")
    shot = lambda rows: rows.groupBy("service", "route", "status").agg(F.count("*").alias("value"))
    return metrics.requests_by_class(shot(s.filter("ts < timestamp '2024-01-16'")), shot(s), "7", "5").select(F.col("requests").cast("long").alias("requests"))


@query(f"WITH {_COUNTERS} SELECT epoch_us({_FIVE}) AS window_start, event_type, round(coalesce(sum(delta), 0) / 300, 6) AS rate FROM d GROUP BY 1, 2")
def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.rate(counters(spark, sf_dir), ["user_id", "event_type"], ["event_type"], 300)
    return r.select(F.unix_micros("window_start").alias("window_start"), "event_type", F.round("rate", 6).alias("rate"))


@query(f"WITH {_COUNTERS} SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start, event_type, round(coalesce(sum(delta), 0), 2) AS increase FROM d GROUP BY 1, 2")
def increase_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.increase(counters(spark, sf_dir), ["user_id", "event_type"], ["event_type"], "1 day")
    return r.select(F.unix_micros("window_start").alias("window_start"), "event_type", F.round("increase", 2).alias("increase"))


_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


@query("""SELECT event_type, b.le, count(*) FILTER (WHERE value <= b.bound) AS count FROM events,
(VALUES ('1.0', 1.0), ('5.0', 5.0), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('500.0', 500.0), ('+Inf', 'inf'::DOUBLE)) b(le, bound) GROUP BY 1, 2""")
def bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bucketize(samples(spark, sf_dir), ["event_type"], _BOUNDS).select("event_type", "le", "count")


@query("""WITH b AS (SELECT event_type, bound, CAST(count(*) FILTER (WHERE value <= bound) AS DOUBLE) AS c FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0]) AS bound) GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(c) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS low FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bound)),
n AS (SELECT event_type, 0.95 * count(*) AS goal FROM events GROUP BY 1)
SELECT event_type, round(arg_min(CAST(low AS DOUBLE) + (bound - low) * (goal - below) / (c - below), bound), 6) AS quantile FROM l JOIN n USING (event_type) WHERE c >= goal GROUP BY 1""")
def histogram_quantile_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = metrics.bucketize(samples(spark, sf_dir), ["event_type"], _BOUNDS)
    return metrics.histogram_quantile(buckets, ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query("SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*) FILTER (WHERE event_type = 'purchase'), 1), 6) AS ratio FROM events GROUP BY 1")
def clamped_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return samples(spark, sf_dir).groupBy("user_id").agg(F.round(metrics.clamped_ratio(n("error"), n("purchase")), 6).alias("ratio"))


@query("SELECT event_type, round(sum(last), 2) AS total FROM (SELECT event_type, user_id, arg_max(value, ts) AS last FROM events WHERE regexp_full_match(event_type, 'click|view') GROUP BY 1, 2) GROUP BY 1")
def sum_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = samples(spark, sf_dir).filter(F.col("event_type").rlike("^(?:click|view)$"))
    return metrics.instant(some, ["event_type", "user_id"]).groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_type, round(avg(value), 6) AS mean, greatest(max(value), 0) AS max FROM events GROUP BY 1")
def gauge_mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_max(samples(spark, sf_dir), ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("""WITH e AS (SELECT event_type, ts AS moment, 1 AS d FROM events UNION ALL SELECT event_type, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)), -1 FROM events),
s AS (SELECT event_type, moment, sum(d) AS d FROM e GROUP BY 1, 2)
SELECT event_type, CAST(max(in_use) AS BIGINT) AS most FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY moment) AS in_use FROM s) GROUP BY 1""")
def pool_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event holds a connection for as many minutes as its value."""
    end = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60_000_000).cast("long"))
    held = samples(spark, sf_dir).select("event_type", F.col("ts").alias("start"), end.alias("end"))
    return metrics.occupancy(held, ["event_type"]).groupBy("event_type").agg(F.max("in_use").alias("most"))


@query(f"SELECT epoch_us({_FIVE}) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.tumbling(samples(spark, sf_dir), "5 minutes", ["event_type"])
    return w.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts) - to_minutes(k * 5)) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM events, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k) GROUP BY 1, 2""")
def sliding_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sliding(samples(spark, sf_dir), "15 minutes", "5 minutes", ["event_type"])
    return w.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS window_start, epoch_us(max(ts) + INTERVAL '30 minutes') AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, sid""")
def session_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sessions(samples(spark, sf_dir), "30 minutes", ["user_id"])
    return w.select("user_id", F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "n", F.round("total", 2).alias("total"))
