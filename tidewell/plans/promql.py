"""Metric queries from their text over series made from events: each user and type of event is an instance."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import promql
from tidewell.plans.metrics import _COUNTERS, by_series, counters, samples
from tidewell.plans.registry import query

BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0)
START, END, DAY = datetime(2024, 1, 2), datetime(2024, 1, 30), 86400.0
#: Events are scarce, so they count as scraped once a day: $__rate_interval is four days.
SCRAPE, LOOK_BACK = DAY, 2 * DAY


def _labelled(rows: DataFrame, name: str, labels: dict, value) -> DataFrame:
    own = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), v)])
    return rows.select(F.lit(name).alias("name"), own.alias("labels"), "ts", value.cast("double").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, labels, ts, value): two counters, a histogram of values and a gauge."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    reason, job = F.concat(F.lit("reason"), F.col("user_id") % 3), F.element_at(F.array(*map(F.lit, JOBS)), (F.col("user_id") % len(JOBS) + 1).cast("int"))
    events, upto = samples(spark, sf_dir), Window.partitionBy("user_id", "event_type").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    counts = by_series(events).select("*", *[F.count_if(F.col("value") <= b).over(upto).alias(f"c{i}") for i, b in enumerate((*BOUNDS, float("inf")))])
    each = F.array(*[F.struct(F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"), F.col(f"c{i}").alias("n")) for i, b in enumerate((*BOUNDS, float("inf")))])
    buckets = counts.select("user_id", "event_type", "ts", F.inline(each))
    return (
        _labelled(counters(spark, sf_dir), "agent_runs_total", {"instance": user, "status": kind, "stop_reason": reason}, F.col("value"))
        .unionByName(_labelled(counts, "agent_steps_total", {"instance": user, "action_type": kind}, F.col(f"c{len(BOUNDS)}")))
        .unionByName(_labelled(buckets, "agent_tool_duration_seconds_bucket", {"instance": user, "tool": kind, "le": F.col("le")}, F.col("n")))
        .unionByName(_labelled(events, "up", {"instance": user, "job": job, "kind": kind}, (kind != "error").cast("int")))
    )


JOBS = ("api", "ingestion-worker", "agent-worker", "ops-mcp", "lab", "docs")


def run(spark: SparkSession, sf_dir: str, text: str, *labels: str) -> DataFrame:
    out = promql.evaluate(series(spark, sf_dir), text, START, END, DAY, LOOK_BACK, SCRAPE)
    own = [F.try_element_at("labels", F.lit(x)).alias(x) for x in labels]
    return out.select(F.unix_micros("ts").alias("at"), *own, F.round("value", 6).alias("value"))


_BUCKET_ROWS = ", ".join(f"('{b:g}', {b})" for b in BOUNDS)
_SERIES = f"""{_COUNTERS},
g AS (SELECT TIMESTAMP '2024-01-02' + to_days(k::INTEGER) AS t FROM range(29) r(k)),
b AS (SELECT * FROM (VALUES {_BUCKET_ROWS}, ('+Inf', 'inf'::DOUBLE)) v(le, bound)),
runs AS (SELECT user_id, event_type, '' AS le, ts, value FROM c),
steps AS (SELECT user_id, event_type, '' AS le, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS value FROM events),
buckets AS (SELECT user_id, event_type, le, ts, count(*) FILTER (WHERE value <= bound) OVER (PARTITION BY user_id, event_type, le ORDER BY ts) AS value FROM events, b)"""


def _grown(name: str, days: int = 4) -> str:
    """CTE {name}_up: (user_id, event_type, le, t, grown), the extrapolated increase of the series `name` in the days before t."""
    seen = f"t - INTERVAL {days} DAY < ts AND ts <= t"
    return f"""{name}_w AS (SELECT user_id, event_type, le, t, ts, value, lag(value) OVER (PARTITION BY user_id, event_type, le, t ORDER BY ts) AS earlier FROM {name} JOIN g ON {seen}),
{name}_a AS (SELECT user_id, event_type, le, t, count(*) AS n, min(ts) AS f, max(ts) AS l, arg_min(value, ts) AS v0, arg_max(value, ts) - arg_min(value, ts) + sum(CASE WHEN value < earlier THEN earlier ELSE 0 END) AS up
  FROM {name}_w GROUP BY ALL HAVING count(*) > 1),
{name}_s AS (SELECT *, (epoch_us(l) - epoch_us(f)) / 1e6 AS span, span / (n - 1) AS mean, {days * 86400} - (epoch_us(t) - epoch_us(f)) / 1e6 AS gap0, (epoch_us(t) - epoch_us(l)) / 1e6 AS gap1 FROM {name}_a),
{name}_up AS (SELECT user_id, event_type, le, t, up * (span + least(CASE WHEN gap0 >= 1.1 * mean THEN mean / 2 ELSE gap0 END, CASE WHEN up > 0 AND v0 >= 0 THEN span * v0 / up ELSE 'inf'::DOUBLE END)
  + CASE WHEN gap1 >= 1.1 * mean THEN mean / 2 ELSE gap1 END) / span AS grown FROM {name}_s)"""


def _now(name: str) -> str:
    """CTE {name}_now: each series' last value at each step, two days old at most."""
    return f"""{name}_now AS (SELECT user_id, event_type, le, t, arg_max(value, ts) AS value FROM {name} JOIN g ON t - INTERVAL 2 DAY < ts AND ts <= t GROUP BY ALL)"""


_REASON = "'reason' || user_id % 3"
_JOB = f"{list(JOBS)}[(user_id % {len(JOBS)} + 1)::INTEGER]"


def _quantile(q: float, by: str) -> str:
    keys = f"t{', ' + by if by else ''}"
    return f"""h AS (SELECT {keys.replace("tool", "event_type AS tool")}, bound, sum(grown) / 345600 AS n FROM buckets_up JOIN b USING (le) GROUP BY ALL),
m AS (SELECT {keys}, bound, max(n) OVER (PARTITION BY {keys} ORDER BY bound) AS n FROM h),
rank AS (SELECT {keys}, bound, n, coalesce(lag(n) OVER o, 0) AS below, coalesce(lag(bound) OVER o, 0) AS low, max(n) OVER (PARTITION BY {keys}) AS total FROM m WINDOW o AS (PARTITION BY {keys} ORDER BY bound)),
f AS (SELECT {keys}, arg_min(CASE WHEN bound = 'inf' THEN low ELSE low + (bound - low) * ({q} * total - below) / (n - below) END, bound) AS v FROM rank WHERE n >= {q} * total AND total > 0 GROUP BY ALL
  UNION ALL SELECT {keys}, 'nan'::DOUBLE FROM rank WHERE total = 0 GROUP BY ALL)
SELECT epoch_us(t) AS at, {by + ", " if by else ""}round(v, 6) AS value FROM f"""


@query(f"WITH {_SERIES}, {_grown('runs')} SELECT epoch_us(t) AS at, event_type AS status, {_REASON} AS stop_reason, round(sum(grown), 6) AS value FROM runs_up GROUP BY ALL")
def promql_runs_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "sum by (status, stop_reason) (increase(agent_runs_total[$__rate_interval]))", "status", "stop_reason")


@query(f"WITH {_SERIES}, {_now('runs')} SELECT epoch_us(t) AS at, {_REASON} AS stop_reason, round(sum(value), 6) AS value FROM runs_now GROUP BY ALL")
def promql_stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "sum by (stop_reason) (agent_runs_total)", "stop_reason")


@query(f"WITH {_SERIES}, {_grown('buckets')}, {_quantile(0.5, '')}")
def promql_duration_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "histogram_quantile(0.5, sum by (le) (rate(agent_tool_duration_seconds_bucket[$__rate_interval])))")


@query(f"WITH {_SERIES}, {_grown('buckets')}, {_quantile(0.95, 'tool')}")
def promql_tool_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "histogram_quantile(0.95, sum by (le, tool) (rate(agent_tool_duration_seconds_bucket[$__rate_interval])))", "tool")


@query(f"""WITH {_SERIES}, {_grown('runs')}, {_grown('steps')}, x AS (SELECT t, sum(grown) AS x FROM steps_up GROUP BY 1), y AS (SELECT t, greatest(sum(grown), 1) AS y FROM runs_up GROUP BY 1)
SELECT epoch_us(t) AS at, round(x / y, 6) AS value FROM x JOIN y USING (t)""")
def promql_steps_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "sum(increase(agent_steps_total[$__rate_interval])) / clamp_min(sum(increase(agent_runs_total[$__rate_interval])), 1)")


@query(f"WITH {_SERIES}, {_grown('steps')} SELECT epoch_us(t) AS at, event_type AS action_type, round(sum(grown), 6) AS value FROM steps_up WHERE event_type NOT IN ('view', 'click') GROUP BY ALL")
def promql_steps_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "sum by (action_type) (increase(agent_steps_total{action_type!~'view|click'}[$__rate_interval]))", "action_type")


@query(f"""WITH {_SERIES}, ups AS (SELECT user_id, event_type, '' AS le, ts, CAST(event_type <> 'error' AS DOUBLE) AS value FROM events), {_now('ups')}
SELECT epoch_us(t) AS at, CAST(user_id AS VARCHAR) AS instance, {_JOB} AS job, event_type AS kind, value FROM ups_now WHERE {_JOB} IN ('api', 'ingestion-worker', 'agent-worker', 'ops-mcp')""")
def promql_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, 'up{job=~"api|ingestion-worker|agent-worker|ops-mcp"}', "instance", "job", "kind")


@query(f"""WITH {_SERIES}, {_grown('runs', 3)}, s AS (SELECT t, event_type, sum(grown) / 259200 AS v FROM runs_up GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, event_type) AS n FROM s)
SELECT epoch_us(t) AS at, event_type AS status, round(v * 3600, 6) AS value FROM r WHERE n <= 2""")
def promql_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "topk(2, sum without (instance, stop_reason) (rate(agent_runs_total[3d]))) * 60 * 6e1", "status")


@query(f"""WITH {_SERIES}, {_now('runs')}, old AS (SELECT user_id, event_type, t + INTERVAL 1 DAY AS t, value FROM runs_now UNION SELECT user_id, event_type, TIMESTAMP '2024-01-02', arg_max(value, ts) FROM runs WHERE ts <= TIMESTAMP '2024-01-01' GROUP BY ALL)
SELECT epoch_us(t) AS at, CAST(user_id AS VARCHAR) AS instance, event_type AS status, {_REASON} AS stop_reason, round(n.value - old.value, 6) AS value
FROM runs_now n JOIN old USING (user_id, event_type, t) WHERE n.value - old.value < 0 AND user_id % 3 != 1""")
def promql_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "(agent_runs_total - agent_runs_total offset 1d < 0) unless on (stop_reason) vector(0) unless on (instance) up{stop_reason='x'} and on (stop_reason) agent_runs_total{stop_reason!='reason1'}", "instance", "status", "stop_reason")


@query(f"""WITH {_SERIES}, ups AS (SELECT user_id, event_type, '' AS le, ts, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS value FROM events),
w AS (SELECT t, user_id, event_type, avg(value) AS a FROM ups JOIN g ON t - INTERVAL 3 DAY < ts AND ts <= t GROUP BY ALL)
SELECT epoch_us(t) AS at, {_JOB} AS job, round(100 * avg(a), 6) AS value FROM w GROUP BY ALL""")
def promql_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "100 * avg by (job) (avg_over_time(up[3d]))", "job")
