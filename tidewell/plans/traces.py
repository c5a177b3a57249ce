"""Trace analytics: conversations are runs, turns are steps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scoring
from tidewell.operators import traces
from tidewell.plans.registry import query, table


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.octet_length("text").cast("long").alias("bytes"))


@query("""WITH m AS (SELECT user_id, event_id, ts, event_type = 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
i AS (SELECT *, n - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM m)
SELECT user_id, epoch_us(min(ts)) AS first, count(*) AS length FROM i WHERE hit GROUP BY user_id, island HAVING count(*) >= 2""")
def streak_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = traces.streaks(e, "user_id", "ts", F.col("event_type") == "error").filter("length >= 2")
    return s.select("user_id", F.unix_micros("first").alias("first"), "length")


@query("""WITH s AS (SELECT conv_id, turn, count(*) OVER w AS n, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS calls, sum(strlen(text)) OVER w AS ms, sum(strlen(text) // 4) OVER w AS tokens
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN n >= 6 THEN 'MAX_STEPS' WHEN calls >= 2 THEN 'MAX_TOOL_CALLS' WHEN ms >= 3000 THEN 'TIMEOUT' WHEN tokens >= 500 THEN 'TOKEN_BUDGET' END AS bound FROM s)
SELECT conv_id, arg_min(bound, turn) AS bound, min(turn) AS at_step FROM b WHERE bound IS NOT NULL GROUP BY 1""")
def bound_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return traces.first_bound(s, "conv_id", "turn", 6, 2, 3000, 500, F.col("role") == "assistant", F.col("bytes"), F.floor(F.col("bytes") / 4))


@query("""SELECT conv_id, count(*) AS step_count, count(*) FILTER (WHERE role = 'assistant') AS tool_call_count, CAST(sum(CASE WHEN role = 'user' THEN strlen(text) ELSE 0 END) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) ELSE 0 END) AS BIGINT) AS completion_tokens FROM conversations GROUP BY 1""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda role: F.when(F.col("role") == role, F.col("bytes")).otherwise(0)
    return traces.run_counters(steps(spark, sf_dir), "conv_id", F.col("role") == "assistant", said("user"), said("assistant"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS attempt FROM events),
l AS (SELECT *, max(attempt) OVER (PARTITION BY user_id) AS last FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC) AS n FROM l WHERE attempt = last AND event_type <> 'signup')
SELECT user_id AS run_id, attempt, event_id % 5 AS step_number, event_id AS data FROM s WHERE n = 1""")
def timeline_latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup starts a user's run anew; other events complete the step that their id names."""
    e = table(spark, sf_dir, "events")
    events = e.select(
        F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "run.started").otherwise("step.completed").alias("event"),
        (F.col("event_id") % 5).alias("step_number"), F.col("event_id").alias("data"),
    )
    return traces.materialize_timeline(events)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n <= 50")
def retention_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.keep_newest(table(spark, sf_dir, "events"), "user_id", 50, F.desc("ts")).select("user_id", "event_id")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are outcomes: segment is the scenario, nation the attempt."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey"), F.col("c_mktsegment").alias("scenario"), (F.col("c_acctbal") > 2000).alias("correct"), (F.col("c_acctbal") > 0).alias("service_ok"), F.col("c_nationkey").alias("attempt"),
        F.when(F.col("c_acctbal") < -500, "FAILED").otherwise("SUCCEEDED").alias("status"), F.when(F.col("c_custkey") % 2 == 0, "MAX_STEPS").otherwise("COMPLETED").alias("stop_reason"),
    )


@query("""SELECT c_mktsegment AS scenario, count(*) FILTER (WHERE c_acctbal > 2000) AS correct, count(*) FILTER (WHERE c_acctbal > 0) AS service_ok, count(*) AS runs FROM customer GROUP BY 1""")
def eval_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.by_scenario(_outcomes(spark, sf_dir), "c_custkey")


@query("SELECT count(*) FILTER (WHERE c_acctbal > 2000) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (WHERE c_acctbal > 2000) / count(*), 0) AS percent FROM customer")
def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.accuracy(_outcomes(spark, sf_dir))


@query("""SELECT c_nationkey AS key, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) ELSE string_agg(c_mktsegment, ', ' ORDER BY c_custkey) END AS spread FROM customer GROUP BY 1""")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.spread(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "key"), "key", "c_custkey", "c_mktsegment")


@query("""WITH o AS (SELECT count(*) FILTER (WHERE c_acctbal >= -500 AND c_custkey % 2 = 0) AS bounded, count(*) FILTER (WHERE c_acctbal < -500) AS failed, count(*) FILTER (WHERE c_acctbal >= -500 AND c_custkey % 2 = 1) AS voluntary FROM customer),
s AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS retrievals, count(*) FILTER (WHERE o_orderstatus = 'O') AS tool_calls, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS not_ok FROM orders)
SELECT * FROM o, s""")
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    action = F.when(F.col("o_orderstatus") == "P", "retrieve").when(F.col("o_orderstatus") == "O", "tool_call").otherwise("none")
    return traces.budget_use(_outcomes(spark, sf_dir), o.select(action.alias("action_type"), F.when(F.col("o_orderpriority") == "1-URGENT", "REFUSED").otherwise("OK").alias("tool_status")))


#: (scenario, service, cause, whether it is right, how its reason begins): each failure mode of a mark.
_ANSWERS = [
    ("payment-latency", "payment-service", "The card processor that it calls is slow, so its connection pool fills up.", True, ""),
    ("payment-latency", "payment-service", "All connections of the pool wait for a slow downstream call.", True, ""),
    ("payment-latency", "payment-service (in fact the card processor behind it)", "The card processor is slow.", True, ""),
    ("payment-latency", "checkout-service", "The client's timeout is too short.", False, 'named "checkout-service"'),
    ("payment-latency", "payment-service", "Its CPU is saturated, so each request is slow.", False, "the diagnosis names"),
    ("payment-cpu", "payment-service", "It is CPU saturated; the card processor is fine.", True, ""),
    ("payment-latency", "payment-service", "It is slow.", False, "the diagnosis names none of"),
    ("baseline", "", "Nothing is wrong: latency and errors are within budget.", True, ""),
    ("baseline", "payment-service", "No root cause: both services are operating normally.", True, ""),
    ("baseline", "payment-service", "Connection pool exhaustion slows checkout down.", False, ""),
    ("baseline", "checkout-service", "It is not clear what is happening.", False, ""),
    ("payment-latency", "", "  ", False, "the run produced no diagnosis"),
]
_MARKS = ", ".join(f"({n}, {str(right).lower()}, '{why}')" for n, (_, _, _, right, why) in enumerate(_ANSWERS))


@query(f"""SELECT c_custkey, correct, why AS reason_begins FROM customer JOIN (VALUES {_MARKS}) v(n, correct, why) ON c_custkey % {len(_ANSWERS)} = n""")
def mark_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers give twelve answers in turn, each marked by its scenario."""
    rows = spark.createDataFrame([(n, *x) for n, x in enumerate(_ANSWERS)], "n INT, scenario STRING, affected_service STRING, root_cause STRING, right BOOLEAN, begins STRING")
    given = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(_ANSWERS)).cast("int").alias("n")).join(F.broadcast(rows), "n")
    marked = traces.rescored(given, scoring.scenarios(spark), scoring.mark())
    why = F.coalesce("mark.why", F.lit(""))
    return marked.select("c_custkey", "mark.correct", F.when(F.startswith(why, "begins"), F.col("begins")).otherwise(why).alias("reason_begins"))


@query("""WITH s AS (SELECT c_mktsegment AS scenario, count(*) AS runs, count(*) FILTER (WHERE c_acctbal > 2000) AS correct FROM customer GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY scenario) AS n FROM s)
SELECT CAST(0 AS BIGINT) AS n, '| scenario | runs | correct |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT n + 1, '| ' || scenario || ' | ' || runs || ' | ' || correct || ' |' FROM n""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("scenario")).agg(F.count("*").alias("runs"), F.count_if(F.col("c_acctbal") > 2000).alias("correct"))
    return traces.table_lines(c, "scenario")
