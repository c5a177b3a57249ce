"""Streams with state, the event log as a data source, tables merged on write, the vector index."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import vector
from tidewell.operators import merge, vector_index
from tidewell.plans.registry import query, table
from tidewell.sources import events as log
from tidewell.streaming import run, runs

_RUN_FOLD = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'step' WHEN 'purchase' THEN 'succeed' ELSE 'fail' END AS action,
  CAST(event_id % 4 + 1 AS INTEGER) AS attempt, event_id % 7 AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS us, '' AS action, '' AS before, '' AS after, 0 AS attempts, CAST(0 AS BIGINT) AS started, CAST([] AS BIGINT[]) AS steps, NULL::VARCHAR AS reason FROM e UNION ALL
  SELECT run_id, n, us, action, before, CASE WHEN reason IS NOT NULL THEN before WHEN action = 'create' THEN 'PENDING' WHEN action = 'claim' THEN 'RUNNING' WHEN action = 'succeed' THEN 'SUCCEEDED' WHEN action = 'fail' THEN 'FAILED' ELSE before END,
    attempts + CASE WHEN reason IS NULL AND action = 'claim' THEN 1 ELSE 0 END, CASE WHEN reason IS NULL AND action = 'claim' THEN us // 1000 ELSE started END,
    CASE WHEN reason IS NOT NULL THEN steps WHEN action = 'claim' THEN CAST([] AS BIGINT[]) WHEN action = 'step' THEN list_distinct(list_append(steps, step)) ELSE steps END, reason
  FROM (SELECT e.*, f.after AS before, f.attempts, f.started, f.steps, CASE WHEN e.action = 'create' THEN CASE WHEN f.after <> '' THEN 'exists' END WHEN f.after = '' THEN 'missing' WHEN f.after IN ('SUCCEEDED', 'FAILED') THEN 'terminal'
      WHEN e.action = 'claim' THEN CASE WHEN f.after = 'RUNNING' AND f.started >= e.us // 1000 - 900000 THEN 'held' END WHEN f.after <> 'RUNNING' THEN 'idle' WHEN e.attempt <> f.attempts THEN 'stale' END AS reason
    FROM f JOIN e ON e.run_id = f.run_id AND e.n = f.n + 1))
SELECT run_id, us AS at, action, CAST(attempts AS INTEGER) AS attempt, before, after, CAST(len(steps) AS INTEGER) AS children, reason FROM f WHERE n > 0"""


@query(_RUN_FOLD)
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are runs: signups create, clicks claim, views add steps, purchases and errors end; requests name an attempt, which may be an old one."""
    kinds = {"signup": "create", "click": "claim", "view": "step", "purchase": "succeed"}
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("fail"))
    e = run.parquet_stream(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), (F.col("event_id") % 4 + 1).cast("int").alias("attempt"), (F.col("event_id") % 7).alias("step"))
    out = run.with_state_store(spark, lambda: run.drained(runs.runs(rows)))
    return out.select("run_id", F.unix_micros("ts").alias("at"), "action", "attempt", "before", "after", "children", "reason")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS attempt FROM events),
l AS (SELECT *, max(attempt) OVER (PARTITION BY user_id) AS last FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC) AS n FROM l WHERE attempt = last AND event_type <> 'signup')
SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(attempt AS INTEGER) AS attempt, CAST(event_id % 5 AS INTEGER) AS step_number, CAST(event_id AS VARCHAR) AS data FROM s WHERE n = 1""")
def stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live timeline, folded from its changes: a signup starts a user's run anew, other events complete the step that their id names."""
    e = run.parquet_stream(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").cast("string").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "run.started").otherwise("step.completed").alias("event"),
        (F.col("event_id") % 5).cast("int").alias("step_number"), F.col("event_id").cast("string").alias("data"),
    )
    changes = run.with_state_store(spark, lambda: run.drained(runs.timeline(rows), "update"))
    last = changes.groupBy("run_id", "step_number").agg(F.max_by(F.struct("attempt", "data", "gone"), F.struct("ms", "seq")).alias("x"))
    return last.filter("not x.gone").select("run_id", "x.attempt", "step_number", "x.data")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > 259200000 THEN 1 ELSE 0 END AS cut FROM e),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) - cut AS later, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS n, max(ms) OVER (PARTITION BY user_id) AS last, max(ms) OVER () AS now FROM g)
SELECT CAST(user_id AS VARCHAR) AS run_id, ms || '-' || event_id AS id FROM s WHERE later = 0 AND n <= 20 AND last + 259200000 >= now""")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 events of each user, who is forgotten after three silent days."""
    e = run.parquet_stream(spark, sf_dir, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), ms.alias("ms"), F.col("event_id").alias("seq"), F.concat_ws("-", ms.cast("string"), F.col("event_id").cast("string")).alias("id"))
    changes = run.with_state_store(spark, lambda: run.drained(runs.retention(rows.withWatermark("ts", "0 seconds"), 20, 72)))
    return changes.groupBy("run_id", "id").agg(F.sum(F.when(F.col("gone"), -1).otherwise(1)).alias("n")).filter("n > 0").select("run_id", "id")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log in three partitions; purchases are malformed."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    kind = F.when(F.col("event_type") != "purchase", F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("int").alias("partition"), F.concat_ws("-", ms.cast("string"), F.col("event_id").cast("string")).alias("id"), F.col("user_id").cast("string").alias("run_id"), kind.alias("event"),
        F.col("value").cast("string").alias("data"), F.col("event_id"),
    )


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, event_type AS event, value, 1 AS deliveries FROM events WHERE event_type <> 'purchase'")
def followed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is followed, stopped, written on and followed again from the checkpoint."""
    base = run.shared_folder(spark)
    rows = _log(spark, sf_dir)
    half = rows.approxQuantile("event_id", [0.5], 0.0)[0]
    for part in (rows.filter(F.col("event_id") <= half), rows.filter(F.col("event_id") > half)):
        log.write_events(part, f"{base}/log")
        sink = log.follow(spark, f"{base}/log").writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
        sink.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    return got.groupBy(F.col("seq").alias("event_id"), "run_id", "event", F.col("data").cast("double").alias("value")).agg(F.count("*").cast("int").alias("deliveries"))


@query("""SELECT event_id, event_type AS event FROM events WHERE user_id IN (7, 12) AND event_type <> 'purchase' AND epoch_us(ts) // 1000 >= 1704844800000 AND epoch_us(ts) // 1000 < 1706054400000""")
def replayed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' events of two weeks: runs and times are filters of the source."""
    path = f"{run.shared_folder(spark)}/log"
    log.write_events(_log(spark, sf_dir), path)
    some = log.events(spark, path).filter(F.col("run_id").isin("7", "12") & (F.col("ms") >= 1704844800000) & (F.col("ms") < 1706054400000))
    return some.select(F.col("seq").alias("event_id"), "event")


@query("""SELECT c_mktsegment AS kind, c_nationkey AS nation, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3 GROUP BY ALL""")
def saved_outcomes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes saved as lines by segment and nation; the segment is a filter of the source."""
    path = f"{run.shared_folder(spark)}/saved"
    c = table(spark, sf_dir, "customer")
    c.select(F.to_json(F.struct("c_custkey")).alias("value"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("name")).write.partitionBy("kind", "name").text(path)
    some = log.saved_results(spark, path).filter(F.col("kind").isin("BUILDING", "MACHINERY")).select("kind", F.col("name").cast("long").alias("nation"), F.from_json("line", "c_custkey LONG")["c_custkey"].alias("k")).filter("nation <> 3")
    return some.groupBy("kind", F.col("nation").cast(dict(c.dtypes)["c_nationkey"]).alias("nation")).agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


_MERGES = "\n".join(
    f"""{"," if k else "WITH"} m{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM (SELECT user_id, ts, event_id, event_type, value FROM events WHERE event_id % 4 = {k}
  {f"UNION ALL SELECT user_id, ts, event_id, event_type, value FROM m{k - 1}" if k else ""})) WHERE n = 1 AND event_type <> 'error')"""
    for k in range(4)
)


@query(_MERGES + " SELECT user_id, event_id, value FROM m3")
def merged_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, from four batches that are merged one after the other, one of them delivered twice; an error deletes its user."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    kept = merge.Table(spark, f"{run.shared_folder(spark)}/users", ["user_id"], "ts", e.schema, 16)
    write = merge.sink(kept, F.col("event_type") == "error")
    for k in (0, 1, 1, 2, 3):
        write(e.filter(F.col("event_id") % 4 == k), k)
    kept.vacuum()
    return kept.read().select("user_id", "event_id", "value")


@query("""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, u.vec_id, round((1 + list_cosine_similarity(q.e, u.e)) / 2, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, u.e) DESC, u.vec_id) AS rank FROM u q JOIN u ON q.vec_id % 50 = 0) WHERE rank <= 5""")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's nearest in the index, all lists probed."""
    path, chunks = f"{run.shared_folder(spark)}/index", table(spark, sf_dir, "embeddings")
    vector_index.build(chunks, path, 24)
    queries = chunks.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector_index.search(spark, path, queries, 5, 24, key="vec_id").withColumn("score", F.round("score", 6))


def letters(texts: list[str]) -> list[tuple[int, list[float]]]:
    """A stand-in for a model's service: code points, a's and spaces of each text, answered in reverse."""
    return [(i, [float(len(t)), float(t.count("a")), float(t.count(" "))]) for i, t in reversed(list(enumerate(texts)))]


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM documents")
def embedded_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = vector.batched(letters, 3)
    found = table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return found.select("doc_id", *[F.col("v")[i].cast("double").alias(n) for i, n in enumerate(("chars", "a", "spaces"))])
