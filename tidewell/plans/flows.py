"""Queries over whole flows: files written and read back, message logs, metric answers, reports, ingestion."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import engine
from tidewell.functions import scoring, vector
from tidewell.operators import lifecycle, logs, metrics, retrieval, store, traces
from tidewell.plans.registry import query, table
from tidewell.plans.text import PACKED_SQL, paragraphs
from tidewell.sources import files, messages
from tidewell.streaming import run


def _folder(spark: SparkSession, name: str) -> str:
    return f"{run.shared_folder(spark)}/{name}"


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7")
def step_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("run_id", F.col("conv_id"))
    return store.children(turns, 7, "turn").select("conv_id", "turn", "role")


@query("""SELECT source || '-' || doc_id // 100 || '.txt' AS filename, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content_sha256, CASE WHEN doc_id // 100 % 2 = 0 THEN 'runbook' ELSE 'postmortem' END AS document_type
FROM documents GROUP BY source, doc_id // 100""")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of up to a hundred documents of a source, listed in a manifest of lines, read back with sizes and hashes."""
    folder = _folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("name"), "doc_id", "text")
    files.write_files(docs, "name", "text", folder, "doc_id")
    kind = F.when(F.floor(F.min("doc_id") / 100) % 2 == 0, "runbook").otherwise("postmortem")
    listed = docs.groupBy("name").agg(kind.alias("document_type")).select(F.concat("name", F.lit(".txt")).alias("source"), F.lit("s").alias("service"), "document_type")
    listed.write.json(folder + "-manifest")
    found = files.binary_files(spark, folder).withColumn("filename", F.concat(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit(".txt")))
    joined = files.corpus(found, files.manifest_lines(spark, folder + "-manifest"))
    return joined.select("filename", "size_bytes", "content_sha256", "document_type")


@query("""SELECT item_id AS n, text AS query, CAST(unnest(range(1, item_id % 3 + 2)) AS VARCHAR) AS source FROM benchmark""")
def evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of twenty queries a file."""
    folder = _folder(spark, "eval")
    labels = F.transform(F.sequence(F.lit(1), (F.col("item_id") % 3 + 1).cast("int")), lambda i: F.struct(i.cast("string").alias("source"), F.lit("").alias("must_contain")))
    q = F.struct(F.col("text").alias("query"), F.col("item_id").cast("string").alias("note"), labels.alias("relevant"))
    sets = table(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / 20).alias("part")).agg(F.to_json(F.struct(F.collect_list(q).alias("queries"))).alias("value"))
    sets.repartition("part").write.partitionBy("part").text(folder)
    return files.eval_set(spark, folder).select(F.col("note").cast("long").alias("n"), "query", "source")


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT 'user ' || user_id AS service, CAST(2 * n - 1 AS BIGINT) AS line_no, 'line ' || event_id AS raw FROM l""")
def log_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file for each user, a blank line before each record; line numbers count blank ones, from 0."""
    folder = _folder(spark, "logs")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("user "), "user_id").alias("service"), F.explode(F.array(F.lit(""), F.concat(F.lit("line "), "event_id"))).alias("raw"), "event_id")
    files.write_files(e, "service", "raw", folder, "event_id", "raw")
    return files.log_files(spark, folder).select("service", "line_no", "raw")


@query("SELECT event_id, event_type AS trace, user_id FROM events WHERE strlen(event_type) <= 5")
def followed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages produced with headers, followed as a stream; malformed ones are passed over."""
    folder = _folder(spark, "messages")
    e = table(spark, sf_dir, "events")
    ulid = F.concat(F.lit("01"), F.lpad(F.col("event_id").cast("string"), 24, "0"))
    good = messages.encode(ulid, "document_id", F.col("event_id").cast("string"), F.col("ts").cast("string"))
    rows = e.select(
        F.lit("documents").alias("topic"), F.col("user_id").cast("string").alias("key"), F.when(F.length("event_type") > 5, "{not json").otherwise(good).alias("value"),
        F.create_map(F.lit("trace"), F.col("event_type")).alias("headers"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"),
    )
    messages.produce(rows, folder)
    messages.check_partitions(spark.read.parquet(folder), 3)
    got = run.drained(messages.follow(messages.log_stream(spark, folder), "document_id"))
    return got.select(F.col("offset").alias("event_id"), F.col("headers")["trace"].alias("trace"), F.col("key").cast("long").alias("user_id"))


@query("""SELECT event_type AS name, user_id, epoch_us(ts) // 1000000 * 1000000 AS at, value FROM events UNION ALL SELECT 'scalar', NULL, 1700000000000000, 2.5""")
def metric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved range answers, a series for each user and type, and a scalar one."""
    e = table(spark, sf_dir, "events")
    point = F.array(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.col("value").cast("string"))
    series = e.groupBy("event_type", "user_id").agg(F.collect_list(point).alias("values"))
    series = series.select(F.struct(F.create_map(F.lit("__name__"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("metric"), "values").alias("s"), "user_id")
    answer = series.groupBy("user_id").agg(F.collect_list("s").alias("result"))
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), "result").alias("data")))
    one = spark.range(1).select(F.lit('{"status":"success","data":{"resultType":"scalar","result":[1700000000,"2.5"]}}').alias("body"))
    out = files.decode_metrics(answer.select(body.alias("body")).unionByName(one)).drop("body")
    name = F.coalesce(F.try_element_at("labels", F.lit("__name__")), "result_type")
    return out.select(name.alias("name"), F.try_element_at("labels", F.lit("user")).cast("long").alias("user_id"), F.unix_micros("ts").alias("at"), "value")


def _scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scrape for each user: a gauge, and a request histogram's sums and counts by route and status."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))
    labels = F.concat(F.lit('{route="/'), "event_type", F.lit('",status="'), F.when(F.col("event_type") == "error", "503").otherwise("200"), F.lit('"}'))
    lines = F.array(
        F.concat(F.lit("http_request_duration_seconds_count"), labels, F.lit(" "), "n"), F.concat(F.lit("http_request_duration_seconds_sum"), labels, F.lit(" "), "s"),
        F.concat(F.lit("http_request_duration_seconds_bucket"), F.replace(labels, F.lit("}"), F.lit(',le="+Inf"}')), F.lit(" "), "n"),
    )
    head = F.array(F.lit("# TYPE open gauge"), F.concat(F.lit('open{pool="a"} '), "user_id"), F.lit("# HELP http_request_duration_seconds x"), F.lit("# TYPE http_request_duration_seconds histogram"))
    return e.groupBy("user_id").agg(F.array_join(F.concat(head, F.flatten(F.collect_list(lines))), "\n").alias("body"))


@query("""SELECT user_id, 'gauge' AS kind, 'open' AS name, CAST(user_id AS DOUBLE) AS value, NULL::DOUBLE AS sum, NULL::BIGINT AS count FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, 'histogram', 'http_request_duration_seconds', NULL, round(sum(s), 2), CAST(sum(n) AS BIGINT) FROM (SELECT user_id, event_type, round(sum(value), 2) AS s, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def exposition_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = files.snapshot(files.exposition(_scrapes(spark, sf_dir), "user_id"), "user_id")
    return s.select("user_id", "kind", "name", "value", F.round("sum", 2).alias("sum"), "count")


@query("SELECT user_id, '/' || event_type AS route, CASE WHEN event_type = 'error' THEN '503' ELSE '200' END AS status, count(*) AS value FROM events GROUP BY 1, 2, 3")
def exposition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.request_counts(files.exposition(_scrapes(spark, sf_dir), "user_id"), "user_id")


@query("""WITH s AS (SELECT event_type AS name, user_id % 2 AS svc, CASE WHEN event_type IN ('click', 'view') THEN 'histogram' ELSE 'gauge' END AS kind, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT kind, name, n FROM s WHERE svc = 0 AND kind = 'histogram' UNION ALL SELECT kind, CASE WHEN kind = 'histogram' THEN 'checkout:' || name ELSE name END, n FROM s WHERE svc = 1""")
def merged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two services export the same names: histograms keep both, of gauges the second wins."""
    kind = F.when(F.col("event_type").isin("click", "view"), "histogram").otherwise("gauge")
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), kind.alias("kind"), (F.col("user_id") % 2).alias("svc")).agg(F.count("*").alias("n"))
    return metrics.merge_snapshots(s.filter("svc = 0").drop("svc"), s.filter("svc = 1").drop("svc"), "checkout")


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS retrievals, count(*) FILTER (WHERE role <> 'user') AS tool_calls, CAST(sum(turn) AS BIGINT) AS evidence,
array_to_string(list_filter(['t0', 't1', 't2'], lambda x: list_contains(list('t' || turn % 3) FILTER (WHERE role <> 'user'), x)), ', ') AS tools_sorted FROM conversations GROUP BY 1""")
def outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    steps = c.select("conv_id", F.col("turn").alias("number"), F.when(F.col("role") == "user", "retrieve").otherwise("tool_call").alias("action_type"), F.col("turn").alias("evidence_count"),
                     F.when(F.col("role") != "user", F.concat(F.lit("t"), F.col("turn") % 3)).alias("tool"))
    out = traces.outcome_counts(steps, ["conv_id"])
    return out.select("conv_id", "retrievals", "tool_calls", "evidence", F.array_join(F.array_sort(F.filter(F.split("tools", ", "), lambda x: x != "")), ", ").alias("tools_sorted"))


@query("""SELECT l_orderkey, CASE WHEN min(least(l_quantity - 3, l_extendedprice)) > 0 THEN CAST(sum(CAST(l_quantity - 3 AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) END AS total_cents,
min(least(l_quantity - 3, l_extendedprice)) <= 0 AS refused FROM lineitem GROUP BY 1""")
def checked_order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") - 3).cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"))
    return store.order_totals(items, "l_orderkey", "q", "p").select("l_orderkey", "total_cents", F.col("reason").isNotNull().alias("refused"))


_PHASES = [("baseline", "2024-01-05", "2024-01-10"), ("fault", "2024-01-10", "2024-01-12"), ("recovery", "2024-01-12", "2024-01-20")]


@query(f"""SELECT phase, event_type, round(avg(value), 6) AS mean, greatest(max(value), 0) AS max FROM events JOIN (VALUES {', '.join(f"('{p}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for p, a, b in _PHASES)}) v(phase, a, b) ON ts >= a AND ts < b GROUP BY 1, 2""")
def phase_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = spark.createDataFrame(_PHASES, "phase STRING, start STRING, end STRING").select("phase", F.col("start").cast("timestamp"), F.col("end").cast("timestamp"))
    s = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.mean_max(metrics.in_phases(s, phases), ["phase", "event_type"]).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, count(*) AS n, round(sum(round(value * 1000) / 1000000), 6) AS wait_sum, round(max(round(value * 1000) / 1000000), 6) AS wait_max FROM events GROUP BY 1")
def pool_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asked for its connection as many milliseconds before as its value."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("granted"), "value")
    asked = F.timestamp_micros(F.unix_micros("granted") - F.round(F.col("value") * 1000).cast("long"))
    return metrics.waits(e.withColumn("asked", asked), ["event_type"]).select("event_type", "n", F.round("wait_sum", 6).alias("wait_sum"), F.round("wait_max", 6).alias("wait_max"))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def paired_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers come in another order than their inputs."""
    e = table(spark, sf_dir, "embeddings")
    answers = e.select(F.col("vec_id").alias("index"), "embedding").repartition(7, "embedding")
    out = retrieval.pair_embeddings(e.select(F.col("vec_id").alias("index"), "label"), answers, 64)
    return out.select(F.col("index").alias("vec_id"), "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey DESC) - 1) // 20 AS page, (row_number() OVER (ORDER BY o_orderkey DESC) - 1) % 20 AS place FROM orders")
def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.walk_pages(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 20).select("o_orderkey", F.col("page").cast("long"), F.col("place").cast("long"))


@query("""SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 50""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's price, times 100, begins an interval of 50."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"))
    return store.in_intervals(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", parts, "low", "p_partkey", 50)


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS active FROM customer""")
def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.existing(c, o, "c_custkey").withColumn("active", F.lit(True)).unionByName(store.missing(c, o, "c_custkey").withColumn("active", F.lit(False)))


@query("""WITH s AS (SELECT conv_id AS run_id, turn AS step_number, role FROM conversations)
SELECT run_id, 'step.completed' AS event, step_number, role AS data FROM s UNION ALL SELECT DISTINCT run_id, 'run.started', NULL, '' FROM s UNION ALL SELECT run_id, 'run.finished', NULL, CAST(count(*) AS VARCHAR) FROM s GROUP BY 1""")
def published_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.published(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS s, CAST(o_orderkey % 4 AS INTEGER) AS attempts, o_orderkey % 5 = 0 AS poison FROM orders),
c AS (SELECT *, poison AND s IN ('P', 'F') AS hit FROM r)
SELECT id, CASE WHEN hit THEN 'FAILED' WHEN s = 'P' THEN 'PENDING' WHEN s = 'F' THEN 'FAILED' ELSE 'READY' END AS status, CAST(attempts + CASE WHEN hit THEN 1 ELSE 0 END AS INTEGER) AS attempts, CASE WHEN hit THEN 'unsupported message version' END AS failure_reason FROM c""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of an unknown version for every fifth order, delivered twice; orders that are done stay so."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("READY")
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    rows = o.select(F.concat(F.lit("01"), F.lpad(F.col("o_orderkey").cast("string"), 24, "0")).alias("id"), status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"),
                    at.alias("processing_started_at"), at.alias("updated_at"), F.lit(None).cast("string").alias("failure_reason"), F.lit(0).alias("chunk_count"))
    body = F.to_json(F.struct(F.lit(2).alias("schema_version"), F.col("id").alias("document_id")))
    sent = rows.filter("cast(substr(id, 3) as long) % 5 = 0").select(F.explode(F.array(body, body)).alias("value"))
    after = lifecycle.dead_letters(rows, messages.triage(sent, "document_id"), at)
    return after.select(F.substring("id", 3, 24).cast("long").alias("id"), "status", "attempts", "failure_reason")


@query("""SELECT c_custkey, (['payment-latency', 'baseline', 'checkout-cpu', 'payment-errors'])[c_custkey % 4 + 1] AS scenario, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 3 = 0 WHEN 1 THEN c_custkey % 3 = 2 WHEN 2 THEN false ELSE false END AS correct FROM customer""")
def rescored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are outcomes: three causes in turn, marked by the registry as it is now."""
    cause = F.when(F.col("c_custkey") % 3 == 0, "the connection pool is exhausted").when(F.col("c_custkey") % 3 == 1, "").otherwise("no root cause, all is within budget")
    scenario = F.element_at(F.array(*map(F.lit, ["payment-latency", "baseline", "checkout-cpu", "payment-errors"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", scenario.alias("scenario"), cause.alias("root_cause"), F.lit("payment-service").alias("affected_service"))
    return traces.rescored(c, scoring.scenarios(spark), scoring.mark()).select("c_custkey", "scenario", "mark.correct")


@query(PACKED_SQL + """ SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'READY' WHEN n IS NULL THEN 'FAILED' ELSE 'READY' END AS status, CAST(CASE WHEN doc_id % 4 = 0 THEN -1 ELSE coalesce(n, 0) END AS INTEGER) AS chunk_count,
CASE WHEN doc_id % 4 <> 0 AND n IS NULL THEN 'no content' END AS failure_reason FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1) USING (doc_id)""")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of ingestion over all documents; every fourth is READY before and stays as it was."""
    docs = paragraphs(table(spark, sf_dir, "documents"))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    done = F.col("doc_id") % 4 == 0
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("text").alias("format"), F.col("source").alias("service"), F.lit("runbook").alias("document_type"), F.lit("f.txt").alias("filename"),
        F.when(done, "READY").otherwise("PENDING").alias("status"), F.lit(None).cast("string").alias("failure_reason"), F.when(done, -1).otherwise(0).alias("chunk_count"), F.lit(0).alias("attempts"),
        at.alias("processing_started_at"), at.alias("created_at"), at.alias("updated_at"),
    )
    index = spark.createDataFrame([], "document_id STRING, chunk_id STRING, chunk_index INT, service STRING, document_type STRING, source STRING, heading_path STRING, content STRING, embedding ARRAY<FLOAT>, indexed_at TIMESTAMP")
    contents = docs.select(F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("content"))
    after, _ = engine.ingest(rows, contents, index, engine.fake_embedder(8), at)
    return after.select(F.col("id").cast("long").alias("doc_id"), "status", "chunk_count", "failure_reason")


@query("""WITH d AS (SELECT doc_id, unnest(range(1, 17)) AS i, md5(md5(text) || ':' || unnest(range(1, 17))) AS h FROM documents),
n AS (SELECT doc_id, i, sqrt(-2 * ln((('0x' || h[1:12])::BIGINT + 1) / 281474976710657.0::DOUBLE)) * cos(2 * pi() * (('0x' || h[13:24])::BIGINT + 1) / 281474976710657.0::DOUBLE) AS x FROM d),
u AS (SELECT doc_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM n)
SELECT doc_id, round(max(x) FILTER (WHERE i = 1), 4) AS x1, round(max(x) FILTER (WHERE i = 9), 4) AS x9, round(max(x) FILTER (WHERE i = 16), 4) AS x16 FROM u GROUP BY 1""")
def fake_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("doc_id", vector.fake_embedding("text", 16).alias("v"))
    return e.select("doc_id", *[F.round(F.col("v")[i - 1].cast("double"), 4).alias(f"x{i}") for i in (1, 9, 16)])


@query("SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def shown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal columns aren't shown."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(1).alias("attempts"), F.lit("/p").alias("storage_path"))
    return store.wire(store.filtered(rows, source="src1")).drop("source")


@query("SELECT event_id, CASE WHEN event_id < 1500 THEN 15 ELSE CAST(round(event_id / 100.0) AS INTEGER) END AS step FROM events WHERE event_id % 100 <> 50")
def resolved_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id % 100 <> 50").select("event_id", metrics.step_seconds(F.col("event_id")).alias("step"))


@query("SELECT event_id AS line_no FROM events WHERE event_type = 'purchase' AND contains(CAST(user_id AS VARCHAR), '12')")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw line is searched before it is parsed."""
    from tidewell.plans.logs import log_lines

    lines = logs.containing(log_lines(spark, sf_dir), '"WARN"')
    return logs.parse_lines(lines).filter(F.col("parse_ok") & F.contains(F.col("attrs")["user"], F.lit("12"))).select("line_no")


def report_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The three reports, as text."""
    from tidewell.plans import metrics as m
    from tidewell.plans import retrieval as r
    from tidewell.plans import traces as t

    chunks = table(spark, sf_dir, "embeddings")
    queries = r.label_centroids(chunks)
    found = retrieval.knn_batch(chunks, queries, 10, key="vec_id").select("query_id", "rank", F.col("label").cast("string").alias("source"), F.lit("").alias("content"))
    ranks = retrieval.first_hits(queries, found, queries.select("query_id", F.col("query_id").cast("string").alias("source"), F.lit("").alias("must_contain")))
    return {
        "retrieval": traces.retrieval_report(ranks, retrieval.hit_rate(ranks, 1, 3, 5)),
        "agent": traces.agent_report(t._outcomes(spark, sf_dir), t.budget_report(spark, sf_dir), "c_custkey"),
        "lab": traces.lab_report(m.gauge_mean_max(spark, sf_dir).orderBy("event_type"), m.status_summary(spark, sf_dir).orderBy("user_id").limit(5)),
    }

