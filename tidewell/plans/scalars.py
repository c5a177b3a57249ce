"""One query for each text, validation and message expression, over documents, pages, events and conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.plans.registry import query, table
from tidewell.sources import messages


def _prefix(text: str, most: int) -> str:
    """SQL of the longest prefix of at most `most` bytes."""
    return f"list_reduce(list_prepend('', list_filter([left({text}, CAST(k AS BIGINT)) FOR k IN range({most // 4}, {most + 1})], lambda p: strlen(p) <= {most})), lambda a, p: CASE WHEN strlen(p) > strlen(a) THEN p ELSE a END)"


@query("SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS text_md5 FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: line ends are CRLF, every third has a byte-order mark, every seventh isn't UTF-8."""
    raw = F.encode(F.concat(F.when(F.col("doc_id") % 3 == 0, "﻿").otherwise(""), F.replace("text", F.lit("\n"), F.lit("\r\n"))), "UTF-8")
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(content)).alias("text_md5"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' || source ELSE '' END AS path, md5(CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' || source || chr(10) || chr(10) ELSE '' END || text) AS embedded FROM documents""")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit(""), "source")).otherwise(F.array(F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", "text", T.heading_path(titles).alias("path")).select("doc_id", "path", F.md5(T.embedded_text("path", "text")).alias("embedded"))


@query("""WITH u AS (SELECT conv_id, turn, text, turn % 3 <> 0 AS tight, lag(turn % 3 <> 0) OVER w AS before, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, md5(string_agg(CASE WHEN n = 1 THEN '' WHEN tight AND before THEN chr(10) ELSE chr(10) || chr(10) END || text, '' ORDER BY turn)) AS joined FROM u GROUP BY 1""")
def joined_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda u: F.struct(u["text"].alias("text"), (u["turn"] % 3 != 0).alias("tight")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(units.alias("units")).select("conv_id", F.md5(T.join_units("units")).alias("joined"))


@query("""SELECT doc_id, md5(repeat('#', CAST(doc_id % 6 + 1 AS INTEGER)) || ' ' || source || CASE WHEN doc_id % 4 = 0 OR text = '' THEN '' ELSE chr(10) || chr(10) || text END) AS section FROM documents""")
def rendered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.render_section((F.col("doc_id") % 6 + 1).cast("int"), "source", body)).alias("section"))


@query("SELECT conv_id, turn, conv_id || '-' || turn AS chunk_id FROM conversations")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.chunk_id("conv_id", "turn").alias("chunk_id"))


@query(f"SELECT doc_id, md5(CASE WHEN strlen(text) <= 8192 THEN text ELSE {_prefix('text', 8179)} || chr(10) || chr(10) || '[truncated]' END) AS shown FROM documents")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.envelope("text")).alias("shown"))


@query(f"SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE {_prefix('text', 1000)} || '…' END AS reason FROM documents")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.failure_reason("text").alias("reason"))


@query(r"""SELECT page_id, 'm{html="' || replace(replace(left(html, 300), '\', '\\'), '"', '\"') || '\a\x01\u00a0"}' AS labels FROM pages""")
def quoted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.left("html", F.lit(300)), F.lit("\x07\x01 "))
    return table(spark, sf_dir, "pages").select("page_id", T.render_labels(F.create_map(F.lit("__name__"), F.lit("m"), F.lit("html"), value)).alias("labels"))


@query("SELECT doc_id, printf('[%d] %s%s (%.2f)', doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' · ' || lang END, (doc_id % 100) / 100.0) AS head FROM documents")
def hit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.hit_header("doc_id", "source", path, F.col("doc_id") % 100 / 100).alias("head"))


@query("SELECT event_id, CAST(floor((event_id % 20 * 8192 + event_id % 5000) / 4) AS BIGINT) AS tokens FROM events")
def prompt_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.worst_case_prompt(F.col("event_id") % 20, F.col("event_id") % 5000).alias("tokens"))


@query(f"""WITH l AS (SELECT doc_id, rtrim(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), 1)) AS line FROM documents)
SELECT doc_id, CASE WHEN strlen(line) <= 90 THEN line ELSE {_prefix('line', 90)} || '…' END AS line FROM l""")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_line("text").alias("line"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value / 1024 ELSE value / 1048576 END AS s FROM events)
SELECT event_id, CASE WHEN s >= 1 THEN round(s, 2) WHEN s >= 0.001 THEN round(s, 3) ELSE round(s, 5) END AS shown FROM s""")
def rounded_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, F.col("value") / 1024).otherwise(F.col("value") / 1048576)
    return table(spark, sf_dir, "events").select("event_id", T.rounded_seconds(s).alias("shown"))


@query("""SELECT event_id, '{"tool":"' || event_type || '","arguments":"' || user_id || '"}' AS action, event_type AS root_cause, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_actions,
CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_evidence, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS INTEGER) END AS first_step FROM events""")
def finish_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next actions are a bare string, an array or absent; of three citations one can't be read."""
    e = table(spark, sf_dir, "events")
    actions = F.when(F.col("event_id") % 3 == 0, ',"next_actions":"look"').when(F.col("event_id") % 3 == 1, ',"next_actions":["a","b"]').otherwise("")
    cited = F.when(F.col("event_id") % 2 == 0, F.format_string(',"evidence":[{"step":%d},{"step":"x"},{"step":2,"note":"n"}]', "event_id")).otherwise("")
    body = F.concat(F.lit('{"root_cause":"'), "event_type", F.lit('"'), actions, cited, F.lit("}"))
    p = e.select("event_id", T.action_json("event_type", F.col("user_id").cast("string")).alias("action"), T.finish_payload(body).alias("p"))
    return p.select("event_id", "action", "p.root_cause", F.size("p.next_actions").alias("n_actions"), F.size("p.evidence").alias("n_evidence"), F.try_element_at("p.evidence", F.lit(1))["step"].alias("first_step"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/p/' || page_id WHEN 5 THEN '/' END AS path FROM pages""")
def probe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a path below the base may be probed: no second slash, scheme, space or backslash."""
    n = F.col("page_id").cast("string")
    cases = [F.concat(F.lit("/p/"), n), F.concat(F.lit("//evil/"), n), F.col("url"), F.concat(F.lit("/a b"), n), F.concat(F.lit("/a\\"), n), F.lit("/")]
    path = F.element_at(F.array(*cases), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.probe_path(path).alias("path"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' END AS format FROM documents")
def filename_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    cases = [F.concat(s, F.lit(".md")), F.concat(s, F.lit(".TXT")), F.concat(s, F.lit(".pdf")), F.concat(F.lit("a/"), s, F.lit(".md")), F.lit(".."), F.concat(F.repeat(s, F.lit(200)), F.lit(".md")), F.lit("")]
    return table(spark, sf_dir, "documents").select("doc_id", T.filename_format(F.element_at(F.array(*cases), (F.col("doc_id") % 7 + 1).cast("int"))).alias("format"))


_KINDS = ["invalid", "not_found", "conflict", "gone", "too_large", "unsupported", "unavailable", "timeout", "other", ""]


@query(f"""WITH k AS (SELECT event_id, (['{"','".join(_KINDS)}'])[event_id % 10 + 1] AS kind, event_id % 11 = 0 AS refused FROM events)
SELECT event_id, CASE WHEN refused THEN 'REFUSED' WHEN kind = 'timeout' THEN 'TIMEOUT' WHEN kind = '' THEN 'OK' ELSE 'ERROR' END AS tool,
CAST(([400, 404, 409, 410, 413, 415, 503, 504, 500, 500])[event_id % 10 + 1] AS INTEGER) AS http FROM k""")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.tool_status(kind, F.col("event_id") % 11 == 0).alias("tool"), T.http_status(kind).alias("http"))


@query("""SELECT event_id, event_id % 600 IN (0, 408, 429) OR event_id % 600 >= 500 AS again, least(CASE WHEN event_id % 4 = 0 THEN event_id % 25 ELSE 0.5 * pow(2, event_id % 8) END, 10)::DOUBLE AS delay FROM events""")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 25)
    return table(spark, sf_dir, "events").select("event_id", T.is_retryable(F.col("event_id") % 600).alias("again"), T.retry_delay(F.col("event_id") % 8 + 1, asked).alias("delay"))


@query("""SELECT event_id, 'id: ' || (epoch_us(ts) // 1000) || '-' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame,
CASE WHEN event_id % 3 = 0 THEN (epoch_us(ts) // 1000) || '-' || event_id ELSE '0-0' END AS after FROM events""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("id", F.concat_ws("-", F.unix_millis(F.col("ts").cast("timestamp")), "event_id"))
    seen = F.when(F.col("event_id") % 3 == 0, F.col("id")).when(F.col("event_id") % 3 == 1, F.concat("id", F.lit("x"))).otherwise("")
    return e.select("event_id", T.sse_frame("id", "event_type", "props").alias("frame"), T.resume_after(seen).alias("after"))


@query("""SELECT event_id, event_id % 4 = 0 AS ulid, event_id % 4 <> 1 AS request_id, event_id % 4 IN (0, 2) AS service FROM events""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    cases = [F.concat(F.lit("01"), F.lpad(n, 24, "0")), F.concat(n, F.lit(" x")), F.concat(F.lit("svc-"), n), F.concat(F.lit("A_"), n)]
    v = F.element_at(F.array(*cases), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return e.select("event_id", T.is_ulid("v").alias("ulid"), T.is_request_id("v").alias("request_id"), T.is_service("v").alias("service"))


@query("""SELECT conv_id, turn, printf('Step %d/8, tool calls %d/5. ', turn + 1, turn // 2) || CASE WHEN turn >= 7 THEN 'No step is left after this: finish.' WHEN turn = 6 THEN 'One more step is left: finish unless it decides the matter.' ELSE printf('%d more steps are left.', 7 - turn) END AS budget,
'Incident: ' || role || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Reported on: svc' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'slow' END AS incident,
CASE WHEN turn % 3 = 0 THEN '(no output)' ELSE 'slow' END AS observation FROM conversations""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, "  ").otherwise(" slow ")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.budget_message(F.col("turn") + 1, F.lit(8), F.floor(F.col("turn") / 2), F.lit(5)).alias("budget"),
        T.incident_message("role", F.when(F.col("turn") % 2 == 0, "svc"), said).alias("incident"), T.observation_text(said).alias("observation"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS wire, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) END AS parsed FROM events""")
def wire_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", T.wire_time(F.col("ts").cast("timestamp")).alias("wire"))
    said = F.when(F.col("event_id") % 2 == 0, F.col("wire")).otherwise(F.substring("wire", 1, 10))
    return e.select("event_id", "wire", F.unix_micros(T.parse_rfc3339(said)).alias("parsed"))


@query("""SELECT o_orderkey, substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(((epoch_us(o_orderdate) // 1000) >> 45) & 31 AS INTEGER) + 1, 1) || substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(((epoch_us(o_orderdate) // 1000) >> 40) & 31 AS INTEGER) + 1, 1)
|| substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(((epoch_us(o_orderdate) // 1000) >> 35) & 31 AS INTEGER) + 1, 1) AS head, true AS fine, true AS unique_id, epoch_us(o_orderdate) AS created_at, epoch_us(o_orderdate) AS updated_at FROM orders""")
def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that get ids of their own as they are inserted."""
    from tidewell.operators import store

    new = store.insert(table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("timestamp"), "o_orderkey")
    twice = new.groupBy("id").agg(F.count("*").alias("n"))
    return new.join(twice, "id").select("o_orderkey", F.left("id", F.lit(3)).alias("head"), T.is_ulid("id").alias("fine"), (F.col("n") == 1).alias("unique_id"), F.unix_micros("created_at").alias("created_at"), F.unix_micros("updated_at").alias("updated_at"))


@query("SELECT event_id, printf('svc%d: %d matching records%s%s', user_id, event_id, CASE WHEN event_id > 200 THEN ', showing the last 200' ELSE '' END, CASE WHEN event_id % 3 > 0 THEN printf('; %d unparseable lines skipped', event_id % 3) ELSE '' END) AS head FROM events")
def record_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = F.least("event_id", F.lit(200))
    return table(spark, sf_dir, "events").select("event_id", T.records_header(F.concat(F.lit("svc"), "user_id"), "event_id", returned, F.col("event_id") % 3).alias("head"))


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.concat_ws("-", F.unix_millis(F.col("ts").cast("timestamp")), "event_id").alias("id"), F.col("event_type").alias("event"), F.col("props").alias("data"), "event_id")


@query("SELECT event_id FROM events WHERE user_id = 7 AND ((epoch_us(ts) // 1000) > 1705000000000 OR (epoch_us(ts) // 1000) = 1705000000000 AND event_id > 5)")
def replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.replay(_run_events(spark, sf_dir), "7", "1705000000000-5").select("event_id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS n, max((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) AS last FROM events)
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id FROM r WHERE n <= 20 AND last >= (epoch_us(TIMESTAMP '2024-01-31') // 1000) - 86400000""")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return messages.retained(_run_events(spark, sf_dir), now, 20, 24).select("run_id", "event_id")


@query("""WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'signup' AND user_id % 2 = 0 GROUP BY 1)
SELECT CAST(e.user_id AS VARCHAR) AS run_id, count(*) AS events, max((epoch_us(e.ts) // 1000)) || '-' || (arg_max(e.event_id, ((epoch_us(e.ts) // 1000), e.event_id)) + 1) AS next
FROM events e LEFT JOIN m USING (user_id) WHERE mark IS NULL OR (epoch_us(e.ts) // 1000) > (epoch_us(mark) // 1000) OR (epoch_us(e.ts) // 1000) = (epoch_us(mark) // 1000) AND e.event_id > 0 AND e.ts > mark GROUP BY 1""")
def trimmed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second run is trimmed up to its last signup; the next id follows the last one all the same, as the clock stands still."""
    events = _run_events(spark, sf_dir)
    place = messages.split_id(F.col("id"))
    marks = events.filter("event = 'signup' and event_id >= 0 and cast(run_id as int) % 2 = 0").groupBy("run_id").agg(F.max_by("id", place).alias("upto"))
    left = messages.trimmed(events, marks)
    return left.groupBy("run_id").agg(F.count("*").alias("events"), messages.next_id(F.max_by("id", place), F.lit(0)).alias("next"))
