"""What is refused, configured, written once, or reported."""

import os

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.functions import scoring
from tidewell.functions import text as T
from tidewell.operators import lifecycle, retrieval, store, traces
from tidewell.plans import flows
from tidewell.session import Settings, backing_table, ensure_index
from tidewell.sources import files, messages

SF = "/root/testdata/sf0.001"


def test_settings_report_every_problem():
    s = Settings({"port": "x", "wait": "-5s", "on": "maybe", "mode": "slow", "brokers": " a, ,b ", "jobs": "checkout=http://c,checkout=http://d,bad", "blank": "  "})
    assert s.names("brokers") == ["a", "b"] and s.text("blank", "d") == "d" and s.number("absent", 7) == 7
    assert (s.number("port", 1), s.seconds("wait", 2.0), s.flag("on", True), s.one_of("mode", "fast", "fast", "safe")) == (1, 2.0, True, "fast")
    assert s.targets("jobs")["checkout"] == "http://d"
    s.required("key")
    with pytest.raises(ValueError) as e:
        s.check()
    assert len(s.problems) == 7 and all(p in str(e.value) for p in s.problems)


@pytest.mark.parametrize("text,seconds", [("30s", 30), ("5m", 300), ("1h2m3s", 3723), ("250ms", 0.25)])
def test_durations(text, seconds):
    s = Settings({"d": text, "f": "T", "m": "SAFE"})
    assert s.seconds("d", 0) == seconds and s.flag("f", False) and s.one_of("m", "fast", "fast", "safe") == "safe"
    s.check()


def test_an_alias_has_one_table(spark, tmp_path):
    for name in ("edge_a", "edge_c", "edge_d"):
        spark.sql(f"DROP VIEW IF EXISTS {name}") if name != "edge_c" else spark.sql("DROP TABLE IF EXISTS edge_c")
    spark.sql("DROP TABLE IF EXISTS edge_a_v1")
    assert backing_table(spark, "edge_a") is None
    assert ensure_index(spark, "edge_a", "id STRING") == "edge_a_v1"
    spark.sql("INSERT INTO edge_a_v1 VALUES ('x')")
    assert backing_table(spark, "edge_a").endswith("edge_a_v1") and ensure_index(spark, "edge_a", "id STRING").endswith("edge_a_v1")
    spark.sql("CREATE TABLE edge_c (id STRING) USING parquet")
    spark.sql("INSERT INTO edge_c VALUES ('y')")
    with pytest.raises(ValueError, match="a table, not a view"):
        backing_table(spark, "edge_c")
    spark.sql("CREATE VIEW edge_d AS SELECT * FROM edge_c UNION ALL SELECT * FROM edge_a_v1")
    with pytest.raises(ValueError, match="2 tables"):
        backing_table(spark, "edge_d")
    for name in ("VIEW edge_d", "VIEW edge_a", "TABLE edge_c", "TABLE edge_a_v1"):
        spark.sql(f"DROP {name}")


def test_bounds_are_refused_at_the_edge():
    assert store.within("k", None, 1, 50, 10) == 10 and store.within("k", 50, 1, 50, 10) == 50
    for bad in (0, 51, -1):
        with pytest.raises(store.Refusal, match="from 1 to 50"):
            store.within("k", bad, 1, 50, 10)


def test_files_are_saved_once(tmp_path):
    assert files.save_file(b"abc", str(tmp_path), "a.md")["size_bytes"] == 3
    with pytest.raises(FileExistsError):
        files.save_file(b"abd", str(tmp_path), "a.md")
    for name in ("../a", "a/b", "", "..", "a\\b"):
        with pytest.raises(ValueError):
            files.save_file(b"x", str(tmp_path), name)
    with pytest.raises(ValueError):
        files.save_file(b"xx", str(tmp_path), "b.md", most=1)
    assert os.listdir(tmp_path) == ["a.md"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    with open(tmp_path / "svc.log", "w", newline="") as f:
        f.write("".join(f"line {i}\r\n" if i % 3 else "\n" for i in range(5000)) + "last")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.log_files(spark, str(tmp_path / "svc.log"))
        assert lines.select(F.spark_partition_id()).count() == 3334
        got = sorted((r["line_no"], r["raw"], r["service"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"line {i}\r", "svc") for i in range(5000) if i % 3] + [(5000, "last", "svc")]


def test_answers_must_pair(spark):
    inputs = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "index INT, text STRING")
    answers = lambda rows: spark.createDataFrame(rows, "index INT, embedding ARRAY<FLOAT>")
    good = [(2, [2.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])]
    assert [(r["text"], r["embedding"][0]) for r in retrieval.pair_embeddings(inputs, answers(good), 2).orderBy("index").collect()] == [("t0", 0.0), ("t1", 1.0), ("t2", 2.0)]
    for rows, said in ((good[:2], "2 answers for 3"), (good[:2] + [(0, [1.0, 1.0])], "twice"), (good[:2] + [(3, [1.0, 1.0])], "out of range"), (good[:2] + [(1, [1.0])], "2 components")):
        with pytest.raises(ValueError, match=said):
            retrieval.pair_embeddings(inputs, answers(rows), 2)


def test_phrases_of_any_length(spark, monkeypatch):
    texts = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "lazy dog"), (3, "a dog"), (4, "quick  brown fox")]
    phrases = [(1, "dog"), (2, "lazy dog"), (3, "brown fox jumps"), (4, "quick brown fox jumps over the lazy"), (5, "ick brown fox jum"), (6, "quick  brown fox"), (7, "cat")]
    t = spark.createDataFrame(texts, "doc_id INT, text STRING")
    p = spark.createDataFrame(phrases, "item_id INT, phrase STRING")
    got = sorted((r["item_id"], r["doc_id"]) for r in retrieval.containing(t, p, "doc_id").collect())
    assert got == sorted((i, d) for i, x in phrases for d, y in texts if x in y)
    long = retrieval.containing(t, p.filter("item_id in (3, 4, 5, 6)"), "doc_id")
    assert "NestedLoop" not in long._jdf.queryExecution().executedPlan().toString()
    assert retrieval.containing(t, p.limit(0), "doc_id").count() == 0
    monkeypatch.setattr(retrieval, "SHORT_PHRASES", 2)
    with pytest.raises(ValueError, match="3 phrases"):
        retrieval.containing(t, p, "doc_id")


def test_results_have_one_effect(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("a", "PROCESSING", "old", 0, 1), ("b", "READY", None, 4, 1)], "id STRING, status STRING, failure_reason STRING, chunk_count INT, attempts INT").withColumn("updated_at", F.lit(None).cast("timestamp"))
    results = spark.createDataFrame([("a", True, "", 3), ("a", True, "", 3), ("a", False, "x", 0), ("b", False, "x", 0)], "id STRING, ok BOOLEAN, reason STRING, chunks INT")
    got = {r["id"]: r for r in lifecycle.finish_documents(rows, results, at).collect()}
    assert len(got) == 2 and (got["a"]["status"], got["a"]["failure_reason"], got["a"]["chunk_count"]) == ("READY", None, 3) and got["a"]["updated_at"] is not None
    assert not got["b"]["changed"] and got["b"]["updated_at"] is None


def test_a_failed_document_waits_after_its_failure(spark):
    """updated_at moves with each transition, so backoff counts from the failure."""
    rows = spark.sql("SELECT 'a' id, 'PROCESSING' status, 1 attempts, '' failure_reason, 0 chunk_count, timestamp '2024-01-01 00:00:00' processing_started_at, timestamp '2024-01-01 00:00:00' updated_at")
    results = spark.createDataFrame([("a", False, "x", 0)], "id STRING, ok BOOLEAN, reason STRING, chunks INT")
    after = lifecycle.finish_documents(rows, results, F.expr("timestamp '2024-01-01 00:05:00'"))
    due = lambda at: after.select(lifecycle.document_category(F.expr(f"timestamp '{at}'")).alias("c")).first()["c"]
    assert due("2024-01-01 00:05:30") is None and due("2024-01-01 00:06:01") == "retryable"


def test_scenarios(spark):
    rules = scoring.scenarios(spark)
    assert rules.count() == 8 and rules.filter("healthy").count() == 2
    gone = spark.createDataFrame([("nothing", "x", "y")], "scenario STRING, root_cause STRING, affected_service STRING")
    with pytest.raises(ValueError, match="no such scenario: nothing"):
        traces.rescored(gone, rules, scoring.mark())


def test_ids_rise_after_a_trim(spark):
    row = spark.range(1).select(messages.next_id(F.lit("5-3"), F.lit(4)).alias("a"), messages.next_id(F.lit("5-3"), F.lit(9)).alias("b"), messages.next_id(F.lit(None).cast("string"), F.lit(9)).alias("c")).first()
    assert tuple(row) == ("5-4", "9-0", "9-0")


def test_partitions_are_checked(spark):
    log = spark.createDataFrame([(0,), (1,)], "partition INT")
    messages.check_partitions(log, 2)
    messages.check_partitions(log.limit(0), 2)
    with pytest.raises(ValueError, match="2 partitions; 3"):
        messages.check_partitions(log, 3)


def test_quoting(spark):
    given = 'a"b\\c\n\t\r\x07\x01\x7f é​😀'
    assert spark.range(1).select(T.quoted(F.lit(given)).alias("q")).first()["q"] == '"a\\"b\\\\c\\n\\t\\r\\a\\x01\\x7f é\\u200b😀"'


def test_reports(spark):
    reports = flows.report_files(spark, SF)
    assert set(reports) == {"retrieval", "agent", "lab"} and all(x.startswith("# ") and x.count("\n|") > 3 for x in reports.values())


def test_ulids_sort_by_time(spark):
    rows = spark.range(50).select(T.ulid(F.timestamp_millis(F.col("id") * 1000), "id").alias("u"), "id").orderBy("u").collect()
    assert [r["id"] for r in rows] == list(range(50)) and len({r["u"] for r in rows}) == 50
    assert schemas.VERSION == 1
