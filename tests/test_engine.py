"""Ingestion and the engine's queries, end to end."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.engine import Engine, fake_embedder, ingest
from tidewell.operators.metrics import Refusal

AT = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def ingested(spark):
    row = lambda i, name, form: (i, name, "/f", form, 1, "x", "payment" if i != "c" else None, "runbook", "PENDING", "old" if i == "b" else None, 0, 0, None, AT, AT)
    documents = spark.createDataFrame([row("a", "a.md", "markdown"), row("b", "b.txt", "text"), row("c", "c.txt", "text")], schemas.DOCUMENTS)
    files = spark.createDataFrame([("a", bytearray(b"# Pool\n\nThe pool is full.\n\n## Disk\n\nThe disk is slow.")), ("b", bytearray(b"plain text")), ("c", bytearray(b"\xff\xfe"))], "id STRING, content BINARY")
    old = spark.createDataFrame([("a", "a-9", 9, None, None, "a.md", "", "stale", [1.0] * 64, AT), ("z", "z-0", 0, None, None, "z.md", "", "kept", [1.0] * 64, AT)], schemas.CHUNKS)
    return [df.cache() for df in ingest(documents, files, old, fake_embedder(), F.lit(AT))]


def test_ingest(ingested):
    documents, index = ingested
    assert {r["id"]: (r["status"], r["chunk_count"], r["attempts"], r["failure_reason"]) for r in documents.collect()} == {
        "a": ("READY", 2, 1, None), "b": ("READY", 1, 1, None), "c": ("FAILED", 0, 1, "not UTF-8")}
    assert sorted(r["chunk_id"] for r in index.collect()) == ["a-0", "a-1", "b-0", "z-0"]


def test_search_finds_the_same_text(ingested):
    e = Engine({"chunks": ingested[1], "documents": ingested[0]}, fake_embedder())
    best = e.search("Pool > Disk\n\nThe disk is slow.", k=1).first()
    assert best["chunk_id"] == "a-1" and best["score"] == pytest.approx(1, abs=1e-6)
    assert [r["chunk_id"] for r in e.search("x", service="payment", document_type="runbook").orderBy("chunk_id").collect()] == ["a-0", "a-1", "b-0"]
    page, cursor = e.documents(limit=2)
    assert [r["id"] for r in page] == ["c", "b"] and cursor == "b" and "storage_path" not in page[0]
    assert e.documents(status="READY", cursor=cursor)[0][0]["id"] == "a"


def test_logs_and_metrics(spark):
    lines = [("pay", i, '{"time":"2026-01-01T00:00:0%dZ","level":"WARN","msg":"m%d"}' % (i, i)) for i in range(5)]
    samples = [(datetime(2026, 1, 1, 0, i), "up", {"job": f"j{i % 2}"}, float(i)) for i in range(6)]
    e = Engine({"logs": spark.createDataFrame(lines, "service STRING, line_no LONG, raw STRING"), "samples": spark.createDataFrame(samples, schemas.SAMPLES)}, fake_embedder())
    assert [r["msg"] for r in e.read_logs("pay", limit=2).collect()] == ["m3", "m4"] and e.read_logs("pay", "ERROR").count() == 0
    got = {r["job"]: (r["points"], r["min"], r["last"]) for r in e.query_metrics("up", AT, datetime(2026, 1, 1, 1), ["job"]).collect()}
    assert got == {"j0": (3, 0, 4), "j1": (3, 1, 5)}
    with pytest.raises(Refusal):
        e.query_metrics("up", AT, datetime(2026, 1, 2), ["job"])


def test_schemas(spark):
    schemas.create_tables(spark)
    assert schemas.schema_version(spark, "documents") == 1 and spark.table("evidence").count() == 0
    schemas.drop_tables(spark)
    assert not spark.catalog.tableExists("documents")
