"""Schemas of the stored entities, as Spark DDL, and the closed sets of their columns."""

from __future__ import annotations

DOCUMENTS = (
    "id STRING NOT NULL, filename STRING NOT NULL, storage_path STRING NOT NULL, format STRING NOT NULL, size_bytes BIGINT NOT NULL,"
    " content_sha256 STRING NOT NULL, service STRING, document_type STRING NOT NULL, status STRING NOT NULL, failure_reason STRING,"
    " chunk_count INT NOT NULL, attempts INT NOT NULL, processing_started_at TIMESTAMP, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
)
INCIDENTS = "id STRING NOT NULL, title STRING NOT NULL, description STRING NOT NULL, service STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
RUNS = (
    "id STRING NOT NULL, incident_id STRING NOT NULL, status STRING NOT NULL, stop_reason STRING, max_steps INT NOT NULL, max_tool_calls INT NOT NULL,"
    " max_duration_seconds INT NOT NULL, max_prompt_tokens INT NOT NULL, model STRING NOT NULL, step_count INT NOT NULL, tool_call_count INT NOT NULL,"
    " prompt_tokens INT NOT NULL, completion_tokens INT NOT NULL, final_result STRING, error STRING, attempts INT NOT NULL, started_at TIMESTAMP,"
    " finished_at TIMESTAMP, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
)
STEPS = (
    "id STRING NOT NULL, run_id STRING NOT NULL, step_number INT NOT NULL, action_type STRING NOT NULL, action STRING NOT NULL, observation_summary STRING,"
    " observation_bytes INT NOT NULL, truncated BOOLEAN NOT NULL, status STRING NOT NULL, error STRING, duration_ms INT NOT NULL, created_at TIMESTAMP NOT NULL"
)
TOOL_CALLS = (
    "id STRING NOT NULL, run_id STRING NOT NULL, step_id STRING NOT NULL, tool_name STRING NOT NULL, arguments STRING NOT NULL, status STRING NOT NULL,"
    " result_summary STRING, result_bytes INT NOT NULL, truncated BOOLEAN NOT NULL, error STRING, duration_ms INT NOT NULL, created_at TIMESTAMP NOT NULL"
)
EVIDENCE = (
    "id STRING NOT NULL, run_id STRING NOT NULL, step_id STRING NOT NULL, tool_call_id STRING, source_type STRING NOT NULL, source_ref STRING NOT NULL,"
    " document_id STRING, summary STRING NOT NULL, note STRING, created_at TIMESTAMP NOT NULL"
)
CHUNKS = (
    "document_id STRING, chunk_id STRING, chunk_index INT, service STRING, document_type STRING, source STRING, heading_path STRING, content STRING,"
    " embedding ARRAY<FLOAT>, indexed_at TIMESTAMP"
)
MESSAGES = "topic STRING, key STRING, value STRING, headers MAP<STRING,STRING>, partition INT, offset BIGINT"
RUN_EVENTS = "run_id STRING, id STRING, event STRING, data STRING"
SAMPLES = "ts TIMESTAMP, name STRING, labels MAP<STRING,STRING>, value DOUBLE"
TABLES = {"documents": DOCUMENTS, "incidents": INCIDENTS, "agent_runs": RUNS, "agent_steps": STEPS, "tool_calls": TOOL_CALLS, "evidence": EVIDENCE}

#: Fixed values.
DOMAINS = {
    "documents.status": ["PENDING", "PROCESSING", "READY", "FAILED"],
    "documents.format": ["markdown", "text"],
    "documents.document_type": ["runbook", "postmortem", "service_doc"],
    "agent_runs.status": ["PENDING", "RUNNING", "SUCCEEDED", "FAILED"],
    "agent_runs.stop_reason": ["COMPLETED", "MAX_STEPS", "MAX_TOOL_CALLS", "TIMEOUT", "TOKEN_BUDGET", "ERROR", "CANCELLED"],
    "agent_steps.action_type": ["retrieve", "tool_call", "finish", "none"],
    "agent_steps.status": ["OK", "ERROR"],
    "tool_calls.status": ["OK", "REFUSED", "ERROR", "TIMEOUT"],
    "evidence.source_type": ["retrieval", "tool"],
}
VERSION = 1


def create_tables(spark, database: str = "default", using: str = "parquet") -> None:
    """Create the catalog tables that aren't there yet, with the schema's version as a property."""
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING {using} TBLPROPERTIES ('schema.version' = '{VERSION}')")


def drop_tables(spark, database: str = "default") -> None:
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def schema_version(spark, table: str) -> int | None:
    rows = [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r["key"] == "schema.version"]
    return int(rows[0]) if rows else None
