"""The engine's front: ingestion, search, logs, metrics, runs and reconciliation over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vector
from tidewell.operators import chunking, lifecycle, logs, metrics, retrieval, store

Embedder = Callable[[Column], Column]


def ingest(documents: DataFrame, files: DataFrame, index: DataFrame, embed: Embedder, at: Column, target: int = chunking.TARGET) -> tuple[DataFrame, DataFrame]:
    """One pass of ingestion: (documents after it, index after it).

    documents that may be claimed are; their files (id, content) are chunked and embedded; all chunks
    of a document are replaced at once, or none if it is rejected, and its row becomes READY or FAILED.
    """
    claimed = lifecycle.claim_documents(documents, at)
    work = claimed.filter("changed").select(F.col("id").alias("document_id"), "format", "service", "document_type", F.col("filename").alias("source"))
    chunks, rejected = chunking.chunk_documents(work.join(files.select(F.col("id").alias("document_id"), "content"), "document_id"), target=target)
    new = chunks.join(work.drop("format"), "document_id").select(
        "document_id", T.chunk_id("document_id", "chunk_index").alias("chunk_id"), "chunk_index", "service", "document_type", "source", "heading_path", "content",
        embed(F.col("content")).alias("embedding"), at.alias("indexed_at"),
    )
    done = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("chunks")).select("id", F.lit(True).alias("ok"), F.lit("").alias("reason"), "chunks")
    failed = rejected.select(F.col("document_id").alias("id"), F.lit(False).alias("ok"), T.failure_reason("reason").alias("reason"), F.lit(0).alias("chunks"))
    after = lifecycle.finish_documents(claimed.drop("changed"), done.unionByName(failed), at).drop("changed")
    return after.select(*documents.columns), store.replace_children(index, new.select(*index.columns), "document_id")


class Engine:
    """Queries over the tables documents, chunks, runs, steps, tool_calls, evidence, logs (service, line_no, raw) and samples (ts, name, labels, value)."""

    def __init__(self, tables: dict[str, DataFrame], embed: Embedder):
        self.tables, self.embed = tables, embed

    def search(self, text: str, k: int | None = None, service: str = "", document_type: str = "") -> DataFrame:
        chunks = self.tables["chunks"]
        query = chunks.sparkSession.range(1).select(self.embed(F.lit(text)).alias("v")).first()["v"]
        k = store.within("k", k, 1, retrieval.K_MOST, retrieval.K_DEFAULT)
        return store.wire(retrieval.knn(chunks, query, k, service=service, document_type=document_type))

    def documents(self, limit: int | None = None, cursor: str = "", **equal) -> tuple[list, str]:
        limit = store.within("limit", limit, 1, store.LARGEST_PAGE, store.DEFAULT_PAGE)
        rows = store.wire(store.filtered(self.tables["documents"], **equal))
        return store.page_and_cursor(rows, "id", limit, cursor)

    def run_detail(self, run_id: str) -> DataFrame:
        of = {n: self.tables[n].filter(F.col("run_id") == run_id) for n in ("steps", "tool_calls", "evidence")}
        return store.run_timeline(of["steps"], of["tool_calls"], of["evidence"]).orderBy("step_number")

    def read_logs(self, service: str, level: str = "INFO", since=None, until=None, contains: str = "", limit: int | None = None) -> DataFrame:
        limit = store.within("limit", limit, 1, logs.TAIL_MOST, logs.TAIL_DEFAULT)
        lines = self.tables["logs"].filter(F.col("service") == service)
        return logs.tail(logs.matching(logs.parse_lines(lines), level, since, until, contains), limit)

    def query_metrics(self, name: str, start, end, by: list[str]) -> DataFrame:
        metrics.check_window(start, end)
        rows = self.tables["samples"].filter((F.col("name") == name) & F.col("ts").between(start, end))
        rows = rows.select("ts", "value", *[F.col("labels")[k].alias(k) for k in by])
        if by:
            metrics.check_series(rows.withColumn("name", F.lit(name)), by, "name")
        return metrics.describe(rows, by)

    def due(self, at: Column, policy: lifecycle.Policy = lifecycle.Policy()) -> DataFrame:
        return lifecycle.sweep(self.tables["documents"], lifecycle.document_category(at, policy), policy)


def fake_embedder(dimension: int = 64) -> Embedder:
    return lambda text: vector.fake_embedding(text, dimension)
