"""Lifecycle of documents and runs: conditional transitions and the reconciler's policy.

Tables are read-only, so a transition is a projection: the rows after it, and `changed`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Seconds and counts of the sweep."""

    pending_after: int = 60
    lease: int = 600
    run_lease: int = 900
    max_attempts: int = 3
    batch: int = 100
    interval: int = 30


COUNTERS = ("step_count", "tool_call_count", "prompt_tokens", "completion_tokens")


def _ago(at: Column, seconds) -> Column:
    return at - F.make_dt_interval(secs=seconds if isinstance(seconds, Column) else F.lit(float(seconds)))


def backoff_seconds(attempts: Column) -> Column:
    """A minute after the first attempt, five after any later one."""
    return F.when(attempts <= 1, 60).otherwise(300)


def document_category(at: Column, policy: Policy = Policy()) -> Column:
    """never_enqueued, abandoned or retryable for a due document (status, attempts, processing_started_at, updated_at), else null."""
    status, attempts = F.col("status"), F.col("attempts")
    wait = F.when(attempts <= 1, _ago(at, 60)).otherwise(_ago(at, 300))
    return (
        F.when((status == "PENDING") & (F.col("updated_at") < _ago(at, policy.pending_after)), "never_enqueued")
        .when((status == "PROCESSING") & (F.col("processing_started_at") < _ago(at, policy.lease)), "abandoned")
        .when((status == "FAILED") & (attempts < policy.max_attempts) & (F.col("updated_at") < wait), "retryable")
    )


def run_category(at: Column, policy: Policy = Policy()) -> Column:
    status = F.col("status")
    return (
        F.when((status == "PENDING") & (F.col("updated_at") < _ago(at, policy.pending_after)), "never_enqueued")
        .when((status == "RUNNING") & (F.col("attempts") < policy.max_attempts) & (F.col("started_at") < _ago(at, policy.run_lease)), "abandoned")
    )


def sweep(rows: DataFrame, category: Column, policy: Policy = Policy(), key: str = "id") -> DataFrame:
    """The due rows of each category, oldest first, `batch` at most."""
    from tidewell.operators.store import top_per_category

    return top_per_category(rows.withColumn("category", category).filter(F.col("category").isNotNull()), "category", key, policy.batch)


def sweep_stats(swept: DataFrame, failed: Column | None = None) -> DataFrame:
    bad = F.lit(False) if failed is None else failed
    return swept.groupBy("category").agg(F.count("*").alias("candidates"), F.count_if(~bad).alias("enqueued"), F.count_if(bad).alias("failed"))


def _touched(rows: DataFrame, at: Column | None) -> DataFrame:
    """rows with `at` as updated_at where they changed."""
    return rows.withColumn("updated_at", F.when(F.col("changed"), at).otherwise(F.col("updated_at"))) if at is not None and "updated_at" in rows.columns else rows


def claim_documents(rows: DataFrame, at: Column, policy: Policy = Policy()) -> DataFrame:
    """PENDING, FAILED, or PROCESSING past its lease becomes PROCESSING with one attempt more."""
    free = F.col("status").isin("PENDING", "FAILED") | F.coalesce((F.col("status") == "PROCESSING") & (F.col("processing_started_at") < _ago(at, policy.lease)), F.lit(False))
    out = (
        rows.withColumn("changed", free)
        .withColumn("attempts", F.when(F.col("changed"), F.col("attempts") + 1).otherwise(F.col("attempts")))
        .withColumn("processing_started_at", F.when(F.col("changed"), at).otherwise(F.col("processing_started_at")))
        .withColumn("status", F.when(F.col("changed"), F.lit("PROCESSING")).otherwise(F.col("status")))
    )
    return _touched(out, at)


def claim_runs(rows: DataFrame, at: Column, policy: Policy = Policy()) -> DataFrame:
    """PENDING, or RUNNING past its lease, becomes RUNNING; counters start anew. FAILED runs are never claimed."""
    free = (F.col("status") == "PENDING") | F.coalesce((F.col("status") == "RUNNING") & (F.col("started_at") < _ago(at, policy.run_lease)), F.lit(False))
    out = rows.withColumn("changed", free)
    for c in COUNTERS:
        if c in rows.columns:
            out = out.withColumn(c, F.when(F.col("changed"), 0).otherwise(F.col(c)))
    out = (
        out.withColumn("attempts", F.col("attempts") + F.col("changed").cast("int"))
        .withColumn("started_at", F.when(F.col("changed"), at).otherwise(F.col("started_at")))
        .withColumn("status", F.when(F.col("changed"), F.lit("RUNNING")).otherwise(F.col("status")))
    )
    return _touched(out, at)


def drop_claimed_children(child: DataFrame, claimed: DataFrame) -> DataFrame:
    """A claim deletes what the attempt before it wrote."""
    return child.join(claimed.filter("changed").select(F.col("id").alias("run_id")), "run_id", "left_anti")


def finish_documents(rows: DataFrame, results: DataFrame, at: Column | None = None) -> DataFrame:
    """results (id, ok, reason, chunks): only PROCESSING rows change; READY clears the reason.

    A result that is delivered again has no second effect; of differing results for one id a good one counts, and the larger of them.
    """
    one = results.groupBy("id").agg(F.max(F.struct("ok", "chunks", "reason")).alias("_r"))
    out = rows.join(one, "id", "left").withColumn("changed", F.coalesce((F.col("status") == "PROCESSING") & F.col("_r.ok").isNotNull(), F.lit(False)))
    good, bad = F.col("changed") & F.col("_r.ok"), F.col("changed") & ~F.col("_r.ok")
    out = (
        out.withColumn("status", F.when(good, "READY").when(bad, "FAILED").otherwise(F.col("status")))
        .withColumn("failure_reason", F.when(good, F.lit(None)).when(bad, F.nullif("_r.reason", F.lit(""))).otherwise(F.col("failure_reason")))
        .withColumn("chunk_count", F.when(good, F.col("_r.chunks")).otherwise(F.col("chunk_count")))
        .drop("_r")
    )
    return _touched(out, at)


def finish_runs(rows: DataFrame, outcomes: DataFrame, at: Column | None = None) -> DataFrame:
    """outcomes (id, attempt, status, stop_reason and what else a run ends with): fenced, only the RUNNING attempt that it names changes.

    final_result, error and the counters are taken from the outcome where both sides have them, finished_at is `at`;
    an outcome that is delivered again has no second effect, of differing ones for one attempt the largest counts.
    """
    given = [c for c in ("status", "stop_reason", "final_result", "error", *COUNTERS) if c in outcomes.columns and c in rows.columns]
    one = outcomes.groupBy("id", F.col("attempt").alias("attempts")).agg(F.max(F.struct(*given)).alias("_o"))
    out = rows.join(one, ["id", "attempts"], "left").withColumn("changed", F.coalesce((F.col("status") == "RUNNING") & F.col("_o").isNotNull(), F.lit(False)))
    for c in given:
        value = F.col("_o")[c]
        out = out.withColumn(c, F.when(F.col("changed"), F.nullif(value, F.lit("")) if c in ("stop_reason", "error", "final_result") else value).otherwise(F.col(c)))
    if at is not None and "finished_at" in rows.columns:
        out = out.withColumn("finished_at", F.when(F.col("changed"), at).otherwise(F.col("finished_at")))
    return _touched(out.drop("_o"), at).select(*rows.columns, "changed")


def dead_letters(rows: DataFrame, triaged: DataFrame, at: Column, reason: str = "unsupported message version") -> DataFrame:
    """rows after messages (subject_id, disposition) of an unknown version: each one's document is claimed and, if it could be, FAILED; others are skipped."""
    known = triaged.filter("disposition = 'poison_known_id'").select(F.col("subject_id").alias("id")).distinct().withColumn("_named", F.lit(True))
    marked = rows.join(known, "id", "left")
    claimed = claim_documents(marked.filter("_named").drop("_named"), at)
    results = claimed.filter("changed").select("id", F.lit(False).alias("ok"), F.lit(reason).alias("reason"), F.lit(0).alias("chunks"))
    return marked.filter("_named is null").drop("_named").unionByName(finish_documents(claimed.drop("changed"), results, at).drop("changed").select(*rows.columns))


def with_active_owner(runs: DataFrame, owner: str = "incident_id") -> DataFrame:
    return runs.withColumn("active_" + owner, F.when(F.col("status").isin("PENDING", "RUNNING"), F.col(owner)))


def is_terminal(status: Column) -> Column:
    return status.isin("SUCCEEDED", "FAILED")
