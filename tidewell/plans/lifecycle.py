"""Lifecycle queries: orders are documents (P pending, O processing, F failed or ready by priority)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import lifecycle
from tidewell.plans.registry import query, table


def _at():
    return F.lit("1998-06-01 00:00:00").cast("timestamp")

_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'PROCESSING' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'READY' ELSE 'FAILED' END END"
_ROWS = f"""r AS (SELECT o_orderkey AS id, {_STATUS} AS status, CAST(o_orderkey % 4 AS INTEGER) AS attempts, o_orderdate AS updated_at,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS started_at FROM orders)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "PROCESSING").when(F.col("o_orderpriority") == "1-URGENT", "READY").otherwise("FAILED")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), at.alias("updated_at"), F.when(F.col("o_orderkey") % 7 != 0, at).alias("processing_started_at"))


_DUE = """CASE WHEN status = 'PENDING' AND updated_at < TIMESTAMP '1998-06-01' - INTERVAL 60 SECOND THEN 'never_enqueued'
  WHEN status = 'PROCESSING' AND started_at < TIMESTAMP '1998-06-01' - INTERVAL 600 SECOND THEN 'abandoned'
  WHEN status = 'FAILED' AND attempts < 3 AND updated_at < TIMESTAMP '1998-06-01' - (CASE WHEN attempts <= 1 THEN INTERVAL 60 SECOND ELSE INTERVAL 300 SECOND END) THEN 'retryable' END"""


@query(f"WITH {_ROWS} SELECT id, status, {_DUE} AS category FROM r WHERE {_DUE} IS NOT NULL")
def lease_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).withColumn("category", lifecycle.document_category(_at())).filter("category is not null").select("id", "status", "category")


@query("SELECT CAST(n AS INTEGER) AS attempts, CAST(CASE WHEN n <= 1 THEN 60 ELSE 300 END AS INTEGER) AS wait, count(o_orderkey) AS rows FROM orders, LATERAL (SELECT o_orderkey % 5 AS n) GROUP BY 1, 2")
def backoff_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 5).cast("int")
    return table(spark, sf_dir, "orders").select(n.alias("attempts"), lifecycle.backoff_seconds(n).alias("wait")).groupBy("attempts", "wait").agg(F.count("*").alias("rows"))


@query(f"""WITH {_ROWS}, due AS (SELECT id, {_DUE} AS category FROM r), n AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS rank FROM due WHERE category IS NOT NULL)
SELECT category, count(*) AS candidates, count(*) FILTER (WHERE id % 10 <> 0) AS enqueued, count(*) FILTER (WHERE id % 10 = 0) AS failed FROM n WHERE rank <= 100 GROUP BY 1""")
def reconcile_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = lifecycle.sweep(entities(spark, sf_dir), lifecycle.document_category(_at()))
    return lifecycle.sweep_stats(swept, F.col("id") % 10 == 0)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 60 SECOND THEN 'never_enqueued' WHEN o_orderstatus = 'O' AND o_orderkey % 4 < 3 AND o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 900 SECOND THEN 'abandoned' END AS category FROM orders""")
def run_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("id", lifecycle.run_category(_at()).alias("category"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('P', 'O') THEN o_custkey END AS active_o_custkey, o_orderstatus = 'F' AS terminal FROM orders")
def active_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.with_active_owner(_runs(spark, sf_dir), "o_custkey").select("id", "active_o_custkey", lifecycle.is_terminal(F.col("status")).alias("terminal"))


_AT = "epoch_us(TIMESTAMP '1998-06-01')"


@query(f"""WITH {_ROWS}, c AS (SELECT *, status IN ('PENDING', 'FAILED') OR coalesce(status = 'PROCESSING' AND started_at < TIMESTAMP '1998-06-01' - INTERVAL 600 SECOND, false) AS changed FROM r)
SELECT id, CASE WHEN changed THEN 'PROCESSING' ELSE status END AS status, CAST(attempts + CASE WHEN changed THEN 1 ELSE 0 END AS INTEGER) AS attempts, changed, CASE WHEN changed THEN {_AT} ELSE epoch_us(updated_at) END AS updated_at FROM c""")
def claim_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.claim_documents(entities(spark, sf_dir), _at()).select("id", "status", "attempts", "changed", F.unix_micros("updated_at").alias("updated_at"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), "o_custkey", status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), at.alias("started_at"), at.alias("updated_at"), F.lit(None).cast("timestamp").alias("finished_at"),
        *[F.lit(None).cast("string").alias(c) for c in ("stop_reason", "final_result", "error")], *[F.lit(9).alias(c) for c in lifecycle.COUNTERS],
    )


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderdate AS started_at, CAST(o_orderkey % 4 AS INTEGER) AS attempts FROM orders),
c AS (SELECT *, s = 'P' OR s = 'O' AND started_at < TIMESTAMP '1998-06-01' - INTERVAL 900 SECOND AS changed FROM r)
SELECT id, CASE WHEN changed THEN 'RUNNING' WHEN s = 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, CAST(attempts + CASE WHEN changed THEN 1 ELSE 0 END AS INTEGER) AS attempts,
  (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = c.id) * CASE WHEN changed THEN 0 ELSE 1 END AS children, CAST(CASE WHEN changed THEN 0 ELSE 9 END AS INTEGER) AS step_count, CASE WHEN changed THEN {_AT} ELSE epoch_us(started_at) END AS updated_at FROM c""")
def run_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim starts the run's counters anew and deletes its children."""
    claimed = lifecycle.claim_runs(_runs(spark, sf_dir), _at())
    left = lifecycle.drop_claimed_children(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")), claimed)
    n = left.groupBy("run_id").agg(F.count("*").alias("children"))
    return claimed.join(n, claimed["id"] == n["run_id"], "left").select("id", "status", "attempts", F.coalesce("children", F.lit(0)).cast("long").alias("children"), "step_count", F.unix_micros("updated_at").alias("updated_at"))


@query(f"""WITH {_ROWS}, c AS (SELECT *, status = 'PROCESSING' AND id % 2 = 0 AS changed, id % 3 = 0 AS bad FROM r)
SELECT id, CASE WHEN changed THEN CASE WHEN bad THEN 'FAILED' ELSE 'READY' END ELSE status END AS status, CASE WHEN NOT changed THEN 'old' WHEN bad THEN 'no content' END AS failure_reason,
  CAST(CASE WHEN changed AND NOT bad THEN 5 ELSE 0 END AS INTEGER) AS chunk_count, CASE WHEN changed THEN {_AT} ELSE epoch_us(updated_at) END AS updated_at FROM c""")
def terminal_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result is delivered three times."""
    rows = entities(spark, sf_dir).withColumn("failure_reason", F.lit("old")).withColumn("chunk_count", F.lit(0))
    results = rows.filter("id % 2 = 0").select("id", (F.col("id") % 3 != 0).alias("ok"), F.lit("no content").alias("reason"), F.lit(5).alias("chunks"))
    out = lifecycle.finish_documents(rows, results.unionByName(results).unionByName(results), _at())
    return out.select("id", "status", "failure_reason", "chunk_count", F.unix_micros("updated_at").alias("updated_at"))


@query(f"""WITH r AS (SELECT *, o_orderkey AS id, o_orderstatus = 'O' AND o_orderkey % 4 = o_orderkey % 3 AS changed, o_orderkey % 5 = 0 AS bad FROM orders)
SELECT id, CASE WHEN changed THEN CASE WHEN bad THEN 'FAILED' ELSE 'SUCCEEDED' END WHEN o_orderstatus = 'O' THEN 'RUNNING' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'FAILED' END AS status, changed,
  CASE WHEN changed THEN CASE WHEN bad THEN 'ERROR' ELSE 'COMPLETED' END END AS stop_reason, CASE WHEN changed AND NOT bad THEN 'result ' || id END AS final_result, CASE WHEN changed AND bad THEN 'it broke' END AS error,
  CASE WHEN changed THEN {_AT} END AS finished_at, CAST(CASE WHEN changed THEN id % 7 ELSE 9 END AS INTEGER) AS tool_call_count, CASE WHEN changed THEN {_AT} ELSE epoch_us(o_orderdate) END AS updated_at FROM r""")
def fenced_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of attempts that may be over by now, each delivered twice."""
    bad = F.col("o_orderkey") % 5 == 0
    outcomes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("attempt"), F.when(bad, "FAILED").otherwise("SUCCEEDED").alias("status"), F.when(bad, "ERROR").otherwise("COMPLETED").alias("stop_reason"),
        F.when(bad, "").otherwise(F.concat(F.lit("result "), "o_orderkey")).alias("final_result"), F.when(bad, "it broke").otherwise("").alias("error"), *[(F.col("o_orderkey") % 7).cast("int").alias(c) for c in lifecycle.COUNTERS],
    )
    out = lifecycle.finish_runs(_runs(spark, sf_dir), outcomes.unionByName(outcomes), _at())
    return out.select("id", "status", "changed", "stop_reason", "final_result", "error", F.unix_micros("finished_at").alias("finished_at"), "tool_call_count", F.unix_micros("updated_at").alias("updated_at"))
