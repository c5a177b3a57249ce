"""Entity reads and writes: paging, filters, unique keys, cascades, timelines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import store
from tidewell.plans.registry import query, table


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 21")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", 20, cursor=9000).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source = 'src3'")
def filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.filtered(table(spark, sf_dir, "documents"), lang="de", source="src3", title="").select("doc_id", "lang", "source")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_id(table(spark, sf_dir, "orders"), 42, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def existing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.existing(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("lang = 'fr'"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def corpus_minus_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT o_orderstatus, CAST(rank AS INTEGER) AS rank, o_orderkey FROM (
  SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 100""")
def category_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_per_category(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", 100).select("o_orderstatus", "rank", "o_orderkey")


@query("""SELECT category, o_orderkey FROM (
  SELECT 'urgent' AS category, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(F.lit("urgent").alias("category"), "o_orderkey")
    return urgent.unionByName(orders.filter("o_orderstatus = 'O'").select(F.lit("open").alias("category"), "o_orderkey"))


@query("SELECT DISTINCT event_type FROM events")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type").distinct()


@query("""WITH n AS (SELECT o_custkey, o_orderstatus IN ('O','P') AS active, row_number() OVER (PARTITION BY o_custkey, o_orderstatus IN ('O','P') ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 <> 0),
h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus IN ('O','P'))
SELECT o_custkey, count(*) AS rows, count(*) FILTER (WHERE active AND (n > 1 OR o_custkey IN (SELECT o_custkey FROM h))) AS conflicts FROM n GROUP BY 1""")
def active_unique_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders is in the table before."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    judged = store.insert_unless_active(rows.filter("o_orderkey % 3 = 0"), rows.filter("o_orderkey % 3 <> 0"), "o_custkey", "o_orderkey", ["O", "P"])
    return judged.groupBy("o_custkey").agg(F.count("*").alias("rows"), F.count_if("conflict").alias("conflicts"))


@query("""SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return store.delete_where_parent(table(spark, sf_dir, "lineitem"), gone, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("""SELECT o.o_orderkey, c.c_custkey AS o_custkey FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) c ON o.o_custkey = c.c_custkey""")
def set_null_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return store.null_where_missing(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), live, "o_custkey", "c_custkey")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("""SELECT doc_id, lang, CAST(1 AS INTEGER) AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
  UNION ALL SELECT doc_id, 'relabelled', 2 FROM labels WHERE quality = 1""")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("version"))
    new = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit("relabelled").alias("lang"), F.lit(2).alias("version"))
    return store.replace_children(old, new, "doc_id")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("run_id"), "turn", "role", F.octet_length("text").alias("bytes"))


@query("""WITH t AS (SELECT conv_id, turn, role, strlen(text) AS bytes FROM conversations)
SELECT s.conv_id AS run_id, s.turn, s.role, CAST(coalesce(max(a.turn), -1) AS BIGINT) AS call_turn, count(a.turn) AS n_evidence, CAST(coalesce(sum(a.bytes), 0) AS BIGINT) AS evidence_bytes
FROM t s LEFT JOIN t a ON a.conv_id = s.conv_id AND a.turn = s.turn + 1 AND a.role = 'assistant' GROUP BY 1, 2, 3""")
def run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are steps; the assistant's answer to a turn is its tool call and its evidence."""
    steps = _steps(spark, sf_dir)
    answers = steps.filter("role = 'assistant'").select("id", "run_id", F.concat_ws("-", "run_id", F.col("turn") - 1).alias("step_id"), "turn", "bytes")
    made = store.run_timeline(steps, answers, answers)
    return made.select("run_id", "turn", "role", F.coalesce("tool_call.turn", F.lit(-1)).cast("long").alias("call_turn"), F.size("evidence").cast("long").alias("n_evidence"), F.aggregate("evidence", F.lit(0).cast("long"), lambda a, e: a + e["bytes"]).alias("evidence_bytes"))


@query("""SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def run_incident_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT l_partkey AS document_id, count(*) AS citations, count(DISTINCT l_orderkey) AS runs FROM lineitem GROUP BY 1")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.citation_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_id"), F.col("l_orderkey").alias("run_id")))


@query("""WITH c AS (SELECT l_orderkey, l_partkey, min(l_suppkey) AS first FROM lineitem GROUP BY 1, 2)
SELECT o.o_custkey AS run_id, o.o_orderkey AS step, CASE WHEN o.o_orderstatus = 'F' THEN 'retrieval' ELSE 'tool' END AS source_type,
  CASE WHEN o.o_orderstatus = 'F' THEN CAST(c.first AS VARCHAR) ELSE o.o_orderpriority END AS source_ref, CASE WHEN o.o_orderstatus = 'F' THEN c.l_partkey END AS document_id
FROM c JOIN orders o ON o.o_orderkey = c.l_orderkey""")
def resolve_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are steps, finished ones retrievals; their lines are hits, of which the smallest supplier ranks first, and are cited once each."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("step_number"), "o_orderstatus", "o_orderpriority")
    steps = orders.select("run_id", "step_number", F.lit("s").alias("step_id"), F.when(F.col("o_orderstatus") == "F", "retrieve").otherwise("tool_call").alias("action_type"), F.col("o_orderpriority").alias("tool_name"), F.lit("").alias("summary"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    n = lines.count()
    lines = store.dealt_out(lines, n, store.TASK_ROWS, "l_orderkey").join(store.dealt_out(orders, n, store.TASK_ROWS, "step_number"), F.col("l_orderkey") == F.col("step_number"))
    hits = lines.select("run_id", "step_number", F.col("l_partkey").alias("document_id"), F.col("l_suppkey").alias("rank"), F.col("l_suppkey").cast("string").alias("source"), F.lit("").alias("content"))
    cited = lines.select("run_id", F.col("step_number").alias("step"), F.col("l_partkey").alias("document_id"), F.lit("").alias("note"))
    cited = store.dealt_out(cited, n, store.TASK_ROWS, "run_id", "step", "document_id").distinct()
    return store.resolve_evidence(cited, steps, hits, n).select("run_id", "step", "source_type", "source_ref", "document_id")
