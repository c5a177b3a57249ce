"""Dense retrieval and its evaluation over embeddings, documents and benchmark."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import vector
from tidewell.operators import retrieval
from tidewell.plans.registry import query, table

_SCORE = "round((1 + list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.embedding)) / 2, 6)"
_QUERY0 = "SELECT CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id = 0"
_CENTROIDS = """q AS (SELECT label AS query_id, list(m ORDER BY i) AS embedding FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def _first_vector(chunks: DataFrame) -> list[float]:
    return chunks.filter("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT c.vec_id, c.label, {_SCORE} AS score FROM embeddings c, ({_QUERY0}) q ORDER BY {_SCORE} DESC, vec_id LIMIT 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    return retrieval.knn(chunks, _first_vector(chunks), 10, key="vec_id").withColumn("score", F.round("score", 6))


@query(f"SELECT c.vec_id, c.label, {_SCORE} AS score FROM embeddings c, ({_QUERY0}) q WHERE c.label = 3 ORDER BY {_SCORE} DESC, vec_id LIMIT 5")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    return retrieval.knn(chunks, _first_vector(chunks), retrieval.AGENT_K, key="vec_id", label=3).withColumn("score", F.round("score", 6))


def label_centroids(chunks: DataFrame) -> DataFrame:
    """One query per label: the mean of its vectors."""
    parts = chunks.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("query_vector")).withColumnRenamed("label", "query_id")


@query(f"""WITH {_CENTROIDS} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.query_id, c.vec_id, {_SCORE} AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.embedding) DESC, c.vec_id) AS rank FROM embeddings c, q) WHERE rank <= 10""")
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    return retrieval.knn_batch(chunks, label_centroids(chunks), 10, key="vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_CENTROIDS}, r AS (
  SELECT q.query_id, c.vec_id, c.label, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.embedding) DESC, c.vec_id) AS rank FROM embeddings c, q),
h AS (SELECT query_id, coalesce(min(rank) FILTER (WHERE label = query_id AND rank <= 10 AND (query_id % 2 <> 0 OR vec_id % 2 = 1)), 0) AS hit FROM r GROUP BY 1)
SELECT k, round(avg(CASE WHEN hit BETWEEN 1 AND k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM h, (SELECT CAST(unnest([1, 3, 5, 10]) AS INTEGER) AS k) GROUP BY k""")
def hit_rate_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    queries = label_centroids(chunks)
    content = F.concat(F.lit("chunk "), F.col("vec_id") % 2)
    found = retrieval.knn_batch(chunks, queries, 10, key="vec_id").select("query_id", "rank", F.col("label").cast("string").alias("source"), content.alias("content"))
    labels = chunks.select(F.col("label").alias("query_id")).distinct().select("query_id", F.col("query_id").cast("string").alias("source"), F.when(F.col("query_id") % 2 == 0, "chunk 1").otherwise("").alias("must_contain"))
    return retrieval.hit_rate(retrieval.first_hits(queries, found, labels), 1, 3, 5, 10).withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return retrieval.containing(docs, items, "doc_id").select("item_id", "doc_id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = 'src' || (b.item_id % 5) AND contains(d.text, b.text))")
def unresolved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 5).alias("source"), F.col("text").alias("must_contain"))
    return retrieval.unresolved_labels(labels, table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content")), "doc_id").select("item_id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def unmatched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").join(label_match(spark, sf_dir), "item_id", "left_anti").select("item_id")


@query("""WITH h AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, strlen(text) AS bytes FROM documents),
r AS (SELECT lang, rank, count(*) OVER (PARTITION BY lang) AS total, sum(bytes + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY lang ORDER BY rank) AS used FROM h)
SELECT lang, CAST(coalesce(max(rank) FILTER (WHERE used + CASE WHEN rank < total THEN length(printf('\n\n(%d of %d hits shown; the rest did not fit)', rank, total)) ELSE 0 END <= 8192), 1) AS INTEGER) AS shown,
  max(total) AS total FROM r GROUP BY lang""".replace("\\n", "\n"))
def prefix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("rank"), F.octet_length("text").alias("bytes"))
    return retrieval.prefix_that_fits(hits, "lang")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm, len(embedding) = 64 AS right_size FROM embeddings")
def embedding_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm("embedding"), 6).alias("norm"), (F.size("embedding") == 64).alias("right_size"))
