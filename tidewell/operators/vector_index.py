"""A partitioned vector index: lists round trained centroids, written by list; a search reads the lists that it probes.

The index holds every row, whatever the sample that its centroids come from. A list is cut into
slots of about SLOT rows, so one that holds a third of all rows is many tasks' work. A search deals
(query, list) pairs to the slots of their lists. A task's rows come slot by slot, a slot's own vectors
before its queries: Python holds one slot and one Arrow batch, however many there are, multiplies
BATCH queries at a time and keeps the best k, before the last ranking shuffles k rows a query and slot.
Probing all lists is the exact way.

Layout below a folder: rows/list=<n>/..., centroids (list, centroid, n), and schema, the rows' columns. Scores are those of
retrieval.knn: (1 + cosine) / 2. A null, empty or zero vector, or one with a null or non-finite component, isn't indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidewell.functions import vector
from tidewell.operators.retrieval import clamp_k

#: Centroids are trained on about so many rows for each list.
TRAINED = 256
LISTS_MOST = 65_536
SLOT = 4_096
#: Lists are chosen for so many queries at a time, and their vectors scored in numpy for so many.
QUERY_BLOCK, BATCH = 512, 128
#: More than a product of unit vectors can be off by.
NOISE = 1e-9


def _usable(x: Column) -> Column:
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return F.when(fine, vector.unit(x))


def build(chunks: DataFrame, path: str, lists: int | None = None, embedding: str = "embedding", seed: int = 7, rounds: int = 10) -> None:
    """Write the index of chunks below path, all columns kept; lists: as many as the root of the rows where it isn't given."""
    spark = chunks.sparkSession
    rows = chunks.withColumn("_unit", _usable(F.col(embedding))).filter(F.col("_unit").isNotNull())
    n = rows.count()
    lists = max(1, min(lists or round(math.sqrt(n)), LISTS_MOST, n))
    points = rows.select(array_to_vector("_unit").alias("features"))
    sample = points.sample(min(1.0, TRAINED * lists / n), seed) if n > TRAINED * lists else points
    if not n:
        centroids = spark.createDataFrame([], "list INT, centroid ARRAY<DOUBLE>")
        placed = rows.withColumn("list", F.lit(0))
    else:
        model = KMeans(k=lists, seed=seed, maxIter=rounds, initSteps=2).fit(sample)
        centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "list INT, centroid ARRAY<DOUBLE>")
        placed = model.setFeaturesCol("_v").setPredictionCol("list").transform(rows.withColumn("_v", array_to_vector("_unit"))).drop("_v")
    slots = max(1, n // SLOT)
    placed = placed.withColumn("_slot", F.pmod(F.xxhash64("_unit", F.monotonically_increasing_id()), F.lit(slots)).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(parts, "list", F.col("_slot") % max(1, slots // lists)).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    placed.drop("list").limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    counts = _rows(spark, path).groupBy("list").agg(F.count("*").alias("n"))
    centroids.join(counts, "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema.add("list", IntegerType())).parquet(f"{path}/rows")


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, _q, list): the `probes` lists whose centroids are nearest to each query (query_id, query_vector)."""
    known = spark.read.parquet(f"{path}/centroids").collect()  # LISTS_MOST at most
    ids = np.array([r["list"] for r in known], np.int32)
    centroids = np.array([r["centroid"] for r in known])

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                own = batch.slice(at, QUERY_BLOCK)
                q = np.array(own.column("_q").to_pylist())
                far = (centroids * centroids).sum(axis=1)[None, :] - 2 * q @ centroids.T
                chosen = np.argpartition(far, min(probes, len(ids)) - 1, axis=1)[:, :probes]
                take = pa.array(np.repeat(np.arange(len(q)), chosen.shape[1]))
                yield pa.RecordBatch.from_arrays([own.column("query_id").take(take), own.column("_q").take(take), pa.array(ids[chosen.ravel()])], names=["query_id", "_q", "list"])

    units = queries.select("query_id", _usable(F.col("query_vector")).alias("_q")).filter(F.col("_q").isNotNull())
    schema = f"query_id {dict(queries.dtypes)['query_id']}, _q array<double>, list int"
    return units.mapInArrow(rows, schema) if len(ids) else spark.createDataFrame([], schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int | None = None, probes: int = 8, key: str = "chunk_id", **equal) -> DataFrame:
    """query_id, rank, key, score of the k nearest indexed rows in the probed lists; filters hold before ranking.

    Only directories of probed lists are read: their numbers become a filter on the partition column.
    """
    k = clamp_k(k)
    pairs = probed(spark, path, queries, probes)
    wanted = [r[0] for r in pairs.select("list").distinct().collect()]  # LISTS_MOST at most
    known = spark.read.parquet(f"{path}/centroids").select("list", F.ceil(F.col("n") / SLOT).cast("int").alias("_slots"))
    table = _rows(spark, path).filter(F.col("list").isin(wanted))
    for column, value in equal.items():
        if value not in (None, ""):
            table = table.filter(F.col(column) == value)
    kinds = {**dict(table.dtypes), **dict(queries.dtypes)}
    none = lambda kind: F.lit(None).cast(kind)
    own = table.join(F.broadcast(known), "list").select("list", (F.col("_slot") % F.col("_slots")).alias("slot"), F.lit(False).alias("asks"), F.col(key).alias("key"), none(kinds["query_id"]).alias("query_id"), F.col("_unit").alias("u"))
    slots = F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))
    asked = pairs.join(F.broadcast(known), "list").select("list", slots.alias("slot"), F.lit(True).alias("asks"), none(kinds[key]).alias("key"), "query_id", F.col("_q").alias("u"))
    dealt = own.unionByName(asked).repartition("list", "slot").sortWithinPartitions("list", "slot", "asks", "key")

    def best(batches):
        slot, held = None, []  # the slot's own keys, in order, and vectors
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "slot", "asks")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1), batch.num_rows] if batch.num_rows else [0]
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                x = np.asarray(part.column("u").flatten()).reshape(high - low, -1)
                if slot != (slot := tuple(place[:2, low])):
                    held = []
                if not place[2, low]:
                    held.append((part.column("key").take(pa.array(np.arange(high - low))), x.copy()))  # copies, which don't keep the batch
                elif held:
                    if len(held) > 1:
                        held = [(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                    yield from nearest(part.column("query_id"), x, *held[0])

    def nearest(ids, q, keys, v):
        n = min(k, len(v))
        for at in range(0, len(q), BATCH):
            some, picked, scores = q[at : at + BATCH], [], []
            rough = some @ v.T  # equal vectors may differ in the last bits here, by their place
            least = np.partition(rough, len(v) - n, axis=1)[:, len(v) - n] - NOISE
            for one, near in zip(some, (np.flatnonzero(r >= x) for r, x in zip(rough, least))):
                exact = (v[near] * one).sum(axis=1)
                order = np.argsort(-exact, kind="stable")[:n]  # ties to the smaller key
                picked.append(near[order])
                scores.append((1 + exact[order]) / 2)
            take = pa.array(np.repeat(np.arange(at, at + len(some)), n))
            yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(pa.array(np.concatenate(picked))), pa.array(np.concatenate(scores))], names=["query_id", key, "score"])

    found = dealt.mapInArrow(best, f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def recall(found: DataFrame, exact: DataFrame, key: str = "chunk_id") -> float:
    """The share of exact's (query_id, key) rows that are found; 1 where there are none."""
    both = exact.select("query_id", key).join(found.select("query_id", key).withColumn("_hit", F.lit(1)), ["query_id", key], "left")
    return float(both.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0))).first()[0])


def probes_for(spark: SparkSession, path: str, queries: DataFrame, k: int | None = None, goal: float = 0.9, key: str = "chunk_id") -> int:
    """The fewest probes whose recall for these queries reaches the goal, by halving; vectors without clusters need most of the lists."""
    lists = max(1, spark.read.parquet(f"{path}/centroids").count())
    exact = search(spark, path, queries, k, lists, key).select("query_id", key).cache()
    low, high = 1, lists
    while low < high:
        middle = (low + high) // 2
        if recall(search(spark, path, queries, k, middle, key), exact, key) >= goal:
            high = middle
        else:
            low = middle + 1
    exact.unpersist()
    return low
