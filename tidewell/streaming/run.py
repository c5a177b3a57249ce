"""Running streams: idempotent sinks, and a bounded run whose result is read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or on this machine where it is unset and all runs here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return (folder or tempfile.gettempdir()).rstrip("/") + f"/tidewell-stream-{uuid.uuid4().hex}"


def once_per_batch(path: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a batch that is delivered again overwrites what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upsert(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key in versions of one table: path/v=<batch>."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v={batch_id - 1}"
        rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch) if batch_id else batch
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now, and read what it wrote."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{base}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    writer.foreachBatch(once_per_batch(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*")


def parquet_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def with_state_store(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """Run work with the state store that processors with state need, then put the session's own back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return work()
    finally:
        spark.conf.set(key, before)
