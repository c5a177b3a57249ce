"""What the operators share: reading a table, cutting lineage, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run without these ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that saved() wrote, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        if not folder.rsplit("/", 1)[1].startswith("tidewell-"):
            raise ValueError(f"not a table of saved(): {folder}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: Column, name: str = "i") -> DataFrame:
    """df, written out, with a gapless number from 0 in this order; only the row counts of tasks are gathered in one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    tasks = placed.groupBy(F.shiftright("_at", 33).alias("_task")).agg(F.count("*").alias("_n"))
    before = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    out = placed.withColumn("_task", F.shiftright("_at", 33)).join(before, "_task")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*df.columns, name)


def bucketed(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """df written to the shared folder in buckets of `key`, a file for each, so that joins on the key leave it where it is.

    Only a table can have buckets; its name leaves the catalog at once, its files stay.
    """
    spark = df.sparkSession
    n = min(100_000, max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"tidewell_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words, null counting as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


WORD = re.compile(WORD_PATTERN)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that can be reached.

    Alternates the large-star and small-star steps; each round is written out, so a lost executor
    costs a round at most, and hot nodes meet in partial aggregates and joins that can be split.
    """
    rounds = saved(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = rounds.union(rounds.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        rounds = saved(down.union(low.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct(), "cc")
        now = rounds.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return rounds.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                rounds.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
