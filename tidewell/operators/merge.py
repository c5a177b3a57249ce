"""Merge on write: a table in key buckets, of which a batch rewrites only those that it touches.

Layout below a folder: rows/<version>-<writer>/bucket=<n>/*.parquet, and manifest/<version>.json, which
names for each bucket the folder that it lies in. A manifest is written last, under a name that must
not exist yet; before that, readers see the version before, and a batch that was ended half-way is
written anew. Buckets come from a hash of the key; rows of a batch meet the old rows of their bucket in
one join, spread over as many tasks as the session's shuffle has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: A manifest has a line for each bucket, which the driver reads.
BUCKETS_MOST = 100_000


class Conflict(RuntimeError):
    """Another writer has taken the version."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Table:
    """The table below path, with these key columns; order decides which of several rows of a key stays (the largest, ties by all other columns)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, schema, buckets: int = BUCKETS):
        if not 0 < buckets <= BUCKETS_MOST:
            raise ValueError(f"buckets must lie between 1 and {BUCKETS_MOST}")
        self.spark, self.path, self.keys, self.order, self.schema, self.buckets = spark, path.rstrip("/"), keys, order, schema, buckets

    def versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.path}/manifest")
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted(int(name[:-5]) for x in found if (name := x.getPath().getName()).endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "done", "buckets": {bucket: folder}} of a version, the newest if none is named; empty before the first batch."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return {"version": 0, "done": None, "buckets": {}}
        fs, p = _fs(self.spark, f"{self.path}/manifest/{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: dict) -> DataFrame:
        paths = [f"{self.path}/rows/{folder}/bucket={b}" for b, folder in sorted(buckets.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)["buckets"])

    def find(self, rows: DataFrame) -> DataFrame:
        """The table's rows with the keys of `rows`; only the buckets of these keys are read."""
        wanted = {str(r[0]) for r in rows.select(self.bucket()).distinct().collect()}
        return self._read({b: v for b, v in self.manifest()["buckets"].items() if b in wanted}).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, batch: DataFrame, gone: Column | None = None, batch_id: int | None = None) -> int:
        """Put the batch's rows in place of those of the same keys, unless these are newer; rows where `gone` holds delete theirs.

        A batch_id that is already done changes nothing. Returns the version that holds the batch.
        """
        old = self.manifest()
        if batch_id is not None and old["done"] is not None and batch_id <= old["done"]:
            return old["version"]
        columns = self.batch_columns()
        rows = batch.select(*columns, (F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).alias("_gone"))
        touched = [str(r[0]) for r in rows.select(self.bucket()).distinct().collect()]  # BUCKETS_MOST at most
        if not touched and batch_id is None:
            return old["version"]
        before = self._read({b: old["buckets"][b] for b in touched if b in old["buckets"]}).select(*columns, F.lit(False).alias("_gone"))
        rest = [F.col(c).desc_nulls_last() for c in columns if c not in (*self.keys, self.order)]
        latest = Window.partitionBy("_bucket", *self.keys).orderBy(F.col(self.order).desc_nulls_last(), F.desc("_gone"), *rest)
        merged = before.unionByName(rows).withColumn("_bucket", self.bucket()).withColumn("_n", F.row_number().over(latest)).filter("_n = 1 and not _gone")
        version = old["version"] + 1
        out = merged.withColumnRenamed("_bucket", "bucket").select(*columns, "bucket")
        folder = f"{version}-{uuid.uuid4().hex}"
        out.write.partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")
        fs, p = _fs(self.spark, f"{self.path}/rows/{folder}")
        written = {x.getPath().getName()[7:] for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket=")}
        kept = {b: v for b, v in old["buckets"].items() if b not in touched}
        self._publish({"version": version, "done": batch_id if batch_id is not None else old["done"], "buckets": kept | {b: folder for b in touched if b in written}})
        return version

    def batch_columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def _publish(self, manifest: dict) -> None:
        """Make the version visible in one step: the file appears whole, by a rename that never replaces another."""
        target = f"{self.path}/manifest/{manifest['version']}.json"
        fs, p = _fs(self.spark, target + ".new")
        stream = fs.create(p, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, final = _fs(self.spark, target)
        if fs.exists(final) or not fs.rename(p, final):
            fs.delete(p, False)
            raise Conflict(f"version {manifest['version']} of {self.path} was written by another")

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests before the newest `keep`, and what only these or unfinished batches up to now need."""
        versions = self.versions()
        needed = {folder for v in versions[-keep:] for folder in self.manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            fs, p = _fs(self.spark, f"{self.path}/manifest/{v}.json")
            fs.delete(p, False)
        fs, p = _fs(self.spark, f"{self.path}/rows")
        for x in fs.listStatus(p) if versions else []:
            name = x.getPath().getName()
            if name not in needed and int(name.split("-")[0]) <= versions[-1]:
                fs.delete(x.getPath(), True)


def sink(table: Table, gone: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each micro-batch is merged once, however often it is delivered."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table.merge(batch, gone, batch_id)
        finally:
            batch.unpersist()

    return write
