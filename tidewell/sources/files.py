"""Files as sources: corpora, evaluation sets, logs, metric snapshots, saved API answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPLOAD_BYTES = 10 << 20
#: All files below a folder, which is listed in parallel; a glob over its folders is listed by the driver alone, one by one. Their names are no columns.
INSIDE = {"recursiveFileLookup": "true"}


def write_files(rows: DataFrame, by: str, text: str, folder: str, *order: str) -> None:
    """A text file in a folder of its own for each value of `by`, its lines in this order.

    Files cost more than their bytes, by which Spark would gather them in a task or two; so the number of tasks is given.
    Tasks move their own files into place; else the driver moves all of them, one by one.
    """
    session = rows.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartition(tasks, by).sortWithinPartitions(by, *order).select(by, text)
    placed.write.partitionBy(by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)


def binary_files(spark: SparkSession, path: str, most: int = UPLOAD_BYTES) -> DataFrame:
    """path, filename, content, size_bytes, content_sha256, too_large; a file over the limit keeps no content."""
    files = spark.read.format("binaryFile").options(**INSIDE).load(path)
    over = F.col("length") > most
    return files.select(
        "path", F.substring_index("path", "/", -1).alias("filename"), F.when(~over, F.col("content")).alias("content"), F.col("length").alias("size_bytes"),
        F.when(~over, F.sha2("content", 256)).alias("content_sha256"), over.alias("too_large"),
    )


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """service, line_no, raw: one row a line in file order; the service is that of the file's folder (service=<name>), else the file's name.

    Files are read in splits; lines are numbered in their split, and splits in their file.
    """
    meta = "_metadata.file_path", "_metadata.file_block_start"
    lines = spark.read.options(**INSIDE).option("lineSep", "\n").text(path).select(F.col(meta[0]).alias("path"), F.col(meta[1]).alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    inside = Window.partitionBy("path", "block")
    lines = lines.withColumn("n", F.row_number().over(inside.orderBy("at")) - 1)
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("lines"))
    before = sizes.select("path", "block", (F.sum("lines").over(Window.partitionBy("path").orderBy("block")) - F.col("lines")).alias("before"))
    folder = F.regexp_extract("path", r"/service=([^/]+)/[^/]*$", 1)
    service = F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_replace(F.substring_index("path", "/", -1), r"\.log$", ""))
    return lines.join(before, ["path", "block"]).filter("raw <> ''").select(service.alias("service"), (F.col("before") + F.col("n")).alias("line_no"), "raw")


def save_file(content: bytes, folder: str, name: str, most: int = UPLOAD_BYTES) -> dict:
    """Write one upload under a bare name, never over another: size_bytes, content_sha256. Refuses too large ones and names with a path in them."""
    import hashlib
    import os

    if not name or name in (".", "..") or any(c in name for c in "/\\\0"):
        raise ValueError(f"not a file name: {name!r}")
    if len(content) > most:
        raise ValueError(f"{len(content)} bytes; at most {most}")
    with open(os.path.join(folder, name), "xb") as f:
        f.write(content)
    return {"size_bytes": len(content), "content_sha256": hashlib.sha256(content).hexdigest()}


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, note, source, must_contain: a row per label; raises for a set without queries or a query without text or labels."""
    schema = "queries ARRAY<STRUCT<query: STRING, note: STRING, relevant: ARRAY<STRUCT<source: STRING, must_contain: STRING>>>>"
    queries = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode_outer("queries").alias("query_id", "q"))
    bad = queries.filter("q is null or coalesce(trim(q.query), '') = '' or coalesce(size(q.relevant), 0) < 1").limit(1).count()
    if bad or queries.isEmpty():
        raise ValueError("every query needs text and labels, and there must be one")
    return queries.select("query_id", "q.query", "q.note", F.explode("q.relevant").alias("l")).select("query_id", "query", "note", "l.source", "l.must_contain")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("documents ARRAY<STRUCT<source: STRING, service: STRING, document_type: STRING>>").json(path, multiLine=True).select(F.inline("documents"))


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of JSON lines, in as many files as it takes."""
    return spark.read.schema("source STRING, service STRING, document_type STRING").json(path)


def corpus(files: DataFrame, listed: DataFrame) -> DataFrame:
    """files joined to their manifest entry; raises if a file isn't listed."""
    unlisted = [r["filename"] for r in files.join(listed, files["filename"] == listed["source"], "left_anti").select("filename").limit(5).collect()]
    if unlisted:
        raise ValueError(f"not in the manifest: {', '.join(unlisted)}")
    return files.join(listed, files["filename"] == listed["source"])


def saved_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


_VECTOR = "ARRAY<STRUCT<metric: MAP<STRING,STRING>, value: ARRAY<STRING>, values: ARRAY<ARRAY<STRING>>>>"


def _time(seconds):
    return F.timestamp_micros(F.round(seconds.cast("double") * 1_000_000).cast("long"))


def _number(text):
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def decode_metrics(answers: DataFrame, body: str = "body") -> DataFrame:
    """Saved query answers (JSON) to result_type, labels, ts, value, text; the answer's own type decides.

    A failed answer gives one row with its error. A value that isn't a number counts 0.
    """
    head = F.from_json(body, "status STRING, error STRING, data STRUCT<resultType: STRING, result: STRING>")
    a = answers.withColumn("_a", head).select(*answers.columns, F.col("_a.status").alias("status"), F.col("_a.error").alias("error"), F.col("_a.data.resultType").alias("result_type"), F.col("_a.data.result").alias("_r"))
    keys = [*answers.columns, "status", "error", "result_type"]
    flat = F.col("result_type").isin("scalar", "string")
    series = a.filter(~flat).select(*keys, F.explode(F.from_json("_r", _VECTOR)).alias("s"))
    points = series.select(*keys, F.col("s.metric").alias("labels"), F.explode(F.coalesce("s.values", F.array("s.value"))).alias("p"))
    single = a.filter(flat).select(*keys, F.create_map().cast("map<string,string>").alias("labels"), F.from_json("_r", "ARRAY<STRING>").alias("p"))
    both = points.unionByName(single).select(*keys, "labels", _time(F.col("p")[0]).alias("ts"), F.when(F.col("result_type") != "string", _number(F.col("p")[1])).alias("value"), F.when(F.col("result_type") == "string", F.col("p")[1]).alias("text"))
    failed = a.filter("result_type is null").select(*keys, F.lit(None).cast("map<string,string>").alias("labels"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
    return both.unionByName(failed)


def exposition(scrapes: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Samples of text-exposition bodies: key, kind, name, labels, value; kind comes from the last # TYPE of the family.

    Histogram series keep their suffix in `part` (bucket, sum, count); raises for a line that can't be read.
    """
    lines = scrapes.select(key, F.posexplode(F.split(body, "\r?\n")).alias("n", "line")).filter("trim(line) <> ''")
    family = F.when(F.col("line").startswith("# TYPE "), F.struct(F.split("line", r"\s+")[2].alias("name"), F.split("line", r"\s+")[3].alias("kind")))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("t", F.last(family, ignorenulls=True).over(upto)).filter(~F.col("line").startswith("#"))
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?\d+)?\s*$"
    fine = F.assert_true(F.col("line").rlike(pattern), F.concat(F.lit("unreadable sample: "), F.col("line")))
    full = F.regexp_extract("line", pattern, 1)
    pairs = F.regexp_extract_all(F.regexp_extract("line", pattern, 2), F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*="(?:[^"\\]|\\.)*")'))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.regexp_replace(p, '^[^=]*="', ""), '"$', "").alias("value"))))
    part = F.when(F.col("t.kind") == "histogram", F.regexp_extract(full, "_(bucket|sum|count)$", 1)).otherwise("")
    return lines.filter(fine.isNull()).select(
        key, F.coalesce("t.kind", F.lit("untyped")).alias("kind"), F.when(part == "", full).otherwise(F.col("t.name")).alias("name"), part.alias("part"), labels.alias("labels"),
        F.regexp_extract("line", pattern, 3).try_cast("double").alias("value"),
    )


def snapshot(samples: DataFrame, key: str) -> DataFrame:
    """Sums over label sets: key, kind, name, value (gauges, counters), sum and count (histograms)."""
    pick = lambda p: F.sum(F.when(F.col("part") == p, F.col("value")))
    return samples.groupBy(key, "kind", "name").agg(pick("").alias("value"), pick("sum").alias("sum"), pick("count").cast("long").alias("count"))


def request_counts(samples: DataFrame, key: str, name: str = "http_request_duration_seconds") -> DataFrame:
    """key, route, status, value of a request histogram's counts."""
    some = samples.filter((F.col("name") == name) & (F.col("part") == "count"))
    return some.groupBy(key, F.col("labels")["route"].alias("route"), F.col("labels")["status"].alias("status")).agg(F.sum("value").cast("long").alias("value"))
