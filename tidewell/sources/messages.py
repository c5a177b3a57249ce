"""Keyed messages: versioned envelopes, their triage, and the log as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import is_ulid
from tidewell.schemas import MESSAGES

VERSION = 1


def encode(subject: Column, field: str, message_id: Column, at: Column) -> Column:
    return F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), message_id.alias("message_id"), at.alias("produced_at"), subject.alias(field)))


def triage(messages: DataFrame, field: str, value: str = "value") -> DataFrame:
    """subject_id and disposition: ok; poison_known_id (another version, whose id can be trusted); poison_unknown (bad JSON or id)."""
    v = F.try_parse_json(F.col(value).cast("string"))
    subject, version = F.try_variant_get(v, f"$.{field}", "string"), F.try_variant_get(v, "$.schema_version", "int")
    known = F.coalesce(is_ulid(subject), F.lit(False))
    return messages.withColumn("subject_id", F.when(known, subject)).withColumn(
        "disposition", F.when(~known, "poison_unknown").when(F.coalesce(version == VERSION, F.lit(False)), "ok").otherwise("poison_known_id")
    )


def log_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The message log as a stream of Parquet files, from the earliest; the checkpoint keeps the offsets."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def produce(messages: DataFrame, path: str) -> None:
    """Append messages; rows of one key stay together and in order."""
    messages.repartition("key").sortWithinPartitions("key", "offset").write.mode("append").parquet(path)


def split_id(event_id: Column) -> Column:
    """<ms>-<seq> as STRUCT<ms, seq>, which orders as the stream does."""
    return F.struct(F.substring_index(event_id, "-", 1).cast("long").alias("ms"), F.substring_index(event_id, "-", -1).cast("long").alias("seq"))


def next_id(last_id: Column, now_ms: Column) -> Column:
    """The id after last_id (null for none): of this millisecond, or of the last one's if the clock stands behind; ids rise even when a run's events are trimmed."""
    last = split_id(last_id)
    fresh = last_id.isNull() | (now_ms > last["ms"])
    return F.concat_ws("-", F.when(fresh, now_ms).otherwise(last["ms"]).cast("string"), F.when(fresh, 0).otherwise(last["seq"] + 1).cast("string"))


def trimmed(events: DataFrame, marks: DataFrame) -> DataFrame:
    """events without those up to their run's mark (run_id, upto), the last id when the run was trimmed."""
    place, mark = split_id(F.col("id")), split_id(F.col("_upto"))
    gone = (place["ms"] < mark["ms"]) | (place["ms"] == mark["ms"]) & (place["seq"] <= mark["seq"])
    last = marks.select("run_id", F.col("upto").alias("_upto"))
    return events.join(last, "run_id", "left").filter(F.col("_upto").isNull() | ~gone).drop("_upto")


def follow(stream: DataFrame, field: str) -> DataFrame:
    """The readable messages of a stream, with their headers; malformed ones are passed over and their offsets with them."""
    return triage(stream, field).filter("disposition = 'ok'").drop("disposition")


def check_partitions(messages: DataFrame, wanted: int) -> None:
    """Refuse a log with fewer partitions than wanted; one that has no message yet will have as many as are written."""
    n = messages.agg(F.count_distinct("partition")).first()[0]
    if 0 < n < wanted:
        raise ValueError(f"{n} partitions; {wanted} are wanted")


def replay(events: DataFrame, run_id: str, after: str = "0-0") -> DataFrame:
    """A run's events strictly after an id, oldest first."""
    ms, _, seq = after.partition("-")
    place = split_id(F.col("id"))
    later = (place["ms"] > int(ms)) | (place["ms"] == int(ms)) & (place["seq"] > int(seq))
    return events.filter((F.col("run_id") == run_id) & later).orderBy(place["ms"], place["seq"])


def retained(events: DataFrame, now: Column, most: int = 1000, hours: int = 24) -> DataFrame:
    """Retention: the newest `most` events of a run, none of a run that has been silent for `hours`."""
    from pyspark.sql import Window

    place = split_id(F.col("id"))
    w = Window.partitionBy("run_id")
    rows = events.withColumn("_n", F.row_number().over(w.orderBy(place["ms"].desc(), place["seq"].desc()))).withColumn("_last", F.max(place["ms"]).over(w))
    return rows.filter((F.col("_n") <= most) & (F.timestamp_millis("_last") >= now - F.expr(f"INTERVAL {hours} HOURS"))).drop("_n", "_last")
