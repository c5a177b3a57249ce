"""Structured logs: one JSON object a line, filtered, tailed and counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import parse_rfc3339

#: Levels from least to most severe.
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR"]
LINE_BYTES = 1 << 20
TAIL_DEFAULT, TAIL_MOST = 200, 1000


def level_number(level: Column) -> Column:
    return reduce(lambda c, x: c.when(level == x[1], x[0]), list(enumerate(LEVELS))[1:], F.when(level == LEVELS[0], 0))


def parse_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """ts, level, level_no, msg, attrs, parse_ok for each raw line.

    A line is a record if it is a JSON object with a string `time` in RFC 3339, a known `level` and a
    string `msg`, and is no longer than LINE_BYTES; its other keys are attributes.
    """
    line = F.regexp_replace(F.col(raw), "\r$", "")
    v = F.try_parse_json(F.when(F.octet_length(line) <= LINE_BYTES, line))
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    attrs = F.map_filter(F.from_json(line, "map<string,string>"), lambda k, _: ~k.isin("time", "level", "msg"))
    out = lines.withColumn("ts", parse_rfc3339(text("time"))).withColumn("level", text("level")).withColumn("msg", text("msg"))
    out = out.withColumn("level_no", level_number(F.col("level")))
    ok = F.coalesce(is_object, F.lit(False)) & F.col("ts").isNotNull() & F.col("level_no").isNotNull() & F.col("msg").isNotNull()
    return out.withColumn("parse_ok", ok).withColumn("attrs", F.when(F.col("parse_ok"), attrs))


def matching(records: DataFrame, minimum: str = "INFO", since=None, until=None, contains: str | None = None, raw: str = "raw") -> DataFrame:
    """Records of `minimum` level or above, in [since, until), whose raw line has the substring in any case."""
    if minimum not in LEVELS:
        raise ValueError(f"unknown level {minimum!r}; one of {', '.join(LEVELS)}")
    out = records.filter(F.col("parse_ok") & (F.col("level_no") >= LEVELS.index(minimum)))
    if since is not None:
        out = out.filter(F.col("ts") >= since)
    if until is not None:
        out = out.filter(F.col("ts") < until)
    return containing(out, contains, raw) if contains else out


def containing(lines: DataFrame, part: str, raw: str = "raw") -> DataFrame:
    """Lines that have the substring in any case; on raw lines, before they are parsed, it saves most of the work."""
    return lines.filter(F.contains(F.lower(raw), F.lit(part.lower())))


def tail(records: DataFrame, n: int | None = None, order: str = "line_no") -> DataFrame:
    """The last n in arrival order, oldest first."""
    n = TAIL_DEFAULT if not n or n < 1 else min(n, TAIL_MOST)
    return records.orderBy(F.desc(order)).limit(n).orderBy(order)


def counts(records: DataFrame, wanted: Column) -> DataFrame:
    """matched and unparseable lines."""
    return records.agg(F.count_if(F.col("parse_ok") & wanted).alias("matched"), F.count_if(~F.col("parse_ok")).alias("unparseable"))
