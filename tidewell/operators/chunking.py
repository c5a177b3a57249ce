"""Heading-aware, token-bounded chunks of Markdown and plain text, as DataFrame operations.

A document's lines are folded into sections and units where the document is read (functions.markdown, in
Arrow batches, without a shuffle); higher-order functions fold units greedily into chunks, and small
sibling sections into one. Budgets are counted in twelfths of a token, so sums are exact.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import markdown
from tidewell.functions import text as T

TARGET, MOST_CHUNKS = 400, 2000


def weight(text: Column) -> Column:
    """Twelfths of a token, before rounding up."""
    other = F.char_length(F.regexp_replace(text, T._CJK, ""))
    return 8 * (F.char_length(text) - other) + 3 * other


_BREAK, _FEED = 6, 3  # a blank line, a line feed


def text_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One section per document: its paragraphs, split at lines of white space."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"[ \t]+$", "")))
    folded = F.array_join(F.transform(lines, lambda x: F.when(F.trim(F.regexp_replace(x, r"\s", "")) == "", F.lit("\x00")).otherwise(x)), "\n")
    paragraphs = F.filter(F.split(F.regexp_replace(folded, "(^|\n)\x00(?=\n|$)", "\x01"), "\x01+\n?"), lambda p: p != "")
    units = F.transform(paragraphs, lambda p: F.struct(p.alias("text"), F.lit(False).alias("tight")))
    return docs.select(key, F.lit(0).alias("section"), F.lit(0).alias("level"), F.lit("").alias("title"), F.array().cast("array<string>").alias("path"), units.alias("units"))


def markdown_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sections of Markdown documents with their units (functions.markdown), each document in its own task; none for a null text."""
    names = [key, "section", "level", "title", "path", "units"]

    def rows(batches):
        for batch in batches:
            found = [(k, n, *s) for k, x in enumerate(batch.column(1).to_pylist()) if x is not None for n, s in enumerate(markdown.sections(x))]
            if found:
                at, section, level, title, path, units = zip(*found)
                made = pa.array([[{"text": t, "tight": tight} for t, tight in own] for own in units], pa.list_(pa.struct([("text", pa.string()), ("tight", pa.bool_())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(section, pa.int32()), pa.array(level, pa.int32()), pa.array(title), pa.array(path, pa.list_(pa.string())), made], names=names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, section int, level int, title string, path array<string>, units array<struct<text: string, tight: boolean>>"
    return docs.select(key, text).mapInArrow(rows, schema)


def _ends(weights: Column, path_weight: Column, target: Column) -> Column:
    """Where the chunks end that hold the units (w, tight) in order, greedily; a unit over budget stands alone. One fold over numbers."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"), F.lit(-1).alias("w"), F.lit(False).alias("tight"))

    def step(a, u):
        joined = a["w"] + F.when(a["tight"] & u["tight"], _FEED).otherwise(_BREAK) + u["w"]
        fits = (a["w"] >= 0) & (joined + path_weight <= 12 * target)
        return F.struct(
            F.when(fits | (a["w"] < 0), a["ends"]).otherwise(F.concat(a["ends"], F.array(a["n"]))).alias("ends"), (a["n"] + 1).alias("n"),
            F.when(fits, joined).otherwise(u["w"]).alias("w"), u["tight"].alias("tight"),
        )

    return F.aggregate(weights, start, step, lambda a: F.concat(a["ends"], F.array(a["n"])))


def _slices(array: Column, ends: Column) -> Column:
    """The parts of array that end at these places."""
    return F.transform(ends, lambda e, i: F.slice(array, F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)) + 1, e - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))))


def _joined(units: Column) -> Column:
    """Texts of units (text, tight), each after its separator."""
    parts = F.transform(units, lambda u, i: F.concat(F.when(i == 0, F.lit("")).when(u["tight"] & F.get(units, i - 1)["tight"], F.lit("\n")).otherwise(F.lit("\n\n")), u["text"]))
    return F.array_join(parts, "")


_BRIEF = "array<struct<depth:int,parent:string,pw:int,w:int>>"


def _run_ends(sections: Column, target: Column) -> Column:
    """Where runs of sections (depth, parent, pw, w) end: a run of siblings that fit together under their parent is one chunk. One fold over numbers and paths."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"), F.lit(0).alias("w"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("parent"))

    def step(a, x):
        joined = a["w"] + _BREAK + x["w"]
        goes = F.coalesce((a["depth"] > 0) & (a["depth"] == x["depth"]) & (a["parent"] == x["parent"]) & (a["w"] + x["pw"] <= 12 * target) & (joined + x["pw"] <= 12 * target), F.lit(False))
        return F.struct(
            F.when(goes | (a["n"] == 0), a["ends"]).otherwise(F.concat(a["ends"], F.array(a["n"]))).alias("ends"), (a["n"] + 1).alias("n"),
            F.when(goes, joined).otherwise(x["w"]).alias("w"), x["depth"].alias("depth"), x["parent"].alias("parent"),
        )

    return F.aggregate(sections, start, step, lambda a: F.concat(a["ends"], F.array(a["n"])))


def chunks(sections: DataFrame, key: str, target: int = TARGET) -> DataFrame:
    """key, chunk_index, heading_path, content, tokens: sections merged with siblings, kept, or packed by unit.

    Weights are computed once, for each unit and title; folds carry places and numbers, texts are joined at the end.
    """
    goal = F.lit(target)
    path_weight = lambda p: F.when(p == "", 0).otherwise(weight(p) + _BREAK)
    s = sections.filter(F.size("units") > 0).withColumn("depth", F.size("path"))
    s = s.withColumn("weights", F.transform("units", lambda u: F.struct(weight(u["text"]).alias("w"), u["tight"].alias("tight"))))
    gaps = F.transform("weights", lambda u, i: u["w"] + F.when(i == 0, 0).when(u["tight"] & F.get("weights", i - 1)["tight"], _FEED).otherwise(_BREAK))
    s = s.withColumn("bw", F.aggregate(gaps, F.lit(0), lambda a, g: a + g))
    s = s.withColumn("own", F.array_join("path", T.PATH_SEPARATOR)).withColumn("parent", F.when(F.col("depth") > 0, F.array_join(F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))), T.PATH_SEPARATOR)))
    s = s.withColumn("w", F.col("bw") + F.when(F.col("title") == "", 0).otherwise(3 * (F.col("level") + 1) + weight(F.col("title")) + _BREAK))
    s = s.withColumn("ow", path_weight(F.col("own"))).withColumn("pw", path_weight(F.coalesce("parent", F.lit(""))))
    fields = ("section", "depth", "own", "ow", "parent", "pw", "level", "title", "units", "weights", "bw", "w")
    per = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", F.struct(*fields).alias("s")))).alias("s")).select(key, F.transform("s", lambda x: x["s"]).alias("s"))
    per = per.withColumn("ends", _run_ends(F.transform("s", lambda x: F.struct(x["depth"], x["parent"], x["pw"], x["w"])).cast(_BRIEF), goal))
    run = per.select(key, F.posexplode(_slices(F.col("s"), F.col("ends"))).alias("run", "m"))
    run = run.withColumn("one", F.col("m")[0]).withColumn("several", F.size("m") > 1)
    run = run.withColumn("ends", F.when(~F.col("several") & (F.col("one.bw") + F.col("one.ow") > 12 * goal), _ends(F.col("one.weights"), F.col("one.ow"), goal)))
    head = lambda x: F.when(x["title"] == "", F.lit("")).otherwise(F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["title"], F.lit("\n\n")))
    merged = F.array(F.array_join(F.transform("m", lambda x: F.concat(head(x), _joined(x["units"]))), "\n\n"))
    packed = F.transform(_slices(F.col("one.units"), F.col("ends")), _joined)
    bodies = F.when(F.col("several"), merged).when(F.col("ends").isNull(), F.array(_joined(F.col("one.units")))).otherwise(packed)
    path = F.when(F.col("several"), F.col("one.parent")).otherwise(F.col("one.own"))
    each = run.withColumn("heading_path", path).select(key, "run", "heading_path", F.posexplode(bodies).alias("pos", "text"))
    content = T.embedded_text("heading_path", F.regexp_replace("text", r"^\n+|\n+$", ""))
    index = (F.row_number().over(Window.partitionBy(key).orderBy("run", "pos")) - 1).cast("int")
    return each.select(key, index.alias("chunk_index"), "heading_path", content.alias("content")).withColumn("tokens", T.estimate_tokens("content"))


def chunk_documents(docs: DataFrame, key: str = "document_id", target: int = TARGET, most: int = MOST_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of docs (key, format, content BINARY or text STRING); rejected: key, reason."""
    if "text" not in docs.columns:
        docs = docs.withColumn("text", T.normalize("content"))
    good = docs.filter(F.col("text").isNotNull() & F.col("format").isin("markdown", "text"))
    made = chunks(text_sections(good.filter("format = 'text'"), key).unionByName(markdown_sections(good.filter("format = 'markdown'"), key)), key, target)
    counted = docs.join(made.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    reason = (
        F.when(F.col("text").isNull(), "not UTF-8").when(~F.col("format").isin("markdown", "text"), "unknown format")
        .when(F.col("n").isNull(), "no content").when(F.col("n") > most, "too many chunks")
    )
    rejected = counted.select(key, reason.alias("reason")).filter("reason is not null")
    return made.join(rejected, key, "left_anti"), rejected
