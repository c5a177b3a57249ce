"""Reads and writes of stored entities as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import ulid

DEFAULT_PAGE, LARGEST_PAGE = 20, 100


class Refusal(ValueError):
    """A request that is refused, with what would be accepted."""


def within(name: str, value: int | None, least: int, most: int, default: int) -> int:
    """A bounded argument as it comes from outside: absent is the default, out of bounds is refused. (Inside, page_size and clamp_k clamp.)"""
    if value is None:
        return default
    if not least <= value <= most:
        raise Refusal(f"{name} {value}: from {least} to {most}")
    return value


def insert(new: DataFrame, at: Column, *entropy: str) -> DataFrame:
    """new rows with an id (a ULID of `at` and what tells the rows apart) and equal created_at and updated_at."""
    return new.select(ulid(at, *[F.col(c) for c in entropy]).alias("id"), *new.columns, at.alias("created_at"), at.alias("updated_at"))


def wire(rows: DataFrame, internal: tuple[str, ...] = ("attempts", "storage_path", "embedding")) -> DataFrame:
    """rows as they are shown: without internal columns."""
    return rows.drop(*internal)


def by_id(rows: DataFrame, value, key: str = "id") -> DataFrame:
    return rows.filter(F.col(key) == value).limit(1)


def children(rows: DataFrame, run_id, order: str = "id") -> DataFrame:
    return rows.filter(F.col("run_id") == run_id).orderBy(order)


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value; None or "" is no filter."""
    for column, value in equal.items():
        if value not in (None, ""):
            rows = rows.filter(F.col(column) == value)
    return rows


def page_size(limit: int | None) -> int:
    return DEFAULT_PAGE if not limit or limit < 1 else min(limit, LARGEST_PAGE)


def keyset_page(rows: DataFrame, key: str, limit: int | None = None, cursor=None) -> DataFrame:
    """Newest first, one row more than the page: its presence says that another page follows."""
    if cursor not in (None, ""):
        rows = rows.filter(F.col(key) < F.lit(cursor))
    return rows.orderBy(F.desc(key)).limit(page_size(limit) + 1)


def page_and_cursor(rows: DataFrame, key: str, limit: int | None = None, cursor=None) -> tuple[list, str]:
    """The page's rows and the cursor of the next page, "" on the last."""
    n = page_size(limit)
    found = keyset_page(rows, key, limit, cursor).collect()
    return found[:n], str(found[n - 1][key]) if len(found) > n else ""


def existing(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(rows.select(key), key, "left_semi")


def missing(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(rows.select(key), key, "left_anti")


def top_per_category(rows: DataFrame, category: str | Column, order: str, n: int) -> DataFrame:
    """The first n rows of each category by `order`."""
    w = Window.partitionBy(category).orderBy(order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Rows of a task where joins are dealt by the number of rows.
TASK_ROWS = 500_000


def dealt_out(rows: DataFrame, n: int, most: int, *keys: str) -> DataFrame:
    """rows by their keys, in so many partitions that one has about `most` of the n rows. Spark's own number is fixed, so that a task's memory grows with the input."""
    if n <= most:
        return rows
    return rows.repartition(min(100_000, max(-(-n // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), *keys)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last version of each key: an upsert read back."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def delete_where_parent(rows: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    """ON DELETE CASCADE: rows whose parent wasn't deleted."""
    return rows.join(deleted.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def null_where_missing(rows: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """ON DELETE SET NULL: the reference is kept only if its parent is there."""
    live = parents.select(F.col(key).alias("_live")).distinct()
    return rows.join(live, rows[foreign] == live["_live"], "left").withColumn(foreign, F.when(F.col("_live").isNotNull(), F.col(foreign))).drop("_live")


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the parents in `new` are replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_unless_active(table: DataFrame, new: DataFrame, owner: str, key: str, active: list[str]) -> DataFrame:
    """new with `conflict`: at most one active row per owner, counting those in the table; null owners never conflict."""
    held = table.filter(F.col("status").isin(active) & F.col(owner).isNotNull()).select(F.col(owner).alias("_owner")).distinct()
    w = Window.partitionBy(owner, F.col("status").isin(active)).orderBy(key)
    out = new.join(held, new[owner] == held["_owner"], "left").withColumn("_n", F.row_number().over(w))
    clash = F.col("status").isin(active) & F.col(owner).isNotNull() & (F.col("_owner").isNotNull() | (F.col("_n") > 1))
    return out.withColumn("conflict", clash).drop("_owner", "_n")


#: Keys of one value that travel as one row: a multiple of 8, so that their places in a file's dictionary repeat byte by byte.
PACK = 256
#: Keys of either side that meet in a cell; pairs and keys that a task is dealt.
CELL, TASK_PAIRS, TASK_KEYS = 4096, 8_000_000, 1_000_000


def packed(rows: DataFrame, value: str, key: str) -> DataFrame:
    """value, _n, _keys: the keys of equal values in arrays of PACK and one of what is left, told apart by _n; null values have none."""
    rows = rows.filter(F.col(value).isNotNull()).select(value, key)
    common = rows.groupBy(value).agg(F.ceil(F.count("*") / CELL).alias("_slots")).filter("_slots > 1")  # at most a CELLth of the rows
    slot = F.pmod(F.xxhash64(key), F.coalesce("_slots", F.lit(1)))
    null = F.array_repeat(F.lit(None).cast(dict(rows.dtypes)[key]), F.count_if(F.col(key).isNull()).cast("int"))  # collect_list leaves them out
    keys = rows.join(F.broadcast(common), value, "left").groupBy(value, slot.alias("_slot")).agg(F.sort_array(F.concat(F.collect_list(key), null)).alias("_all"))
    starts = keys.select(value, "_slot", "_all", F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(PACK))).alias("_at"))
    return starts.select(value, F.xxhash64(value, "_slot", "_at").alias("_n"), F.slice("_all", F.col("_at"), PACK).alias("_keys"))


def in_intervals(points: DataFrame, at: str, point: str, intervals: DataFrame, low: str, interval: str, width: int) -> DataFrame:
    """(point, interval): each point's key with those of the intervals [low, low + width) that hold its place `at`.

    Intervals meet points by buckets of their width: an interval touches two, a point lies in one. Keys
    of equal places and of equal intervals travel as packs. A bucket is a grid of cells; a pack of points
    goes to a row of it and one of intervals to a column, so that each pair meets in one cell and a
    key is sent once for CELL of the other side. Cells are dealt to as many tasks as the pairs ask
    for and written pack by pack: keys repeat at short distances, and files hold them in few bytes.
    """
    bucket = lambda x: F.floor(F.col(x) / width)
    known = lambda rows, x: rows.filter((F.col(x) / width).between(-(2.0**62), 2.0**62))  # noqa: E731  NaN, infinity and what `width` doesn't change lie in no interval
    both = lambda i: i.withColumn("_b", F.explode(F.array(bucket(low), bucket(low) + 1)))

    points, intervals = known(points, at).select(at, point), known(intervals, low).select(low, interval)
    held = points.agg(F.min(at).alias("a"), F.max(at).alias("b")).join(intervals.agg(F.min(low).alias("c"), F.max(F.col(low) + width).alias("d"))).first()
    points = points.filter((F.col(at) >= F.lit(held["c"])) & (F.col(at) < F.lit(held["d"])))
    intervals = intervals.filter((F.col(low) <= F.lit(held["b"])) & (F.col(low) + width > F.lit(held["a"])))

    m, n = points.groupBy(bucket(at).alias("_b")).agg(F.count("*").alias("_m")), both(intervals).groupBy("_b").agg(F.count("*").alias("_n"))
    grid = m.join(n, "_b").withColumns({"_rows": F.ceil(F.col("_m") / CELL), "_columns": F.ceil(F.col("_n") / CELL)})
    pairs = F.sum(F.col("_m").cast("double") * F.col("_n") / 2)  # of an interval's two buckets half is its own
    sent = F.sum(F.col("_m") * F.col("_columns") + F.col("_n") * F.col("_rows"))
    tasks = grid.agg(F.ceil(pairs / TASK_PAIRS + sent / TASK_KEYS).alias("n")).first()["n"] or 1
    large = F.broadcast(grid.filter("_rows > 1 OR _columns > 1").select("_b", "_rows", "_columns"))  # at most a CELLth of the rows

    cell = ["_b", "_rows", "_columns"]

    def dealt(packs: DataFrame, value: str, own: str, other: str) -> DataFrame:
        """To one cell of `own` and all of `other`, where packs are numbered by value: the join reads them in this order."""
        one = F.coalesce(F.pmod("_n", F.col(own)), F.lit(0))
        packs = packs.join(large, "_b", "left").withColumn(own, one).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return packs.repartition(tasks, *cell).withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(value, "_n")))

    p = dealt(packed(points, at, point).withColumnRenamed("_keys", "_points").withColumn("_b", bucket(at)), at, "_rows", "_columns")
    i = dealt(both(packed(intervals, low, interval)).withColumnRenamed("_keys", "_intervals"), low, "_columns", "_rows")
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(low) + width) & (F.col("_of") > 0) & (F.col("_n") > 0)  # numbers that nothing reads would not be made
    met = i.join(p.withColumnRenamed("_n", "_of").hint("merge"), cell).filter(inside)  # a pack of intervals with packs of points
    return met.select(F.explode("_points").alias(point), "_intervals").select(point, F.explode("_intervals").alias(interval))


def run_timeline(steps: DataFrame, tool_calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each step with its tool call (the last by id) and its evidence in id order, [] if none."""
    call = latest(tool_calls, ["step_id"], F.desc("id")).select("step_id", F.struct(*[c for c in tool_calls.columns if c not in ("step_id", "run_id")]).alias("tool_call"))
    cited = evidence.groupBy("step_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in evidence.columns if c not in ("step_id", "run_id", "id")]))).alias("evidence"))
    step = F.col("id") == F.col("step_id")
    out = steps.join(call, step, "left").drop("step_id").join(cited, step, "left").drop("step_id")
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast(dict(out.dtypes)["evidence"])))


def resolve_evidence(citations: DataFrame, steps: DataFrame, hits: DataFrame, n: int = 0) -> DataFrame:
    """Citations (run_id, step, document_id, note) resolved against steps (run_id, step_number, step_id, action_type, tool_name, summary).

    A citation of an unknown step is dropped; a retrieval step's document is its first hit (run_id, step_number, document_id, rank, source, content) by rank.
    n: the rows of the longest of the three, if known; joins are dealt by it, TASK_ROWS a task.
    """
    dealt = lambda rows, *keys: dealt_out(rows, n, TASK_ROWS, "run_id", *keys)
    first = latest(dealt(hits, "step_number", "document_id"), ["run_id", "step_number", "document_id"], F.asc("rank")).select("run_id", F.col("step_number").alias("step"), "document_id", F.col("source").alias("_source"), F.col("content").alias("_content"))
    known = steps.withColumnRenamed("step_number", "step")
    out = dealt(citations, "step").join(dealt(known, "step"), ["run_id", "step"])
    out = dealt(out, "step", "document_id").join(first, ["run_id", "step", "document_id"], "left")
    retrieval = F.col("action_type") == "retrieve"
    return out.select(
        "run_id", "step", "step_id",
        F.when(retrieval, "retrieval").otherwise("tool").alias("source_type"),
        F.coalesce(F.when(retrieval, F.col("_source")), "tool_name", F.lit("")).alias("source_ref"),
        F.when(retrieval & F.col("_source").isNotNull(), F.col("document_id")).alias("document_id"),
        F.coalesce(F.when(retrieval, F.col("_content")), "summary", F.lit("")).alias("summary"), "note",
    )


def order_totals(items: DataFrame, order: str, quantity: str, cents: str) -> DataFrame:
    """order, total_cents and reason: the sum of quantity x unit price, null with the reason for an order with a quantity or price that isn't positive."""
    bad = F.coalesce(F.min(F.least(F.col(quantity), F.col(cents))), F.lit(0)) <= 0
    total = F.sum(F.col(quantity) * F.col(cents)).cast("long")
    return items.groupBy(order).agg(F.when(~bad, total).alias("total_cents"), F.when(bad, F.lit("quantity and unit price must be positive")).alias("reason"))


def walk_pages(rows: DataFrame, key: str, limit: int | None = None, width: int = 1 << 16) -> DataFrame:
    """Every row with the page that a walk along the cursors shows it on, newest first, and its place there.

    Keys are unique whole numbers; rows are numbered in ranges of `width` keys, ranges by their counts.
    """
    n = page_size(limit)
    placed = rows.withColumn("_b", F.floor(F.col(key) / width))
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy(F.desc("_b"))) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(key))) - 1
    return placed.join(before, "_b").withColumn("_p", at).withColumn("page", F.floor(F.col("_p") / n)).withColumn("place", F.col("_p") % n).drop("_p", "_b", "_before")


def citation_counts(evidence: DataFrame) -> DataFrame:
    return evidence.filter(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.count("*").alias("citations"), F.count_distinct("run_id").alias("runs"))
