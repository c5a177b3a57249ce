"""Time series: description, sampling, rates, histograms, snapshot deltas.

Samples are long: a series key, ts and value. Functions named after PromQL correct counter resets
and don't extrapolate to a window's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.store import Refusal

RENDERED_POINTS = 20
SERIES_MOST = 50
NAMES_MOST = 80
STEP_DIVISOR, STEP_LEAST = 100, 15


def resolve_step(span: int, step: int | None = None) -> int:
    """Seconds between points: a hundredth of the span, 15 at least; an explicit step must lie between 15 and the span."""
    if step is None:
        return max(STEP_LEAST, round(span / STEP_DIVISOR))
    if step < STEP_LEAST or step > span:
        raise Refusal(f"step {step}s: from {STEP_LEAST}s to {span}s")
    return step


def step_seconds(span: Column) -> Column:
    """resolve_step of a column of spans, in seconds."""
    return F.greatest(F.lit(STEP_LEAST), F.round(span / STEP_DIVISOR)).cast("int")


def series_caps(samples: DataFrame, by: list[str], keys: list[str], name: str, most: int = SERIES_MOST) -> DataFrame:
    """Per group: series, whether they are over the cap, and the metric names that a refusal lists (sorted, NAMES_MOST at most)."""
    each = samples.select(*by, name, *[k for k in keys if k != name]).distinct()
    names = F.slice(F.array_sort(F.collect_set(name)), 1, NAMES_MOST)
    out = each.groupBy(*by).agg(F.count("*").alias("series"), names.alias("names"))
    return out.select(*by, "series", (F.col("series") > most).alias("refused"), F.when(F.col("series") > most, F.array_join("names", ", ")).alias("names"))


def window_problem(start: Column, end: Column, most: int = 6 * 3600) -> Column:
    """What check_window would refuse, as a code, or null."""
    span = (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000
    return F.when(start.isNull() != end.isNull(), "together").when(span <= 0, "order").when(span > most, "range")


def check_window(start, end, most: int = 6 * 3600) -> None:
    if (start is None) != (end is None):
        raise Refusal("start and end go together")
    if start is not None and not 0 < (end - start).total_seconds() <= most:
        raise Refusal(f"end must follow start by at most {most} s")


def check_series(samples: DataFrame, keys: list[str], name: str) -> None:
    """Refuse more than SERIES_MOST series, naming the metrics there are."""
    n = samples.select(*keys).distinct().limit(SERIES_MOST + 1).count()
    if n > SERIES_MOST:
        names = [r[0] for r in samples.select(name).distinct().orderBy(name).limit(NAMES_MOST).collect()]
        raise Refusal(f"over {SERIES_MOST} series; metrics: {', '.join(map(str, names))}")


def describe(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """points, min and max with the first time of each, mean, last. NaN counts in the mean only."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.min(v).alias("min"), F.min_by(ts, F.when(v.isNotNull(), F.struct(v, F.col(ts)))).alias("min_at"),
        F.max(v).alias("max"), F.min_by(ts, F.when(v.isNotNull(), F.struct(-v, F.col(ts)))).alias("max_at"),
        F.avg(value).alias("mean"), F.max_by(value, ts).alias("last"),
    )


def sample(samples: DataFrame, keys: list[str], n: int = RENDERED_POINTS, ts: str = "ts") -> DataFrame:
    """At most n points of each series, evenly spaced by place, first and last included."""
    w = Window.partitionBy(*keys)
    rows = samples.withColumn("_i", F.row_number().over(w.orderBy(ts)) - 1).withColumn("_n", F.count("*").over(w))
    # i is drawn if i = floor(j (n' - 1) / (n - 1)) for some j, of which the only candidate is the ceiling below
    j = F.ceil(F.col("_i") * (n - 1) / (F.col("_n") - 1))
    drawn = (F.col("_n") <= n) | (F.floor(j * (F.col("_n") - 1) / (n - 1)) == F.col("_i"))
    return rows.filter(drawn).drop("_i", "_n")


def deltas(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", corrected: bool = True) -> DataFrame:
    """Each point's increase over the one before; after a reset, the value itself (corrected) or the negative difference."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(ts))
    change = F.col(value) - before
    return samples.withColumn("delta", F.when(change < 0, F.col(value)).otherwise(change) if corrected else change)


def increase(samples: DataFrame, keys: list[str], by: list[str], window: str, slide: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Sum by labels of the increase in each window: window_start, increase."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    steps = deltas(samples, keys, ts, value)
    return steps.groupBy(frame.alias("w"), *by).agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase")).select(F.col("w.start").alias("window_start"), *by, "increase")


def rate(samples: DataFrame, keys: list[str], by: list[str], seconds: int, slide: int | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    grown = increase(samples, keys, by, f"{seconds} seconds", f"{slide} seconds" if slide else None, ts, value)
    return grown.withColumn("rate", F.col("increase") / seconds).drop("increase")


def bucketize(values: DataFrame, by: list[str], bounds: list[float], value: str = "value") -> DataFrame:
    """Cumulative histogram: le ('+Inf' for the last), count, per group."""
    counts = values.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"c{i}") for i, b in enumerate([*bounds, float("inf")])])
    pairs = F.array(*[F.struct(F.lit("+Inf" if b == float("inf") else str(b)).alias("le"), F.lit(float(b)).alias("bound"), F.col(f"c{i}").alias("count")) for i, b in enumerate([*bounds, float("inf")])])
    return counts.select(*by, F.inline(pairs))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """The q-quantile of cumulative buckets (bound, count): linear within the bucket that holds it, from 0 for the first.

    An empty histogram gives NaN; a quantile in the last bucket gives the largest finite bound.
    """
    hist = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bound", F.col("count").cast("double").alias("count")))).alias("h"))
    total = F.element_at("h", -1)["count"]
    goal = F.lit(q) * total
    at = F.array_position(F.transform("h", lambda b: b["count"] >= goal), True).cast("int")
    here, prior = F.try_element_at("h", at), F.when(at > 1, F.try_element_at("h", at - 1))
    low, below = F.coalesce(prior["bound"], F.lit(0.0)), F.coalesce(prior["count"], F.lit(0.0))
    inside = low + (here["bound"] - low) * F.try_divide(goal - below, here["count"] - below)
    first = F.when((at == 1) & (here["bound"] <= 0), here["bound"]).otherwise(inside)
    value = F.when(total == 0, F.lit(float("nan"))).when(here["bound"] == float("inf"), F.try_element_at("h", F.size("h") - 1)["bound"]).otherwise(first)
    return hist.select(*by, value.alias("quantile"))


def percentiles(values: DataFrame, by: list[str], *ps: float, value: str = "value") -> DataFrame:
    """Nearest-rank percentiles p50, p95, ...; 0 for an empty group."""
    made = [F.coalesce(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0)).alias(f"p{p:g}") for p in ps]
    return values.groupBy(*by).agg(*made) if by else values.agg(*made)


def mean_max(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and max of gauge samples; the max starts at 0."""
    return values.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.greatest(F.max(value), F.lit(0.0)), F.lit(0.0)).alias("max"))


def in_phases(samples: DataFrame, phases: DataFrame, ts: str = "ts") -> DataFrame:
    """samples with the phase (phase, start, end) whose interval [start, end) holds their time; phases are few and don't overlap."""
    p = phases.select("phase", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return samples.join(F.broadcast(p), (F.col(ts) >= F.col("_s")) & (F.col(ts) < F.col("_e"))).drop("_s", "_e")


def status_summary(samples: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """'none×3 201×210': counts by status code in order, 0 being no answer."""
    each = samples.groupBy(*by, status).agg(F.count("*").alias("n"))
    part = F.concat(F.when(F.col(status) == 0, "none").otherwise(F.col(status).cast("string")), F.lit("×"), F.col("n").cast("string"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(status).alias("s"), part.alias("t")))), lambda x: x["t"]), " ")
    return each.groupBy(*by).agg(joined.alias("summary"))


def snapshot_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """after less before for value, sum and count, a missing before being 0; mean of a histogram's new observations.

    A negative count, which a restart leaves, gives null.
    """
    cols = [c for c in ("value", "sum", "count") if c in after.columns]
    b = before.select(*keys, *[F.col(c).alias("_" + c) for c in cols])
    out = after.join(b, keys, "left").select(*keys, *[(F.col(c) - F.coalesce("_" + c, F.lit(0))).alias("d_" + c) for c in cols])
    if "count" in cols and "sum" in cols:
        out = out.withColumn("mean", F.when(F.col("d_count") < 0, None).otherwise(F.coalesce(F.try_divide("d_sum", F.when(F.col("d_count") > 0, F.col("d_count"))), F.lit(0.0))))
    return out


def merge_snapshots(first: DataFrame, second: DataFrame, prefix: str) -> DataFrame:
    """Union of two services' snapshots (kind, name, ...): a histogram that both export keeps its own name in the first and gets the prefix in the second; of other clashes the second wins."""
    clash = second.join(first.select("kind", "name").distinct(), ["kind", "name"], "left_semi").select("kind", "name").distinct()
    both = second.join(clash.withColumn("_clash", F.lit(True)), ["kind", "name"], "left")
    renamed = both.withColumn("name", F.when(F.col("_clash") & (F.col("kind") == "histogram"), F.concat(F.lit(prefix + ":"), "name")).otherwise(F.col("name"))).drop("_clash")
    kept = first.join(clash.filter("kind <> 'histogram'"), ["kind", "name"], "left_anti")
    return kept.unionByName(renamed)


def requests_by_class(before: DataFrame, after: DataFrame, service: str, first_digit: str) -> DataFrame:
    """New requests (service, route, status, value) of a status class."""
    some = snapshot_delta(before, after, ["service", "route", "status"])
    return some.filter((F.col("service") == service) & F.col("status").startswith(first_digit)).agg(F.coalesce(F.sum("d_value"), F.lit(0)).alias("requests"))


def clamped_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.greatest(denominator, F.lit(1))


def instant(samples: DataFrame, keys: list[str], at=None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Each series' last value, at a time if given."""
    rows = samples.filter(F.col(ts) <= at) if at is not None else samples
    return rows.groupBy(*keys).agg(F.max_by(value, ts).alias(value))


def waits(requests: DataFrame, by: list[str], asked: str = "asked", granted: str = "granted") -> DataFrame:
    """Seconds between asking for a connection and getting it: count, sum and max by group."""
    seconds = (F.unix_micros(granted) - F.unix_micros(asked)) / 1_000_000
    return requests.groupBy(*by).agg(F.count("*").alias("n"), F.sum(seconds).alias("wait_sum"), F.max(seconds).alias("wait_max"))


def occupancy(intervals: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Sweep line over held intervals: in_use after each change, by time; releases come before grants."""
    edges = intervals.select(*by, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(intervals.select(*by, F.col(end).alias("at"), F.lit(-1).alias("d")))
    each = edges.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    return each.withColumn("in_use", F.sum("d").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).drop("d")
