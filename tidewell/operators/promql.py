"""Metric queries written as text: PromQL to DataFrame plans over long samples.

Samples are (name, labels MAP<STRING, STRING>, ts, value); a null value marks a series as stale. A
query gives (labels, ts, value) for each series and step of a grid; instant() has a grid of one step.

How it runs. Matchers on the name and the time span reach the scan as filters. A selector deals
its samples by (series, slab), a slab being so many steps that it is ten times as long as the window
before a step; a sample goes to the slabs whose steps see it, so a series with any share of all rows is cut along
time, and a copy is needed only at slab edges. Inside a slab a sample's steps are those until the
next sample or the look-back's end (instant vectors), or those whose window holds it (range
vectors), which one aggregate by (series, step) turns to first, last, count and corrections; it needs no
further shuffle. Aggregations shuffle on (labels that stay, step) after a partial aggregate.

Windows are open at their start and closed at their end. rate, increase and delta extrapolate to
the window's edges: as far as the edge where the gap is under 1.1 of the mean distance between samples, else by half that
distance, and a counter not below zero.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import metrics
from tidewell.operators.store import Refusal, dealt_out

LOOK_BACK = 300.0
#: A slab of steps is so many times as long as the window that its first step needs.
SLAB = 10
#: Samples of a task, counted once for each step that sees them; a task's memory follows from it, whatever the input's size.
TASK_SAMPLES = 400_000
SERIES = "array<struct<key: string, value: string>>"

# What a text says.

#: Fixed values of the language.
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
BINDING = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}
AGGREGATIONS = ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "topk", "bottomk")
_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)|(?P<duration>(?:\d+(?:ms|[smhdwy]))+(?![\w.]))|(?P<number>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?:inf|nan)(?![\w:]))"""
    r"""|(?P<name>[a-zA-Z_:][\w:]*)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<sign>=~|!~|==|!=|<=|>=|[-+*/%^<>=(){}\[\],:@])""",
    re.I,
)


@dataclass
class Number:
    value: float


@dataclass
class Text:
    value: str


@dataclass
class Selector:
    name: str | None
    matchers: list[tuple[str, str, str]]
    window: float | None = None
    offset: float = 0.0


@dataclass
class Call:
    name: str
    args: list
    #: Of an aggregation: the labels that it keeps (by) or drops (without).
    labels: list[str] = field(default_factory=list)
    without: bool = False


@dataclass
class Binary:
    sign: str
    left: object
    right: object
    truth: bool = False
    on: list[str] | None = None
    ignoring: list[str] = field(default_factory=list)
    #: "left" or "right": the side that may have many series for one of the other, and the labels that it gets from there.
    many: str | None = None
    include: list[str] = field(default_factory=list)


def seconds(text: str) -> float:
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(ms|[smhdwy])", text))


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Refusal(f"unexpected {text[at]!r} at {at} in {text!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.tokens[self.at][1].lower() in values and self.tokens[self.at][0] != "text"

    def take(self, *values: str, kind: str | None = None) -> str:
        own, value, at = self.tokens[self.at]
        if (values and not self.peek(*values)) or (kind and own != kind):
            raise Refusal(f"expected {' or '.join(values) or kind}, got {value or 'the end'!r} at {at} in {self.text!r}")
        self.at += 1
        return value

    def whole(self):
        out = self.binary(1)
        self.take(kind="end")
        return out

    def binary(self, least: int):
        left = self.unary()
        while (binds := BINDING.get(self.tokens[self.at][1].lower(), 0) * (self.tokens[self.at][0] in ("sign", "name"))) >= least:
            out = Binary(self.take().lower(), left, None)
            if self.peek("bool"):
                self.take()
                out.truth = True
            if self.peek("on", "ignoring"):
                kind = self.take().lower()
                labels = self.labels()
                out.on, out.ignoring = (labels, []) if kind == "on" else (None, labels)
            if self.peek("group_left", "group_right"):
                out.many = self.take().lower().removeprefix("group_")
                out.include = self.labels() if self.peek("(") else []
            out.right = self.binary(binds if out.sign == "^" else binds + 1)
            left = out
        return left

    def unary(self):
        if self.peek("-", "+"):
            sign, inner = self.take(), self.binary(BINDING["^"])
            return inner if sign == "+" else Number(-inner.value) if isinstance(inner, Number) else Binary("*", Number(-1.0), inner)
        out = self.atom()
        while self.peek("[", "offset"):
            if self.take() == "[":
                if not isinstance(out, Selector) or out.window:
                    raise Refusal(f"a range needs a selector in {self.text!r}")
                out.window = seconds(self.take(kind="duration"))
                self.take("]")
            else:
                back = -1 if self.peek("-") and self.take() else 1
                if not isinstance(out, Selector):
                    raise Refusal(f"an offset needs a selector in {self.text!r}")
                out.offset = back * seconds(self.take(kind="duration"))
        return out

    def labels(self) -> list[str]:
        return self.listed(lambda: self.take(kind="name"))

    def listed(self, item: Callable) -> list:
        self.take("(")
        out = []
        while not self.peek(")"):
            out.append(item())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return out

    def string(self) -> str:
        raw = self.take(kind="text")
        plain = {"n": "\n", "t": "\t", "r": "\r"}
        return raw[1:-1] if raw[0] == "`" else re.sub(r"\\(.)", lambda m: plain.get(m[1], m[1]), raw[1:-1])

    def matchers(self) -> list[tuple[str, str, str]]:
        out = []
        self.take("{")
        while not self.peek("}"):
            out.append((self.take(kind="name"), self.take("=", "!=", "=~", "!~"), self.string()))
            if not self.peek("}"):
                self.take(",")
        self.take("}")
        return out

    def atom(self):
        kind, value, at = self.tokens[self.at]
        if kind == "number":
            self.take()
            return Number(float(int(value, 16)) if value[:2].lower() == "0x" else float(value))
        if kind == "text":
            return Text(self.string())
        if self.peek("("):
            self.take()
            out = self.binary(1)
            self.take(")")
            return out
        if self.peek("{"):
            own = self.matchers()
            if not any(_needs_label(sign, wanted) for _, sign, wanted in own):
                raise Refusal(f"a selector needs a matcher that doesn't match the empty string in {self.text!r}")
            return Selector(None, own)
        name = self.take(kind="name")
        if name.lower() in AGGREGATIONS and self.peek("(", "by", "without"):
            out = Call(name.lower(), [])
            self._grouping(out)
            out.args = self.listed(lambda: self.binary(1))
            self._grouping(out)
            return out
        if self.peek("("):
            return Call(name, self.listed(lambda: self.binary(1)))
        return Selector(name, self.matchers() if self.peek("{") else [])

    def _grouping(self, call: Call) -> None:
        if self.peek("by", "without"):
            call.without = self.take().lower() == "without"
            call.labels = self.labels()


def _needs_label(sign: str, wanted: str) -> bool:
    """Whether a matcher refuses a label that is absent."""
    return {"=": wanted != "", "!=": wanted == "", "=~": not re.fullmatch(wanted, ""), "!~": bool(re.fullmatch(wanted, ""))}[sign]


def parse(text: str):
    if not text.strip():
        raise Refusal("query is required")
    return _Reader(text).whole()


def rate_interval(step: float, scrape: float = 15.0) -> float:
    """What dashboards mean by $__rate_interval."""
    return max(step + scrape, 4 * scrape)


# How it is evaluated.


@dataclass
class Vector:
    """(series, ts, value), ts being steps of the grid."""

    rows: DataFrame


@dataclass
class Scalar:
    """A number for each step, as an expression of the column ts."""

    value: Column


def _map(series: Column) -> Column:
    return F.map_from_entries(series)


def _label(series: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(series, lambda x: x["key"] == name), F.lit(0))["value"], F.lit(""))


def _keep(series: Column, labels: list[str]) -> Column:
    return F.filter(series, lambda x: x["key"].isin(labels)) if labels else F.lit([]).cast(SERIES)


def _drop(series: Column, labels: list[str]) -> Column:
    return F.filter(series, lambda x: ~x["key"].isin([*labels, "__name__"]))


def _with(series: Column, name: str, value: Column) -> Column:
    rest = F.filter(series, lambda x: x["key"] != name)
    added = F.array(F.struct(F.lit(name).alias("key"), value.alias("value")))
    return F.array_sort(F.when(value == "", rest).otherwise(F.concat(rest, added)))


def _divided(a: Column, b: Column) -> Column:
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(F.isnan(a) | F.isnan(b), float("nan")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A comparison that no NaN passes."""
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & compare(a, b)


ARITHMETIC = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divided, "^": F.pow,
    "%": lambda a, b: F.when(b == 0, float("nan")).otherwise(F.try_mod(a, b)),
}
COMPARISONS = {
    "==": _ordered(lambda a, b: a == b), "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b), "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
}
#: Functions of one number.
PLAIN = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "exp": F.exp, "sqrt": F.sqrt, "ln": F.log, "log2": F.log2, "log10": F.log10, "sgn": F.signum}


def _largest(value: Column) -> Column:
    """max that takes NaN only where there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))


class _Evaluation:
    def __init__(self, samples: DataFrame, start: datetime, end: datetime, step: float, look_back: float):
        start, end = (x if x.tzinfo else x.replace(tzinfo=UTC) for x in (start, end))
        if step <= 0 or end < start:
            raise Refusal("the step must be above 0 and the end not before the start")
        self.samples, self.start, self.end, self.step, self.look_back = samples, start, end, step, look_back
        self.steps = int((end - start) / timedelta(seconds=step)) + 1

    # Selectors.

    def chosen(self, s: Selector, window: float) -> DataFrame:
        """(series, at, value): the samples that some step sees; at: microseconds since the grid's start, the offset counted in."""
        rows = self.samples
        name = s.name or next((x for n, sign, x in s.matchers if (n, sign) == ("__name__", "=")), None)
        if name is not None:
            rows = rows.filter(F.col("name") == name)
        back = timedelta(seconds=s.offset)
        rows = rows.filter((F.col("ts") > F.lit(self.start - back - timedelta(seconds=window))) & (F.col("ts") <= F.lit(self.end - back)))
        for label, sign, wanted in s.matchers:
            own = F.col("name") if label == "__name__" else F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit(""))
            match = own.rlike(f"^(?:{wanted})$") if sign[-1] == "~" else own == wanted
            rows = rows.filter(~match if sign[0] == "!" else match)
        entries = F.filter(F.map_entries("labels"), lambda x: (x["value"] != "") & (x["key"] != "__name__"))
        named = F.array(F.struct(F.lit("__name__").alias("key"), F.col("name").alias("value")))
        at = F.unix_micros("ts") - F.unix_micros(F.lit(self.start - back))
        return rows.select(F.array_sort(F.concat(named, entries)).cast(SERIES).alias("series"), at.alias("at"), F.col("value").cast("double").alias("value"))

    def dealt(self, s: Selector, window: float) -> tuple[DataFrame, Window, int]:
        """chosen() with the slabs that need each sample, the order of a series in a slab, and the steps of a slab."""
        step, reach = self.micros(self.step), self.micros(window)
        size = max(1, math.ceil(SLAB * window / self.step))
        rows = self.chosen(s, window)
        first, last = F.ceil(F.col("at") / step), F.ceil((F.col("at") + reach) / step) - 1
        low, high = F.greatest(first, F.lit(0)), F.least(last, F.lit(self.steps - 1))
        seen = rows.withColumns({"low": low, "high": high}).filter(F.col("low") <= F.col("high"))
        slabs = F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))
        dealt = seen.withColumn("slab", F.explode(slabs))
        dealt = dealt.withColumns({"low": F.greatest("low", F.col("slab") * size), "high": F.least("high", (F.col("slab") + 1) * size - 1)})
        seeing = max(1, min(self.steps, round(window / self.step)))
        dealt = dealt_out(dealt, rows.count() * seeing, TASK_SAMPLES, "series", "slab")
        return dealt, Window.partitionBy("series", "slab").orderBy("at"), size

    @staticmethod
    def micros(s: float) -> int:
        return round(s * 1_000_000)

    def at_step(self, k: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(F.lit(self.start)) + (k * self.micros(self.step)).cast("long"))

    def vector(self, s: Selector) -> Vector:
        """Each series' last sample at each step, unless it is stale or older than the look-back."""
        rows, order, _ = self.dealt(s, self.look_back)
        until = F.ceil(F.lead("at").over(order) / self.micros(self.step)) - 1
        rows = rows.withColumn("high", F.least("high", F.coalesce(until, "high"))).filter((F.col("low") <= F.col("high")) & F.col("value").isNotNull())
        return Vector(rows.select("series", "value", F.explode(F.sequence("low", "high")).alias("k")).select("series", self.at_step(F.col("k")).alias("ts"), "value"))

    def windows(self, s: Selector, aggregate: Callable[[Window, float], dict[str, Column]], value: Column) -> Vector:
        """A value for each series and step from aggregates over the samples of its window."""
        if not isinstance(s, Selector) or not s.window:
            raise Refusal("a range vector is needed, such as name[5m]")
        rows, order, _ = self.dealt(s, s.window)
        rows = rows.filter(F.col("value").isNotNull())
        rows = rows.withColumns({"before": F.lag("value").over(order), "before_at": F.lag("at").over(order)})
        rows = rows.select("*", F.explode(F.sequence("low", "high")).alias("k"))
        found = rows.groupBy("series", "slab", "k").agg(*[c.alias(n) for n, c in aggregate.items()])
        end = F.col("k") * self.micros(self.step)
        found = found.withColumns({"to_end": (end - F.col("last_at")) / 1e6, "to_start": (F.col("first_at") - end) / 1e6 + s.window} if "last_at" in aggregate else {})
        return Vector(found.select(_drop(F.col("series"), []).alias("series"), self.at_step(F.col("k")).alias("ts"), value.alias("value")).filter(F.col("value").isNotNull()))

    # Functions of range vectors.

    def grown(self, s: Selector, counter: bool, per_second: bool) -> Vector:
        lost = F.when(F.col("value") < F.col("before"), F.col("before")).otherwise(0.0)
        by = {
            "n": F.count("*"), "first_at": F.min("at"), "last_at": F.max("at"), "first": F.min_by("value", "at"), "last": F.max_by("value", "at"),
            "lost": F.sum(lost) - F.min_by(lost, "at"),
        }
        change = F.col("last") - F.col("first") + (F.col("lost") if counter else F.lit(0.0))
        span = (F.col("last_at") - F.col("first_at")) / 1e6
        mean = F.try_divide(span, F.col("n") - 1)
        reach = lambda gap: F.when(gap >= 1.1 * mean, mean / 2).otherwise(gap)
        start = reach(F.col("to_start"))
        if counter:
            start = F.when((change > 0) & (F.col("first") >= 0), F.least(start, span * F.try_divide(F.col("first"), change))).otherwise(start)
        factor = F.try_divide(span + start + reach(F.col("to_end")), span)
        value = F.when(F.col("n") >= 2, change * factor / (s.window if per_second and isinstance(s, Selector) and s.window else 1.0))
        return self.windows(s, by, value)

    def last_two(self, s: Selector, counter: bool) -> Vector:
        """Change between the last two samples: per second and corrected for a counter."""
        last = F.max_by(F.struct("at", "value", "before", "before_at"), "at")
        base = F.when(F.col("p.value") < F.col("p.before"), 0.0).otherwise(F.col("p.before")) if counter else F.col("p.before")
        change = F.col("p.value") - base
        value = F.when(F.col("n") >= 2, F.try_divide(change, (F.col("p.at") - F.col("p.before_at")) / 1e6) if counter else change)
        return self.windows(s, {"n": F.count("*"), "p": last}, value)

    def over_time(self, name: str, args: list) -> Vector:
        value = F.col("value")
        flagged = lambda flag: F.sum(flag.cast("int")) - F.min_by(flag.cast("int"), "at")
        same = (value == F.col("before")) | (F.isnan(value) & F.isnan("before"))
        made = {
            "sum": F.sum(value), "avg": F.avg(value), "min": F.min(value), "max": _largest(value), "count": F.count("*"), "last": F.max_by(value, "at"),
            "present": F.lit(1.0), "stddev": F.stddev_pop(value), "stdvar": F.var_pop(value), "deriv": F.regr_slope(value, F.col("at") / 1e6),
            "changes": flagged(F.coalesce(~same, F.lit(False))), "resets": flagged(F.coalesce(value < F.col("before"), F.lit(False))),
        }
        if name == "quantile":
            made["quantile"] = F.percentile(value, F.lit(self.number(args[0])))
        return self.windows(args[-1], {"made": made[name]}, F.col("made").cast("double"))

    def number(self, node) -> float:
        if not isinstance(node, Number):
            raise Refusal("a number is needed here")
        return node.value

    # Functions of vectors.

    def histogram_quantile(self, q: float, v: Vector) -> Vector:
        """Buckets whose counts fall are raised to the one before; without a bucket up to infinity and another one, NaN."""
        le = _label(F.col("series"), "le").try_cast("double")
        rows = v.rows.select(_drop(F.col("series"), ["le"]).alias("series"), "ts", le.alias("bound"), "value").filter(F.col("bound").isNotNull())
        same = rows.groupBy("series", "ts", "bound").agg(F.sum("value").alias("count"))
        group = Window.partitionBy("series", "ts")
        whole = (F.max("bound").over(group) == float("inf")) & (F.count("*").over(group) > 1)
        raised = F.max("count").over(group.orderBy("bound"))
        buckets = same.select("series", "ts", "bound", F.when(whole, raised).otherwise(0.0).alias("count"))
        if 0 <= q <= 1:
            found = metrics.histogram_quantile(buckets, ["series", "ts"], q)
        else:
            found = buckets.select("series", "ts").distinct().withColumn("quantile", F.lit(math.copysign(float("inf"), q) if q == q else float("nan")))
        return Vector(found.select("series", "ts", F.col("quantile").alias("value")))

    def aggregated(self, call: Call) -> Vector:
        parameter = self.number(call.args[0]) if call.name in ("quantile", "topk", "bottomk") else None
        if len(call.args) != 1 + (parameter is not None):
            raise Refusal(f"{call.name} takes {1 + (parameter is not None)} arguments")
        rows = self.of(call.args[-1], Vector).rows
        group = _drop(F.col("series"), call.labels) if call.without else _keep(F.col("series"), call.labels)
        value = F.col("value")
        if call.name in ("topk", "bottomk"):
            order = (value.desc() if call.name == "topk" else value.asc(), F.col("series"))
            last = F.isnan(value).cast("int")
            ranked = rows.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("group", "ts").orderBy(last, *order)))
            return Vector(ranked.filter(F.col("rank") <= int(parameter)).select("series", "ts", "value"))
        made = {
            "sum": F.sum(value), "avg": F.avg(value), "min": F.min(value), "max": _largest(value), "count": F.count("*").cast("double"),
            "group": F.max(F.lit(1.0)), "stddev": F.stddev_pop(value), "stdvar": F.var_pop(value),
        }
        if call.name == "quantile":
            made["quantile"] = F.percentile(value, F.lit(parameter))
        return Vector(rows.groupBy(group.alias("series"), "ts").agg(made[call.name].alias("value")))

    def call(self, c: Call) -> Vector | Scalar:
        name, args = c.name, c.args
        if name in AGGREGATIONS:
            return self.aggregated(c)
        if name in ("rate", "increase", "delta"):
            return self.grown(*args, counter=name != "delta", per_second=name == "rate")
        if name in ("irate", "idelta"):
            return self.last_two(*args, counter=name == "irate")
        if name.endswith("_over_time") or name in ("deriv", "changes", "resets"):
            kind = name.removesuffix("_over_time")
            if kind in ("sum", "avg", "min", "max", "count", "last", "present", "stddev", "stdvar", "quantile", "deriv", "changes", "resets"):
                return self.over_time(kind, args)
        if name == "histogram_quantile":
            return self.histogram_quantile(self.number(args[0]), self.of(args[1], Vector))
        if name == "time":
            return Scalar(F.unix_micros("ts") / 1e6)
        if name == "vector":
            grid = self.samples.sparkSession.range(self.steps).select(F.lit([]).cast(SERIES).alias("series"), self.at_step(F.col("id")).alias("ts"))
            return Vector(grid.withColumn("value", self.of(args[0], Scalar).value))
        if name == "label_replace":
            rows = self.of(args[0], Vector).rows
            target, shape, source, pattern = (x.value for x in args[1:])
            own = _label(F.col("series"), source)
            filled = F.regexp_replace(own, f"^(?:{pattern})$", shape)
            return Vector(rows.withColumn("series", F.when(own.rlike(f"^(?:{pattern})$"), _with(F.col("series"), target, filled)).otherwise(F.col("series"))))
        value = F.col("value")
        if name in PLAIN:
            made = PLAIN[name](value).cast("double")
            made = F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(made) if name in ("ceil", "floor") else made
        elif name in ("clamp_min", "clamp_max", "clamp"):
            ends = [self.of(x, Scalar).value for x in args[1:]]
            low = ends[0] if name != "clamp_max" else None
            high = ends[-1] if name != "clamp_min" else None
            made = value if low is None else F.when(value < low, low).otherwise(value)
            made = made if high is None else F.when(~F.isnan(made) & (made > high), high).otherwise(made)
        elif name == "round":
            to = self.number(args[1]) if len(args) > 1 else 1.0
            made = F.floor(value / to + 0.5) * to
        elif name in ("sort", "sort_desc"):
            return self.of(args[0], Vector)
        else:
            raise Refusal(f"unknown function {name}")
        rows = self.of(args[0], Vector).rows
        return Vector(rows.select(_drop(F.col("series"), []).alias("series"), "ts", made.cast("double").alias("value")))

    # Operators.

    def binary(self, b: Binary) -> Vector | Scalar:
        left, right = self.of(b.left), self.of(b.right)
        arithmetic, compare = ARITHMETIC.get(b.sign), COMPARISONS.get(b.sign)
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if compare and not b.truth or not (compare or arithmetic):
                raise Refusal(f"{b.sign} between numbers needs bool" if compare else f"{b.sign} needs vectors")
            return Scalar(arithmetic(left.value, right.value) if arithmetic else compare(left.value, right.value).cast("double"))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            if not (compare or arithmetic):
                raise Refusal(f"{b.sign} needs vectors")
            rows = left.rows if isinstance(left, Vector) else right.rows
            x, y = (F.col("value") if isinstance(v, Vector) else v.value for v in (left, right))
            if compare and not b.truth:
                return Vector(rows.filter(compare(x, y)))
            return Vector(rows.select(_drop(F.col("series"), []).alias("series"), "ts", (arithmetic(x, y) if arithmetic else compare(x, y).cast("double")).alias("value")))
        key = (lambda s: _keep(s, b.on) if b.on is not None else _drop(s, b.ignoring))
        one, other = (v.rows.withColumn("key", key(F.col("series"))) for v in (left, right))
        if b.sign in ("and", "unless"):
            kept = one.join(other.select("key", "ts").distinct(), ["key", "ts"], "left_semi" if b.sign == "and" else "left_anti")
            return Vector(kept.select("series", "ts", "value"))
        if b.sign == "or":
            more = other.join(one.select("key", "ts").distinct(), ["key", "ts"], "left_anti")
            return Vector(one.unionByName(more).select("series", "ts", "value"))
        return self.matched(b, one, other, arithmetic, compare)

    def matched(self, b: Binary, left: DataFrame, right: DataFrame, arithmetic, compare) -> Vector:
        """Operators between vectors: series meet by their labels; a side that must be single is refused otherwise."""

        def single(rows: DataFrame) -> DataFrame:
            found = rows.groupBy("key", "ts").agg(F.count("*").alias("n"), F.min("series").alias("series"), F.min("value").alias("value"))
            fine = F.assert_true(F.col("n") == 1, F.lit("several series match one; use on, ignoring or an aggregation"))
            return found.select("key", "ts", "series", F.when(fine.isNull(), F.col("value")).alias("value"))

        left = left if b.many == "left" else single(left)
        right = right if b.many == "right" else single(right)
        both = left.select("key", "ts", F.col("series").alias("ls"), F.col("value").alias("lv")).join(right.select("key", "ts", F.col("series").alias("rs"), F.col("value").alias("rv")), ["key", "ts"])
        many, one = ("rs", "ls") if b.many == "right" else ("ls", "rs")
        if compare and not b.truth:
            both = both.filter(compare(F.col("lv"), F.col("rv")))
            series, value = F.col(many), F.col("lv")
        else:
            series = _drop(F.col(many), []) if b.many else F.col("key")
            value = arithmetic(F.col("lv"), F.col("rv")) if arithmetic else compare(F.col("lv"), F.col("rv")).cast("double")
        series = reduce(lambda s, name: _with(s, name, _label(F.col(one), name)), b.include, series)
        return Vector(both.select(series.alias("series"), "ts", value.alias("value")))

    def of(self, node, kind: type | None = None) -> Vector | Scalar:
        if isinstance(node, Number):
            out = Scalar(F.lit(float(node.value)))
        elif isinstance(node, Selector):
            if node.window:
                raise Refusal("a range vector needs a function such as rate")
            out = self.vector(node)
        elif isinstance(node, Call):
            out = self.call(node)
        elif isinstance(node, Binary):
            out = self.binary(node)
        else:
            raise Refusal("a string can't be evaluated")
        if kind and not isinstance(out, kind):
            raise Refusal(f"a {kind.__name__.lower()} is needed, got a {type(out).__name__.lower()}")
        return out


def evaluate(samples: DataFrame, text: str, start: datetime, end: datetime, step: float, look_back: float = LOOK_BACK, scrape: float = 15.0) -> DataFrame:
    """(labels, ts, value) of the query at start, start + step, ... up to end; $__rate_interval and $__interval are filled in.

    Times without a zone are UTC.
    """
    whole = lambda s: f"{round(s * 1000)}ms"
    filled = text.replace("$__rate_interval", whole(rate_interval(step, scrape))).replace("$__interval", whole(step))
    run = _Evaluation(samples, start, end, step, look_back)
    node = parse(filled)
    out = run.of(node)
    if isinstance(out, Scalar):
        out = run.of(Call("vector", [node]))
    return out.rows.select(_map(F.col("series")).alias("labels"), "ts", "value")


def instant(samples: DataFrame, text: str, at: datetime, look_back: float = LOOK_BACK) -> DataFrame:
    return evaluate(samples, text, at, at, 1.0, look_back)
