"""Metric queries from text: the grammar, and values against a plain evaluation point by point."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest

from tidewell.operators import promql
from tidewell.operators.promql import Binary, Call, Number, Selector, parse
from tidewell.operators.store import Refusal

T0 = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = "name STRING, labels MAP<STRING, STRING>, ts TIMESTAMP, value DOUBLE"


# The grammar.


def test_precedence():
    assert parse("1 + 2 * 3 ^ 2 ^ 2") == Binary("+", Number(1), Binary("*", Number(2), Binary("^", Number(3), Binary("^", Number(2), Number(2)))))
    assert parse("-2 ^ 2") == Binary("*", Number(-1.0), Binary("^", Number(2), Number(2)))
    assert parse("a or b and c unless d") == Binary("or", Selector("a", []), Binary("unless", Binary("and", Selector("b", []), Selector("c", [])), Selector("d", [])))
    assert parse("1 - 2 - 3") == Binary("-", Binary("-", Number(1), Number(2)), Number(3))
    assert parse("a > bool 1") == Binary(">", Selector("a", []), Number(1), True)


def test_selectors_and_calls():
    own = parse("""rate(http:x_total{a="1", b!='2', c=~`3.*`, d!~"4\\"",}[1h30m] offset -5m) # rest""")
    assert own == Call("rate", [Selector("http:x_total", [("a", "=", "1"), ("b", "!=", "2"), ("c", "=~", "3.*"), ("d", "!~", '4"')], 5400.0, -300.0)])
    for text in ("sum by (le, job) (x)", "sum(x) by (le, job)", "SUM by(le,job,)(x)"):
        assert parse(text) == Call("sum", [Selector("x", [])], ["le", "job"], False)
    assert parse("topk without (a) (3, x)") == Call("topk", [Number(3), Selector("x", [])], ["a"], True)
    joined = parse("a * on (x) group_left (y) b")
    assert (joined.on, joined.many, joined.include) == (["x"], "left", ["y"])
    assert parse("a / ignoring (x) b").ignoring == ["x"]
    assert parse("0x1F + .5e1 + inf").left == Binary("+", Number(31), Number(5))


@pytest.mark.parametrize("text", ["", "  ", "sum by", "x{", "x{a=}", "x[5m", "x[5]", "(1", "1 +", "x y", "{}", '{a=~".*"}', "1[5m]", "x[5m][5m]", "rate(1)[5m]", "x offset", "a $ b"])
def test_refused_texts(text):
    with pytest.raises(Refusal):
        parse(text)


def test_rate_interval():
    assert promql.rate_interval(15) == 60 and promql.rate_interval(300) == 315


# Values.


def made(seed=1):
    """Series of three instances with gaps, resets and a stale mark; some samples lie on the grid."""
    rng = random.Random(seed)
    rows = []
    for name, kinds in (("c_total", ("x", "y")), ("g", ("x",))):
        for i in range(3):
            for kind in kinds:
                at, value = rng.choice([0, 7]), 0.0
                while at < 3600:
                    value = rng.choice([0.0, 1.0]) if rng.random() < 0.06 else value + rng.random() * 10 if name == "c_total" else rng.gauss(0, 5)
                    rows.append((name, {"i": str(i), "kind": kind, "empty": ""}, T0 + timedelta(seconds=at), None if name == "g" and rng.random() < 0.05 else value))
                    at += rng.choice([15, 15, 15, 30, 44.5, 400])
    return rows


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


def by_series(name):
    out = {}
    for n, labels, ts, v in made():
        if n == name:
            out.setdefault((labels["i"], labels["kind"]), []).append(((ts - T0).total_seconds(), v))
    return {k: sorted(x) for k, x in out.items()}


START, END, STEP = 300, 3500, 40
GRID = range(START, END + 1, STEP)


def run(samples, text, **more):
    got = promql.evaluate(samples, text, T0 + timedelta(seconds=START), T0 + timedelta(seconds=END), STEP, **more).collect()
    out = {(tuple(sorted(r["labels"].items())), int((r["ts"].replace(tzinfo=UTC) - T0).total_seconds())): r["value"] for r in got}
    assert len(out) == len(got)
    return out


def same(got, want):
    want = {k: v for k, v in want.items() if v is not None}
    assert set(got) == set(want) and want
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9) or math.isnan(v) and math.isnan(got[k]), (k, got[k], v)


def labels_of(key, **more):
    return tuple(sorted({"i": key[0], "kind": key[1], **more}.items()))


def extrapolated(window, points, end, counter, per_second):
    own = [(t, v) for t, v in points if end - window < t <= end and v is not None]
    if len(own) < 2:
        return None
    change = own[-1][1] - own[0][1] + (sum(a for (_, a), (_, b) in zip(own, own[1:]) if b < a) if counter else 0)
    span = own[-1][0] - own[0][0]
    mean = span / (len(own) - 1)
    before, after = own[0][0] - (end - window), end - own[-1][0]
    before = mean / 2 if before >= 1.1 * mean else before
    if counter and change > 0 and own[0][1] >= 0:
        before = min(before, span * own[0][1] / change)
    after = mean / 2 if after >= 1.1 * mean else after
    return change * (span + before + after) / span / (window if per_second else 1)


@pytest.mark.parametrize("slab", [1, 10, 1000])
@pytest.mark.parametrize("text,counter,per_second,window", [("increase(c_total[5m])", True, False, 300), ("rate(c_total[90s])", True, True, 90), ("delta(g[10m])", False, False, 600)])
def test_extrapolation(samples, monkeypatch, slab, text, counter, per_second, window):
    monkeypatch.setattr(promql, "SLAB", slab)
    series = by_series("g" if "(g" in text else "c_total")
    same(run(samples, text), {(labels_of(k), t): extrapolated(window, p, t, counter, per_second) for k, p in series.items() for t in GRID})


def now(points, t, back=300):
    own = [(s, v) for s, v in points if t - back < s <= t]
    return own[-1][1] if own else None


@pytest.mark.parametrize("slab", [1, 10])
def test_last_values(samples, monkeypatch, slab):
    monkeypatch.setattr(promql, "SLAB", slab)
    series = by_series("g")
    same(run(samples, "g"), {(labels_of(k, __name__="g"), t): now(p, t) for k, p in series.items() for t in GRID})
    same(run(samples, "g offset 2m", look_back=60), {(labels_of(k, __name__="g"), t): now(p, t - 120, 60) for k, p in series.items() for t in GRID})
    same(run(samples, 'c_total{i=~"0|1", kind!="y", none="", empty=""}'), {(labels_of(k, __name__="c_total"), t): now(p, t) for k, p in by_series("c_total").items() if k in (("0", "x"), ("1", "x")) for t in GRID})


def window_of(points, t, w):
    return [(s, v) for s, v in points if t - w < s <= t and v is not None]


@pytest.mark.parametrize(
    "call,f",
    [
        ("avg_over_time", lambda v: sum(v) / len(v)), ("sum_over_time", sum), ("min_over_time", min), ("max_over_time", max), ("count_over_time", len), ("last_over_time", lambda v: v[-1]),
        ("present_over_time", lambda v: 1), ("changes", lambda v: sum(a != b for a, b in zip(v, v[1:]))), ("resets", lambda v: sum(b < a for a, b in zip(v, v[1:]))),
        ("stddev_over_time", lambda v: (sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) ** 0.5),
    ],
)
def test_over_time(samples, call, f):
    want = {(labels_of(k), t): f([v for _, v in own]) for k, p in by_series("c_total").items() for t in GRID if (own := window_of(p, t, 120))}
    same(run(samples, f"{call}(c_total[2m])"), want)


def test_last_two_and_slope(samples):
    want, slope = {}, {}
    for k, p in by_series("c_total").items():
        for t in GRID:
            own = window_of(p, t, 200)
            if len(own) > 1:
                (a, v), (b, w) = own[-2:]
                want[labels_of(k), t] = (w if w < v else w - v) / (b - a)
                mx, my = sum(s for s, _ in own) / len(own), sum(v for _, v in own) / len(own)
                slope[labels_of(k), t] = sum((s - mx) * (v - my) for s, v in own) / sum((s - mx) ** 2 for s, _ in own)
    same(run(samples, "irate(c_total[200s])"), want)
    same(run(samples, "deriv(c_total[200s])"), slope)


def test_aggregations(samples):
    series = by_series("c_total")
    at = lambda t, kind=None: [v for k, p in series.items() if (kind is None or k[1] == kind) and (v := now(p, t)) is not None]
    for name, f in (("sum", sum), ("avg", lambda v: sum(v) / len(v)), ("min", min), ("max", max), ("count", len), ("group", lambda v: 1)):
        same(run(samples, f"{name} by (kind, none) (c_total)"), {((("kind", kind),), t): f(v) for kind in "xy" for t in GRID if (v := at(t, kind))})
        same(run(samples, f"{name}(c_total)"), {((), t): f(v) for t in GRID if (v := at(t))})
    same(run(samples, "sum without (i) (c_total)"), {((("kind", kind),), t): sum(v) for kind in "xy" for t in GRID if (v := at(t, kind))})
    same(run(samples, "quantile(0.25, c_total)"), {((), t): v[0] if len(v) == 1 else v[int(r)] + (v[min(int(r) + 1, len(v) - 1)] - v[int(r)]) * (r - int(r)) for t in GRID if (v := sorted(at(t))) for r in [0.25 * (len(v) - 1)]})
    top = run(samples, "topk(2, c_total)")
    for t in GRID:
        assert sorted(v for (_, s), v in top.items() if s == t) == sorted(at(t))[-2:]


def test_operators(samples):
    g = by_series("g")
    value = {(labels_of(k), t): v for k, p in g.items() for t in GRID if (v := now(p, t)) is not None}
    named = {(labels_of(k, __name__="g"), t): v for k, p in g.items() for t in GRID if (v := now(p, t)) is not None}
    same(run(samples, "g * 2 - 1"), {k: v * 2 - 1 for k, v in value.items()})
    same(run(samples, "1 / (g - g)"), {k: math.nan if False else math.inf for k in value})
    same(run(samples, "(g - g) / 0"), {k: math.nan for k in value})
    same(run(samples, "g > 0"), {k: v for k, v in named.items() if v > 0})
    same(run(samples, "0 < bool g"), {k: float(v > 0) for k, v in value.items()})
    same(run(samples, "g unless g > 0"), {k: v for k, v in named.items() if not v > 0})
    same(run(samples, "g < -1 or g > 1"), {k: v for k, v in named.items() if abs(v) > 1})
    same(run(samples, "abs(g) % 2"), {k: math.fmod(abs(v), 2) for k, v in value.items()})
    same(run(samples, "clamp(g, -1, 1)"), {k: max(-1, min(1, v)) for k, v in value.items()})
    same(run(samples, "g - on (i) group_left sum by (i) (g)"), {k: 0.0 for k in value})
    same(run(samples, "time() + 0 * scalar_free") if False else run(samples, "time()"), {((), t): T0.timestamp() + t for t in GRID})
    same(run(samples, "vector(2 ^ 3)"), {((), t): 8.0 for t in GRID})
    same(run(samples, 'label_replace(g, "n", "k$1", "i", "(.)")'), {(tuple(sorted((dict(k) | {"n": "k" + dict(k)["i"]}).items())), t): v for (k, t), v in named.items()})


def test_matching_is_single(samples):
    with pytest.raises(Exception, match="several series match one"):
        run(samples, "g / on (kind) g")


def test_histogram_quantile(spark):
    rows = [("h_bucket", {"le": le, "i": i}, T0 + timedelta(seconds=300), v) for i, counts in (("a", (2, 6, 10, 10)), ("b", (0, 0, 0, 0)), ("c", (3, 2, 5, 5)), ("d", (1, 2, 2, 9))) for le, v in zip(("1", "2.5", "5", "+Inf"), map(float, counts))]
    rows += [("h_bucket", {"le": "1", "i": "e"}, T0 + timedelta(seconds=300), 4.0), ("h_bucket", {"le": "+Inf", "i": "f"}, T0 + timedelta(seconds=300), 4.0), ("h_bucket", {"le": "no", "i": "a"}, T0 + timedelta(seconds=300), 4.0)]
    s = spark.createDataFrame(rows, SCHEMA)
    at = T0 + timedelta(seconds=300)
    got = {r["labels"]["i"]: r["value"] for r in promql.instant(s, "histogram_quantile(0.5, h_bucket)", at).collect()}
    assert got["a"] == 1 + 1.5 * 3 / 4 and math.isnan(got["b"]) and got["c"] == 2.5 / 3 and got["d"] == 5 and math.isnan(got["e"]) and math.isnan(got["f"])
    assert {r["value"] for r in promql.instant(s, "histogram_quantile(2, h_bucket)", at).collect()} == {math.inf}


def test_refused_queries(samples):
    for text in ("c_total[5m]", "rate(c_total)", "nothing(c_total)", "sum(1)", "'x'", "1 and 2", "1 < 2", "topk(g, g)", "quantile(g)", "rate(sum(c_total))"):
        with pytest.raises(Refusal):
            promql.instant(samples, text, T0)
    with pytest.raises(Refusal):
        promql.evaluate(samples, "g", T0, T0 - timedelta(seconds=1), 15)


def test_filters_reach_the_scan(spark, samples, tmp_path):
    samples.write.parquet(f"{tmp_path}/s")
    plan = promql.instant(spark.read.parquet(f"{tmp_path}/s"), "sum(rate(c_total[5m]))", T0 + timedelta(seconds=900))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,c_total)" in plan and "GreaterThan(ts," in plan and plan.count("Exchange hashpartitioning") == 2


def test_no_samples(spark, samples):
    assert promql.instant(samples.limit(0), "sum(rate(c_total[5m]))", T0).collect() == []
    assert promql.instant(samples, "missing", T0).collect() == []


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    """A range vector's samples are dealt by how many there are: with a task's share a tenth of them there are at least ten tasks, and the same values."""
    rows = [("m", {"i": str(i)}, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=k), float(k)) for i in range(30) for k in range(20)]
    s = spark.createDataFrame(rows, "name STRING, labels MAP<STRING, STRING>, ts TIMESTAMP, value DOUBLE")
    found = []
    for most in (promql.TASK_SAMPLES, 30):
        monkeypatch.setattr(promql, "TASK_SAMPLES", most)
        e = promql._Evaluation(s, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 20), 300, 300)
        dealt, _, _ = e.dealt(promql.Selector("m", [], 600.0), 600.0)
        found.append((dealt.rdd.getNumPartitions(), sorted(map(str, promql.evaluate(s, "sum by (i) (rate(m[10m]))", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 20), 300).collect()))))
    assert found[0][1] == found[1][1] and found[1][0] >= 30 > found[0][0]
