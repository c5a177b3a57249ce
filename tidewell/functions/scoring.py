"""Marking a diagnosis: which terms it rests on, and whether it meets an expectation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers that rule out what follows them.
NEGATIONS = [
    "not ", "n't ", "no ", "never ", "rather than", "instead of",
    "rules out", "rule out", "ruled out", "ruling out", "rules this out",
    "is fine", "are fine", "is healthy", "are healthy",
    "unaffected", "untouched", "without", "unlike", "neither", "nor ",
    "excludes", "excluding", "does not", "did not",
]
#: Ways to say that nothing is wrong.
HEALTHY_TERMS = [
    "no root cause", "nothing is wrong", "nothing appears wrong", "no incident",
    "not an incident", "no fault", "healthy", "within budget", "within its budget",
    "within slo", "within its slo", "no evidence of", "operating normally",
    "no actionable", "nothing actionable", "no degradation", "not degraded",
    "within normal", "normal range", "no problem",
]
NEGATION_BYTES = 90


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(text, t))


def rests_on(text: Column, term: Column) -> Column:
    """Whether some occurrence of term has no negation in the bytes just before it.

    The pieces between occurrences give each one's place; bytes are taken through ISO-8859-1, where each is a character.
    """
    flat = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    t, k = flat(text), flat(term)
    pieces = F.split(t, F.concat(F.lit("\\Q"), k, F.lit("\\E")), -1)
    ends = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * F.length(k),
    )
    before = lambda at: F.substring(t, F.greatest(at - NEGATION_BYTES, F.lit(0)) + 1, F.least(at, F.lit(NEGATION_BYTES)))
    negated = lambda w: reduce(lambda a, b: a | b, [F.contains(w, F.lit(m)) for m in NEGATIONS])
    return F.when(F.size(pieces) < 2, F.lit(False)).otherwise(F.exists(ends, lambda at: ~negated(before(at))))


def mark(root_cause: str = "root_cause", affected: str = "affected_service", service: str = "service", any_groups: str = "any_groups", not_terms: str = "not_terms", healthy: str = "healthy") -> Column:
    """STRUCT<correct, service_ok, cause_ok, why>: the first requirement that fails is why."""
    text, named = F.lower(F.coalesce(F.col(root_cause), F.lit(""))), F.lower(F.coalesce(F.col(affected), F.lit("")))
    rested = F.try_element_at(F.filter(F.col(not_terms), lambda t: rests_on(text, t)), F.lit(1))
    missed = F.try_element_at(F.filter(F.col(any_groups), lambda g: ~contains_any(text, g)), F.lit(1))
    calm = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in HEALTHY_TERMS])
    out = lambda good, s, c, why: F.struct(F.lit(good).alias("correct"), F.lit(s).alias("service_ok"), F.lit(c).alias("cause_ok"), (why if isinstance(why, Column) else F.lit(why)).alias("why"))
    shown = F.when(named == "", F.lit("nothing")).otherwise(quoted_name(affected))
    # the sentences are fixed values
    return (
        F.when(F.trim(text) == "", out(False, False, False, "the run produced no diagnosis"))
        .when(F.col(healthy) & rested.isNotNull(), out(False, True, False, F.concat(F.lit("invented a root cause: "), rested)))
        .when(F.col(healthy) & calm, out(True, True, True, ""))
        .when(F.col(healthy), out(False, True, False, "did not conclude that the system is healthy"))
        .when(~F.contains(named, F.lower(F.col(service))), out(False, False, False, F.concat(F.lit("named "), shown, F.lit(", want "), F.col(service))))
        .when(rested.isNotNull(), out(False, True, False, F.concat(F.lit("the diagnosis rests on "), rested, F.lit(", which is not this fault"))))
        .when(missed.isNotNull(), out(False, True, False, F.concat(F.lit("the diagnosis names none of: "), F.array_join(missed, ", "))))
        .otherwise(out(True, True, True, ""))
    )


def quoted_name(column: str) -> Column:
    return F.concat(F.lit('"'), F.col(column), F.lit('"'))


#: Scenario, the service to be named ("" for none), groups of which one term each must be named, terms that it must not rest on, whether nothing is wrong.
SCENARIOS = [
    ("payment-latency", "payment-service", [["processor", "pool", "downstream", "connection"]], ["cpu satur", "cpu throttl", "timeout is too short", "raise the timeout"], False),
    ("payment-cpu", "payment-service", [["cpu", "saturat", "throttl"]], ["card processor is slow", "processor latency is high"], False),
    ("payment-errors", "payment-service", [["5xx", "503", "error rate", "errors", "rejecting", "shedding"]], ["cpu satur", "pool exhaust", "processor latency"], False),
    ("checkout-latency", "checkout-service", [["checkout"]], ["cpu satur", "cpu throttl", "payment-service is slow"], False),
    ("checkout-cpu", "checkout-service", [["cpu", "saturat", "throttl"]], ["payment-service is slow", "pool exhaust"], False),
    ("checkout-errors", "checkout-service", [["5xx", "503", "error rate", "errors", "rejecting", "shedding"]], ["cpu satur", "pool exhaust"], False),
    ("baseline", "", [], ["pool exhaust", "cpu satur", "processor is slow", "error rate is high"], True),
    ("payment-latency-mild", "", [], ["pool exhaust", "cpu satur", "error rate is high", "outage"], True),
]
#: Scenario, the service at fault, kind of fault, its settings, what diagnoses it.
FAULTS = [
    ("baseline", None, None, {}, []),
    ("payment-latency", "payment-service", "latency", {"delay_ms": 2500.0, "jitter_ms": 250.0}, ["payment-latency-runbook.md", "connection-pool-runbook.md"]),
    ("checkout-cpu", "checkout-service", "cpu", {"workers": 2.0}, ["cpu-saturation-runbook.md", "checkout-latency-runbook.md"]),
    ("checkout-latency", "checkout-service", "latency", {"delay_ms": 2500.0, "jitter_ms": 250.0}, ["checkout-latency-runbook.md"]),
    ("payment-cpu", "payment-service", "cpu", {}, ["cpu-saturation-runbook.md", "payment-latency-runbook.md"]),
    ("checkout-errors", "checkout-service", "error", {"status": 503.0, "ratio": 0.2}, ["error-rate-runbook.md"]),
    ("payment-latency-mild", "payment-service", "latency", {"delay_ms": 300.0, "jitter_ms": 100.0}, []),
    ("payment-errors", "payment-service", "error", {"status": 503.0, "ratio": 0.2}, ["error-rate-runbook.md"]),
]


def scenarios(spark: SparkSession) -> DataFrame:
    """The registry of scenarios as rules: what each injects, what diagnoses it, and what a diagnosis must say."""
    rules = spark.createDataFrame(SCENARIOS, "scenario STRING, service STRING, any_groups ARRAY<ARRAY<STRING>>, not_terms ARRAY<STRING>, healthy BOOLEAN")
    faults = spark.createDataFrame(FAULTS, "scenario STRING, target STRING, kind STRING, settings MAP<STRING, DOUBLE>, runbooks ARRAY<STRING>")
    return rules.join(F.broadcast(faults), "scenario")
