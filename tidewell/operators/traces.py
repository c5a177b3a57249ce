"""Investigation traces: streaks, bounds, counters, marks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(steps: DataFrame, run: str, order: str, hit: Column) -> DataFrame:
    """Islands of consecutive steps with `hit`: run, first, last, length."""
    w = Window.partitionBy(run).orderBy(order)
    n = F.row_number().over(w)
    marked = steps.withColumn("_hit", hit).withColumn("_island", n - F.sum(F.col("_hit").cast("int")).over(w))
    return marked.filter("_hit").groupBy(run, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_island")


def failed_for_silence(steps: DataFrame, run: str, order: str, silent: Column, limit: int = 2) -> DataFrame:
    """Runs with `limit` silent steps in a row, and the step at which that happened."""
    return streaks(steps, run, order, silent).filter(F.col("length") >= limit).groupBy(run).agg(F.min(F.col("first") + limit - 1).alias("failed_at"))


def first_bound(steps: DataFrame, run: str, order: str, max_steps: int, max_calls: int, max_ms: int, max_tokens: int, is_call: Column, ms: Column, tokens: Column) -> DataFrame:
    """Per run the first step after which a bound holds, checked in the order steps, calls, duration, tokens."""
    upto = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = steps.select(run, order, F.count("*").over(upto).alias("n"), F.sum(is_call.cast("long")).over(upto).alias("calls"), F.sum(ms).over(upto).alias("ms"), F.sum(tokens).over(upto).alias("tokens"))
    bound = (
        F.when(F.col("n") >= max_steps, "MAX_STEPS").when(F.col("calls") >= max_calls, "MAX_TOOL_CALLS")
        .when(F.col("ms") >= max_ms, "TIMEOUT").when(F.col("tokens") >= max_tokens, "TOKEN_BUDGET")
    )
    return s.withColumn("bound", bound).filter("bound is not null").groupBy(run).agg(F.min_by("bound", order).alias("bound"), F.min(order).alias("at_step"))


def run_counters(steps: DataFrame, run: str, is_call: Column, prompt: Column, completion: Column) -> DataFrame:
    return steps.groupBy(run).agg(F.count("*").alias("step_count"), F.count_if(is_call).alias("tool_call_count"), F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"))


def outcome_counts(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Per outcome: retrievals, tool calls, evidence cited, tools in the order first used."""
    tools = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("number", "tool")))), lambda x: x["tool"]))
    return steps.groupBy(*keys).agg(
        F.count_if(F.col("action_type") == "retrieve").alias("retrievals"), F.count_if(F.col("action_type") == "tool_call").alias("tool_calls"),
        F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence"), F.array_join(tools, ", ").alias("tools"),
    )


def accuracy(marks: DataFrame) -> DataFrame:
    return marks.agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.coalesce(F.round(100 * F.try_divide(F.count_if("correct"), F.count("*")), 0), F.lit(0.0)).alias("percent"))


def spread(values: DataFrame, key: str, attempt: str, value: str) -> DataFrame:
    """A key's values in attempt order, one alone if all are equal."""
    inorder = F.transform(F.array_sort(F.collect_list(F.struct(F.col(attempt).alias("a"), F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    return values.groupBy(key).agg(inorder.alias("_v")).select(key, F.when(F.size(F.array_distinct("_v")) == 1, F.col("_v")[0]).otherwise(F.array_join("_v", ", ")).alias("spread"))


def by_scenario(marks: DataFrame, order: str) -> DataFrame:
    return marks.groupBy("scenario").agg(F.count_if("correct").alias("correct"), F.count_if("service_ok").alias("service_ok"), F.count("*").alias("runs"), F.min(order).alias("seen")).orderBy("seen").drop("seen")


def budget_use(outcomes: DataFrame, steps: DataFrame) -> DataFrame:
    """How runs ended (bounded, failed, voluntary) and what they spent."""
    good = F.col("status") == "SUCCEEDED"
    ended = outcomes.agg(
        F.count_if(good & (F.col("stop_reason") != "COMPLETED")).alias("bounded"), F.count_if(~good).alias("failed"),
        F.count_if(good & (F.col("stop_reason") == "COMPLETED")).alias("voluntary"),
    )
    call = F.col("action_type") == "tool_call"
    spent = steps.agg(
        F.count_if(F.col("action_type") == "retrieve").alias("retrievals"), F.count_if(call).alias("tool_calls"),
        F.count_if(call & F.col("tool_status").isNotNull() & ~F.col("tool_status").isin("", "OK")).alias("not_ok"),
    )
    return ended.join(spent)


def materialize_timeline(events: DataFrame) -> DataFrame:
    """The steps of each run's last attempt from run events (run_id, ms, seq, event, step_number, data): the last event of a step wins."""
    order = Window.partitionBy("run_id").orderBy("ms", "seq")
    attempts = events.withColumn("attempt", F.count_if(F.col("event") == "run.started").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = attempts.withColumn("_last", F.max("attempt").over(Window.partitionBy("run_id"))).filter("attempt = _last and event = 'step.completed'")
    w = Window.partitionBy("run_id", "step_number").orderBy(F.desc("ms"), F.desc("seq"))
    return last.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("run_id", "attempt", "step_number", "data")


def published(steps: DataFrame, run: str, order: str, data: str) -> DataFrame:
    """The events that runs publish: run.started, step.completed with each step's number and data, run.finished with the number of steps."""
    each = steps.select(F.col(run).alias("run_id"), F.lit("step.completed").alias("event"), F.col(order).alias("step_number"), F.col(data).cast("string").alias("data"))
    ends = steps.groupBy(F.col(run).alias("run_id")).agg(F.count("*").cast("string").alias("n"))
    mark = lambda event, value: ends.select("run_id", F.lit(event).alias("event"), F.lit(None).cast(dict(each.dtypes)["step_number"]).alias("step_number"), value.alias("data"))
    return mark("run.started", F.lit("")).unionByName(each).unionByName(mark("run.finished", F.col("n")))


def rescored(outcomes: DataFrame, scenarios: DataFrame, mark: Column) -> DataFrame:
    """outcomes marked anew by what the scenarios (scenario, and the columns that mark reads) expect now; raises for a scenario that is gone."""
    gone = [r[0] for r in outcomes.join(scenarios, "scenario", "left_anti").select("scenario").distinct().limit(5).collect()]
    if gone:
        raise ValueError(f"no such scenario: {', '.join(map(str, gone))}")
    return outcomes.join(F.broadcast(scenarios), "scenario").withColumn("mark", mark)


def retrieval_report(ranks: DataFrame, rates: DataFrame) -> str:
    """Hit rates by k, then the queries that weren't hit first, worst first."""
    late = ranks.filter("hit_rank <> 1").orderBy(F.col("hit_rank") != 0, F.desc("hit_rank"), "query_id").select("query_id", "hit_rank")
    return "# Retrieval\n\n" + markdown_table(rates.orderBy("k")) + "\n## Not first\n\n" + markdown_table(late)


def agent_report(marks: DataFrame, budget: DataFrame, order: str) -> str:
    """Accuracy, a row for each scenario, and what the runs spent."""
    return "# Diagnosis\n\n" + markdown_table(accuracy(marks)) + "\n## By scenario\n\n" + markdown_table(by_scenario(marks, order)) + "\n## Budget\n\n" + markdown_table(budget)


def lab_report(phases: DataFrame, summaries: DataFrame) -> str:
    """What a scenario's phases measured, and how its requests ended."""
    return "# Scenario\n\n" + markdown_table(phases) + "\n## Requests\n\n" + markdown_table(summaries)


def keep_newest(events: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """Retention by count: the newest `most` of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def table_lines(rows: DataFrame, *order: str) -> DataFrame:
    """(n, line) of a report's table: the head, then a line for each row of an aggregate in this order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("n"), line.alias("line"))
    head = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(rows.columns)} |"), (1, f"|{'---|' * len(rows.columns)}")], "n LONG, line STRING")
    return head.unionByName(body)


def markdown_table(rows: DataFrame) -> str:
    """A report's table, of an aggregate that fits the driver."""
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows.collect())
