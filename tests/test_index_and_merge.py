"""The vector index, merge on write, the event log as a source, streams with state, embedding in batches."""

import json
import os
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import vector
from tidewell.operators import merge, retrieval, traces, vector_index
from tidewell.sources import events as log
from tidewell.streaming import run, runs

T0 = datetime(2026, 1, 1)


# The index.


def clustered(n, d=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d)) * 2
    return [(i, (centers[i % groups] + rng.normal(size=d) * 0.7).tolist(), f"s{i % 3}") for i in range(n)]


CHUNKS = "chunk_id LONG, embedding ARRAY<DOUBLE>, service STRING"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = clustered(3000) + [(9001, None, "s0"), (9002, [0.0] * 16, "s0"), (9003, [float("nan")] * 16, "s0")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    vector_index.build(chunks, path, 24)
    return path, chunks.filter("chunk_id < 9000")


def asked(spark, chunks, step=30):
    return chunks.filter(F.col("chunk_id") % step == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_recall(spark, index):
    path, chunks = index
    queries = asked(spark, chunks)
    exact = retrieval.knn_batch(chunks, queries, 10)
    few, all_ = vector_index.search(spark, path, queries, 10, 6), vector_index.search(spark, path, queries, 10, 24)
    assert vector_index.recall(few, exact) >= 0.9 and vector_index.recall(all_, exact) == 1.0
    want = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9)) for r in exact.collect()}
    assert {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9)) for r in all_.collect()} == want


def test_recall_on_given_vectors(spark, tmp_path):
    chunks = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "chunk_id")
    vector_index.build(chunks, str(tmp_path / "i"), 16)
    queries = asked(spark, chunks, 50)
    probes = vector_index.probes_for(spark, str(tmp_path / "i"), queries, 10)  # noise in 64 dimensions: lists help little
    assert 8 < probes < 14
    assert vector_index.recall(vector_index.search(spark, str(tmp_path / "i"), queries, 10, probes), retrieval.knn_batch(chunks, queries, 10)) >= 0.9


def test_only_probed_lists_are_read(spark, index):
    path, chunks = index
    one = asked(spark, chunks, 3000)
    found = vector_index.search(spark, path, one, 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len({r[0] for r in vector_index.probed(spark, path, one, 2).select("list").distinct().collect()}) == 2
    assert re.search(r"PartitionFilters: \[list#\d+ IN \(\d+,\d+\)", plan)
    assert found.count() == 5


def test_filters_and_blocks(spark, index, monkeypatch):
    path, chunks = index
    monkeypatch.setattr(vector_index, "SLOT", 40)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_index, "BATCH", 3)
    queries = asked(spark, chunks, 100)
    got = vector_index.search(spark, path, queries, 4, 24, service="s1").select("query_id", "rank", "chunk_id").collect()
    want = retrieval.knn_batch(chunks.filter("service = 's1'"), queries, 4).select("query_id", "rank", "chunk_id").collect()
    assert sorted(got) == sorted(want)


def test_more_queries_than_a_broadcast_takes(spark, index):
    path, chunks = index
    many = chunks.crossJoin(spark.range(8)).select((F.col("chunk_id") * 8 + F.col("id")).alias("query_id"), F.col("embedding").alias("query_vector"))
    assert many.count() > retrieval.QUERIES_MOST
    got = vector_index.search(spark, path, many, 1, 3)
    assert got.filter(F.col("chunk_id") == F.floor(F.col("query_id") / 8)).count() == many.count()


def test_python_holds_one_slot_however_many_queries_ask(spark, index, monkeypatch):
    """An Arrow batch of packed slots and blocks would hold each slot's vectors once for every block; here rows are single vectors, a slot's once."""
    path, chunks = index
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vector_index, "BATCH", 2)
    queries, seen = asked(spark, chunks), spark.sparkContext.accumulator(0)
    mapped = type(chunks).mapInArrow

    def counted(self, f, *a, **b):
        def g(batches):
            def each():
                for x in batches:
                    seen.add(x.nbytes)
                    yield x

            yield from f(each())

        return mapped(self, g, *a, **b)

    monkeypatch.setattr(type(chunks), "mapInArrow", counted)
    found = vector_index.search(spark, path, queries, 10, 24)
    monkeypatch.undo()
    before = seen.value  # of the lists' choice
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "chunk_id").collect())
    rows, pairs = chunks.count(), queries.count() * 24
    assert seen.value - before < 2 * (rows + pairs) * 16 * 8  # once, not once for each block
    assert got == sorted(tuple(r) for r in retrieval.knn_batch(chunks, queries, 10).select("query_id", "rank", "chunk_id").collect())


def test_index_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], CHUNKS)
    vector_index.build(empty, str(tmp_path / "e"))
    assert vector_index.search(spark, str(tmp_path / "e"), asked(spark, spark.createDataFrame(clustered(3), CHUNKS)), 5).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], "s") for i in range(50)], CHUNKS)  # ties go to the smaller key
    vector_index.build(same, str(tmp_path / "s"), 5)
    got = vector_index.search(spark, str(tmp_path / "s"), asked(spark, same, 50), 3, 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [0, 1, 2]
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "query_id LONG, query_vector ARRAY<DOUBLE>")
    assert vector_index.search(spark, str(tmp_path / "s"), none, 3).collect() == []


# Merge on write.

ROW = "k STRING, v INT, note STRING"


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path + "/rows") for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = merge.Table(spark, str(tmp_path / "t"), ["k"], "v", ROW, 8)
    assert t.read().collect() == [] and t.merge(spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)], ROW)) == 1
    before, old = files_of(t.path), t.manifest()
    assert t.merge(spark.createDataFrame([("k3", 2, "b"), ("k3", 5, "c"), ("k4", 0, "late"), ("new", 1, "d")], ROW)) == 2
    new = t.manifest()
    touched = {r[0] for r in spark.createDataFrame([("k3",), ("k4",), ("new",)], "k STRING").select(t.bucket()).collect()}
    changed = {int(b) for b in new["buckets"] if new["buckets"][b] != old["buckets"].get(b)}
    assert changed == touched and len(touched) < 8
    assert before <= files_of(t.path) and all(f"bucket={b}/" in f.replace(os.sep, "/") for f in files_of(t.path) - before for b in [f.split("bucket=")[1].split("/")[0]] if int(b) in touched)
    rows = {r["k"]: (r["v"], r["note"]) for r in t.read().collect()}
    assert len(rows) == 201 and rows["k3"] == (5, "c") and rows["k4"] == (1, "a") and rows["new"] == (1, "d") and rows["k7"] == (1, "a")
    assert {r["k"] for r in t.find(spark.createDataFrame([("k3",), ("none",)], "k STRING")).collect()} == {"k3"}
    assert t.read(1).count() == 200  # the version before can still be read


def test_a_batch_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    t = merge.Table(spark, str(tmp_path / "t"), ["k"], "v", ROW, 4)
    t.merge(spark.createDataFrame([("a", 1, "x")], ROW), batch_id=0)
    monkeypatch.setattr(merge.Table, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([("a", 2, "y")], ROW), batch_id=1)
    monkeypatch.undo()
    assert [tuple(r) for r in t.read().collect()] == [("a", 1, "x")]
    assert t.merge(spark.createDataFrame([("a", 2, "y")], ROW), batch_id=1) == 2
    assert t.merge(spark.createDataFrame([("a", 9, "again")], ROW), batch_id=1) == 2  # delivered again: no effect
    assert [tuple(r) for r in t.read().collect()] == [("a", 2, "y")]


def test_two_writers(spark, tmp_path):
    one, two = (merge.Table(spark, str(tmp_path / "t"), ["k"], "v", ROW, 4) for _ in range(2))
    manifest = two.manifest()
    one.merge(spark.createDataFrame([("a", 1, "x")], ROW))
    with pytest.raises(merge.Conflict):
        two._publish({"version": manifest["version"] + 1, "done": None, "buckets": {}})
    assert one.read().count() == 1


def test_deletes_nulls_and_vacuum(spark, tmp_path):
    t = merge.Table(spark, str(tmp_path / "t"), ["k"], "v", ROW, 4)
    t.merge(spark.createDataFrame([("a", 1, None), (None, 1, "n"), ("b", None, "x"), ("b", 1, "y")], ROW))
    assert {tuple(r) for r in t.read().collect()} == {("a", 1, None), (None, 1, "n"), ("b", 1, "y")}
    t.merge(spark.createDataFrame([("a", 2, "gone"), (None, 2, "gone"), ("b", 0, "gone")], ROW), F.col("note") == "gone")
    assert {tuple(r) for r in t.read().collect()} == {("b", 1, "y")}
    for k in range(3):
        t.merge(spark.createDataFrame([("b", 5 + k, "z")], ROW))
    assert t.merge(spark.createDataFrame([], ROW)) == 5
    t.vacuum(1)
    assert t.versions() == [5] and [tuple(r) for r in t.read().collect()] == [("b", 7, "z")]
    assert len({f.split("/rows/")[1].split("/")[0] for f in files_of(t.path)}) == 1


def test_merge_from_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    t = merge.Table(spark, str(tmp_path / "t"), ["k"], "v", ROW, 4)
    for v in (1, 2):
        spark.createDataFrame([(f"k{i}", v, "s") for i in range(v, 6)], ROW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        stream.writeStream.foreachBatch(merge.sink(t)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r["k"]: r["v"] for r in t.read().collect()} == {"k1": 1, "k2": 2, "k3": 2, "k4": 2, "k5": 2}


# The event log.


def event(i, run_id="a", kind="step", data="x"):
    return json.dumps({"id": f"{1000 + i // 2}-{i}", "run_id": run_id, "event": kind, "data": data})


def put(path, partition, first, lines):
    os.makedirs(f"{path}/partition={partition}", exist_ok=True)
    with open(f"{path}/partition={partition}/.tmp", "w") as f:
        f.write("\n".join(lines))
    os.rename(f"{path}/partition={partition}/.tmp", f"{path}/partition={partition}/{1000 + first // 2}-{first}.jsonl")


def drain(spark, path, base, **options):
    sink = log.follow(spark, path, **options).writeStream.format("parquet").option("checkpointLocation", base + "/c")
    sink.trigger(availableNow=True).start(base + "/out").awaitTermination()
    return sorted((r["partition"], r["seq"]) for r in spark.read.parquet(base + "/out").collect())


def test_a_stream_resumes_after_the_last_event(spark, tmp_path):
    path, base = str(tmp_path / "log"), str(tmp_path / "s")
    put(path, 0, 0, [event(0), "{broken", '{"id": "x", "run_id": "a", "event": "e"}', event(1, "b"), "", '["no object"]', event(2)])
    put(path, 1, 5, [event(5), '{"id": "1009-9", "event": "no run"}'])
    assert drain(spark, path, base) == [(0, 0), (0, 1), (0, 2), (1, 5)]
    assert drain(spark, path, base) == [(0, 0), (0, 1), (0, 2), (1, 5)]  # nothing new: nothing twice
    put(path, 0, 3, ["{", event(3), event(4)])
    put(path, 2, 7, [event(7)])  # a partition that wasn't there
    assert drain(spark, path, base) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (2, 7)]
    assert drain(spark, path, str(tmp_path / "t"), run_id="b") == [(0, 1)]
    assert drain(spark, path, str(tmp_path / "u"), after="1001-2") == [(0, 3), (0, 4), (1, 5), (2, 7)]
    with pytest.raises(Exception, match="event id"):
        log.events(spark, path, after="soon").collect()


def test_filters_of_a_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        put(path, k % 2, 10 * k, [event(i, "ab"[i % 2]) for i in range(10 * k, 10 * k + 10)])
    got = log.events(spark, path)
    assert got.count() == 40 and got.filter("run_id = 'a'").count() == 20 and got.filter("run_id = 'a' and run_id in ('b')").count() == 0
    assert sorted(r["seq"] for r in got.filter("ms > 1004 and ms <= 1006 and partition in (1, 5)").collect()) == [10, 11, 12, 13]
    reader = log.EventReader({"path": path})
    left = list(reader.pushFilters([log.EqualTo(("partition",), 0), log.GreaterThanOrEqual(("ms",), 1011), log.LessThan(("ms",), 1013), log.EqualTo(("event",), "x")]))
    assert [f.attribute for f in left] == [("event",)] and [(p.partition, p.path[-12:]) for p in reader.partitions()] == [(0, "1010-20.jsonl"[-12:])]


def test_last_id_of_long_tails(tmp_path, monkeypatch):
    monkeypatch.setattr(log, "TAIL", 16)
    put(str(tmp_path), 0, 0, [event(0), event(1), "x" * 1000])
    assert log.Files(str(tmp_path)).last_id(f"{tmp_path}/partition=0/1000-0.jsonl") == "1000-1"
    put(str(tmp_path), 1, 0, ["x" * 100])
    assert log.Files(str(tmp_path)).last_id(f"{tmp_path}/partition=1/1000-0.jsonl") is None
    assert log.EventStream({"path": str(tmp_path)}).latestOffset() == {"0": "1000-1"}
    assert log.EventStream({"path": f"{tmp_path}/none"}).latestOffset() == {}


def test_saved_results_open_only_what_a_filter_needs(spark, tmp_path):
    for kind in ("agent", "lab"):
        os.makedirs(f"{tmp_path}/{kind}")
        for name in ("one", "two"):
            with open(f"{tmp_path}/{kind}/{name}.json", "w") as f:
                f.write('{"a": 1}\n\n{"a": 2}')
    got = log.saved_results(spark, str(tmp_path))
    assert got.count() == 8 and [tuple(r) for r in got.filter("kind = 'lab' and name in ('two', 'x')").orderBy("line_no").collect()] == [("lab", "two", 0, '{"a": 1}'), ("lab", "two", 2, '{"a": 2}')]
    reader = log.SavedReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([log.EqualTo(("kind",), "lab"), log.In(("name",), ("one",))])) == [] and [p.path[-12:] for p in reader.partitions()] == ["lab/one.json"]


# Streams with state.


def files(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


REQUEST = "run_id STRING, ts TIMESTAMP, action STRING, attempt INT, step INT"


def test_old_attempts_are_refused(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    first = [("r", at(0), "create", None, None), ("r", at(1), "claim", None, None), ("r", at(2), "step", 1, 1), ("r", at(3), "step", 1, 1), ("r", at(4), "step", 1, 2), ("r", at(5), "claim", None, None), ("x", at(5), "claim", None, None)]
    then = [("r", at(1000), "claim", None, None), ("r", at(1001), "step", 1, 3), ("r", at(1002), "succeed", 1, None), ("r", at(1003), "step", 2, 9), ("r", at(1004), "fail", 2, None), ("r", at(1005), "succeed", 2, None), ("r", at(1006), "create", None, None)]
    s = files(spark, tmp_path / "in", [first, then], REQUEST)
    out = run.with_state_store(spark, lambda: run.drained(runs.runs(s)))
    got = {(r["run_id"], int((r["ts"] - T0).total_seconds())): (r["accepted"], r["reason"], r["attempt"], r["after"], r["children"]) for r in out.collect()}
    assert got["r", 4] == (True, None, 1, "RUNNING", 2) and got["r", 5] == (False, "held", 1, "RUNNING", 2) and got["x", 5][1] == "missing"
    assert got["r", 1000] == (True, None, 2, "RUNNING", 0)  # the claim deletes the children of the attempt before it
    assert got["r", 1001][1] == "stale" and got["r", 1002][1] == "stale" and got["r", 1003] == (True, None, 2, "RUNNING", 1)
    assert got["r", 1004][3] == "FAILED" and got["r", 1005][1] == "terminal" and got["r", 1006][1] == "exists"


def test_timeline_changes(spark, tmp_path):
    schema = "run_id STRING, ms LONG, seq LONG, event STRING, step_number INT, data STRING"
    batches = [
        [("r", 1, 0, "run.started", None, None), ("r", 2, 0, "step.completed", 1, "a"), ("r", 3, 0, "step.completed", 2, "b")],
        [("r", 4, 0, "step.completed", 2, "b2"), ("s", 4, 0, "step.completed", 1, "s")],
        [("r", 5, 0, "run.started", None, None), ("r", 6, 0, "step.completed", 1, "c"), ("r", 7, 0, "run.finished", None, None)],
    ]
    s = files(spark, tmp_path / "in", batches, schema)
    out = run.with_state_store(spark, lambda: run.drained(runs.timeline(s), "update")).collect()
    assert sorted((r["run_id"], r["ms"], r["step_number"], r["data"], r["gone"]) for r in out if r["run_id"] == "r") == [("r", 2, 1, "a", False), ("r", 3, 2, "b", False), ("r", 4, 2, "b2", False), ("r", 5, 2, None, True), ("r", 6, 1, "c", False)]
    last = {}
    for r in sorted(out, key=lambda r: (r["ms"], r["seq"])):
        last[r["run_id"], r["step_number"]] = None if r["gone"] else r["data"]
    want = traces.materialize_timeline(spark.createDataFrame([x for b in batches for x in b], schema)).collect()
    assert {k: v for k, v in last.items() if v} == {(r["run_id"], r["step_number"]): r["data"] for r in want}


def test_timeline_writes_its_state_once_a_batch():
    """A call of the state is a message to the executor: as many as there are steps, not events. Two starts in one batch drop no mark."""
    calls = []

    class Value:
        def exists(self):
            return True

        def get(self):
            return (1,)

        def update(self, x):
            calls.append(x)

    class Steps(dict):
        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

        def clear(self):
            calls.append("clear")
            dict.clear(self)

    t = runs.Timeline()
    t.attempt, t.steps = Value(), Steps({(1,): (0, 0, "a"), (9,): (0, 0, "z")})
    came = [(i, i, "step.completed", i % 3, str(i)) for i in range(300)] + [(300, 300, "run.started", None, None), (301, 301, "run.started", None, None)]
    came += [(i, i, "step.completed", i % 2, str(i)) for i in range(302, 400)]
    (out,) = t.handleInputRows(("r",), iter([pd.DataFrame(came, columns=["ms", "seq", "event", "step_number", "data"])]), None)
    assert len(calls) == 4 and t.steps == {(0,): (398, 398, "398"), (1,): (399, 399, "399")}
    assert sorted((r.step_number, r.data, r.gone, r.attempt) for r in out.itertuples()) == [(0, "398", False, 3), (1, "399", False, 3), (2, None, True, 3), (9, None, True, 3)]


def test_retention_is_bounded_and_ends(spark, tmp_path):
    schema = "run_id STRING, ts TIMESTAMP, ms LONG, seq LONG, id STRING"
    at = lambda run_id, s: (run_id, T0 + timedelta(seconds=s), int((T0.timestamp() + s) * 1000), 0, f"{s}")
    batches = [[at("a", s) for s in range(5)] + [at("b", 1)], [at("a", s) for s in (7, 6, 5)], [at("c", 90_000)], [at("a", 200_000)]]
    s = files(spark, tmp_path / "in", batches, schema)
    out = run.with_state_store(spark, lambda: run.drained(runs.retention(s.withWatermark("ts", "0 seconds"), 3, 24)))
    n = {}
    for r in out.collect():
        n[r["run_id"], r["id"]] = n.get((r["run_id"], r["id"]), 0) + (-1 if r["gone"] else 1)
    assert set(n.values()) <= {0, 1} and {k for k, v in n.items() if v} == {("a", "200000")}
    for names in (["b", "1"], ["a", "7"], ["c", "90000"]):
        assert n[tuple(names)] == 0  # came and went


def test_sweeps_keep_their_time(spark, tmp_path):
    at = []

    def sweep(n):
        at.append(time.monotonic())
        if n == 1:  # overruns: its job is cancelled at the deadline
            spark.range(1000).repartition(2).select(F.expr("java_method('java.lang.Thread', 'sleep', cast(20 as bigint))")).write.format("noop").mode("overwrite").save()
        if n == 2:
            raise ValueError("lost")

    s = runs.Sweeper(spark, sweep, 1.0)
    began = time.monotonic()
    q = s.start(str(tmp_path / "c"))
    while len(at) < 4 and time.monotonic() - began < 40:
        time.sleep(0.1)
    q.stop()
    assert at[0] - began < 10 and s.done[0] == 0 and 1 in s.late and [n for n, _ in s.failed] == [2] and not s._busy.locked()
    assert all(b - a > 0.5 for a, b in zip(at, at[1:]))
    s._busy.acquire()
    s.tick(99)  # one at a time
    assert 99 not in s.done


# Embedding in batches.


def test_calls_of_32_texts(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.makedirs(folder)

    def call(texts):
        with open(f"{folder}/{time.time_ns()}", "w") as f:
            f.write(str(len(texts)))
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        docs = spark.range(0, 100, 1, 2).select("id", F.when(F.col("id") % 10 != 3, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"))
        got = docs.select("id", vector.batched(call, 2)(F.col("t")).alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((r["v"] is None) == (r["id"] % 10 == 3) and (r["v"] is None or r["v"] == [float(r["id"]), 1.0]) for r in got) and len(got) == 100
    assert sorted(int(open(f"{folder}/{f}").read()) for f in os.listdir(folder)) == [13, 13, 32, 32]  # 45 texts a partition


@pytest.mark.parametrize("answers,problem", [([(0, [1.0])], "1 embeddings for 2"), ([(0, [1.0]), (0, [1.0])], "twice"), ([(0, [1.0]), (2, [1.0])], "outside"), ([(0, [1.0]), (1, [1.0, 2.0])], "components")])
def test_bad_answers(answers, problem):
    with pytest.raises(ValueError, match=problem):
        vector.paired(answers, 2, 1)
