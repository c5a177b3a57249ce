"""Exact top-k by term-at-a-time accumulation.

Vectors become rows of integers, packed into blocks. A candidate block has a posting list for each
term (dimension): the places with a weight that isn't zero, and the weights. For a batch of queries
each term scatters query weight x posting weight into dense score arrays; a partition around the
k-th score selects each query's best, and the choices of a task's blocks are merged before they are
emitted. Every query block meets every candidate block through an equi-join on the candidates'
slot, so no task holds more than a block of either and the choices of some query blocks.

Scores are exact: blocks are summed in 32-bit integers where terms x largest weights can't exceed
them, else in 64-bit ones, else in Python's.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; an
absent component counts as 0; a row is known by its place, so rows that share a vec_id are all
queries and candidates, and a query leaves out its own row alone; a row without a vec_id is a
candidate, the last among ties; a query with fewer than k candidates gets them all; ties go to the
smaller vec_id; empty vectors score 0; ranks follow the exact scores, and one that a long can't hold
is shown as the nearest long; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import saved

BLOCK = 16_384
QUERY_BLOCK = 1_024
QUERY_BATCH = 32
#: Candidates whose scores are accumulated at a time, so that they stay in the processor's cache.
STRETCH = 4_096
#: The best of a row of scores are looked for among so many partial maxima first.
CHUNK = 64
#: A task holds the choices of so many query blocks at most before it emits them.
HELD = 64
SCALE = 256
K = 5
QUERY_STEP = 50
NO_ID = np.iinfo(np.int64).max
_PACKED = "ids binary, nulls binary, weights binary, kind string, terms int"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part, x as doubles."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull())
    return rows.filter(F.coalesce(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False)))


def _dense(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def weights_of(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: doubles that are whole numbers, or Python's integers where a product would overflow."""
    if np.abs(x).max(initial=0.0) < 1e300:
        return np.floor(x * SCALE)
    return np.array([[math.floor(c * SCALE) if abs(c) < 1e300 else int(c) * SCALE for c in row] for row in x.tolist()], dtype=object)


def _pack(ids: np.ndarray, null: np.ndarray, x: np.ndarray) -> tuple:
    """A block's row; weights are kept in the smallest type that holds them, the components themselves if none does."""
    most = np.abs(x).max(initial=0.0)
    kind = "<i2" if most < 127 else "<i4" if most < 8e6 else "<f8"
    w = x if kind == "<f8" else np.floor(x * SCALE).astype(kind)
    return ids.astype("<i8").tobytes(), null.tobytes(), w.tobytes(), kind, x.shape[1]


def _unpack(ids: bytes, nulls: bytes, weights: bytes, kind: str, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    w = np.frombuffer(weights, kind).reshape(len(own), terms)
    return own, np.frombuffer(nulls, bool), weights_of(w) if kind == "<f8" else w


def packed(rows: DataFrame, block: int) -> DataFrame:
    """rows (vec_id, x) as few rows of up to `block` vectors."""

    def pack(batches):
        have, n = [], 0
        for batch in batches:
            ids, x = batch.column("vec_id"), _dense(batch.column("x"))
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(NO_ID).to_numpy()
            at = 0
            while at < len(ids):
                to = min(len(ids), at + block - n)
                have.append((ids[at:to], null[at:to], x[at:to]))
                n, at = n + to - at, to
                if n == block:
                    yield joined(have)
                    have, n = [], 0
        if n:
            yield joined(have)

    def joined(have):
        wide = max(x.shape[1] for _, _, x in have)
        ids, null, x = np.concatenate([h[0] for h in have]), np.concatenate([h[1] for h in have]), np.concatenate([np.pad(h[2], ((0, 0), (0, wide - h[2].shape[1]))) for h in have])
        return _batch([_pack(ids, null, x)], _PACKED)

    return rows.mapInArrow(pack, _PACKED)


_TYPES = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


_ASKED = _PACKED + ", homes binary, places binary"


def queries_of(blocks: DataFrame, step: int, block: int) -> DataFrame:
    """The rows of blocks whose vec_id is divisible by `step`, in blocks of their own, with the block and place of each."""

    def pick(batches):
        for batch in batches:
            for number, *r in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "nulls", "weights", "kind", "terms"))):
                ids, null, kind, terms = np.frombuffer(r[0], "<i8"), np.frombuffer(r[1], bool), r[3], r[4]
                place = np.flatnonzero(~null & (ids % step == 0))
                w = np.frombuffer(r[2], kind).reshape(len(ids), terms)
                for at in range(0, len(place), block):
                    p = place[at : at + block]
                    yield _batch([(ids[p].tobytes(), null[p].tobytes(), w[p].tobytes(), kind, terms, np.full(len(p), number, "<i8").tobytes(), p.astype("<i8").tobytes())], _ASKED)

    return blocks.select("block", "ids", "nulls", "weights", "kind", "terms").mapInArrow(pick, _ASKED)


def postings(weights: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term: the places with a weight, and the weights; None for the places of a term that most candidates have, whose list is the whole column."""
    columns = (np.ascontiguousarray(weights[:, t]) for t in range(weights.shape[1]))
    return [(None, c) if 2 * len(at) > len(c) else (at, c[at]) for c in columns for at in (np.flatnonzero(c),)]


def _sum_type(q: np.ndarray, c: np.ndarray):
    largest = lambda w: max((abs(int(w.min())), abs(int(w.max()))), default=0) if w.size else 0
    a, b = largest(q), largest(c)
    bound = max(a, b, min(q.shape[1], c.shape[1]) * a * b)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def scores(q: np.ndarray, n: int, lists: list[tuple[np.ndarray | None, np.ndarray]], kind) -> np.ndarray:
    """Inner products of the queries q with n candidates whose weights are in posting lists, all of `kind`."""
    out = np.zeros((len(q), n), kind)
    using = [np.flatnonzero(q[:, t]) for t in range(min(q.shape[1], len(lists)))]
    room = np.empty((len(q), min(n, STRETCH)), kind)
    for low in range(0, n, STRETCH):
        high = min(n, low + STRETCH)
        part = out[:, low:high]
        for t, rows in enumerate(using):
            at, weights = lists[t]
            if not len(rows):
                continue
            if at is not None:
                a, b = np.searchsorted(at, (low, high))
                part[np.ix_(rows, at[a:b] - low)] += q[rows, t, None] * weights[None, a:b]
            elif 2 * len(rows) > len(q):
                product = np.multiply(q[:, t, None], weights[None, low:high], out=room[:, : high - low])
                np.add(part, product, out=part)
            else:
                part[rows] += q[rows, t, None] * weights[None, low:high]
    return out


def best(found: np.ndarray, own: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of scores its k best candidates (places, scores); own[i] is the place to leave out, or -1."""
    n, out = found.shape[1], []
    if found.dtype != object and n >= 2 * CHUNK * (k + 1):  # k + 1 chunks have a maximum of the limit or more, one of them may be the own row's
        tops = found[:, : n // CHUNK * CHUNK].reshape(len(found), -1, CHUNK).max(axis=2)
        limits = np.partition(tops, tops.shape[1] - k - 1, axis=1)[:, tops.shape[1] - k - 1]
    else:
        limits = [None] * len(found)
    for i, limit in enumerate(limits):
        at = np.flatnonzero(found[i] >= limit) if limit is not None else np.arange(n)
        at = at[at != own[i]]
        s = found[i, at]
        if s.dtype == object:
            order = sorted(range(len(at)), key=lambda j: (-s[j], null[at[j]], ids[at[j]]))[:k]
        else:
            if len(at) > k:
                near = s >= np.partition(s, len(s) - k)[len(s) - k]
                at, s = at[near], s[near]
            order = np.lexsort((ids[at], null[at], -s.astype(np.int64)))[:k]
        out.append((at[order], s[order]))
    return out


_FOUND = "query long, query_id long, vec_id long, score long, exact string"


class _Choices:
    """The best candidates so far of each query of a query block."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def add(self, i: int, score: list, null: list, ids: list) -> None:
        self.rows[i] = sorted([*self.rows[i], *((-s, z, v) for s, z, v in zip(score, null, ids))])[: self.k]

    def emit(self, query: np.ndarray, query_id: np.ndarray):
        most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        out = [
            (int(q), int(me), None if z else v, max(least, min(most, -s)), None if least <= -s <= most else str(-s))
            for q, me, rows in zip(query, query_id, self.rows) for s, z, v in rows
        ]
        if out:
            yield _batch(out, _FOUND)


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by `step`."""
    blocks = saved(packed(usable(vectors), BLOCK).withColumn("block", F.monotonically_increasing_id()), "topk")
    asked = saved(queries_of(blocks, step, QUERY_BLOCK).withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    slots = max(1, blocks.count())
    # blocks in even numbers: those of a task stand after those of the tasks before it
    of_task = blocks.groupBy(F.shiftright("block", 33).alias("task")).agg(F.count("*").alias("n"))
    before = of_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    numbered = blocks.withColumn("task", F.shiftright("block", 33)).join(before, "task")
    right = numbered.withColumn("slot", (F.col("before") + F.col("block").bitwiseAND((1 << 33) - 1)).cast("int")).drop("task", "before")
    left = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    names = [f"q_{c}" for c in asked.columns] + right.columns

    def score(batches):
        last, known, held = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in names}
                if last != r["block"]:
                    ids, null, w = _unpack(*(r[c] for c in ("ids", "nulls", "weights", "kind", "terms")))
                    last, known = r["block"], {}
                own, _, q = _unpack(*(r[c] for c in ("q_ids", "q_nulls", "q_weights", "q_kind", "q_terms")))
                kind = _sum_type(q, w)
                if kind not in known:
                    known[kind] = postings(_as(w, kind))
                if r["q_q"] not in held:
                    if len(held) >= HELD:
                        for x in held.values():
                            yield from x[0].emit(*x[1:])
                        held = {}
                    held[r["q_q"]] = (_Choices(len(own), k), (r["q_q"] << 16) + np.arange(len(own)), own)
                choices = held[r["q_q"]][0]
                place = np.where(np.frombuffer(r["q_homes"], "<i8") == last, np.frombuffer(r["q_places"], "<i8"), -1)
                q = _as(q, kind)
                for low in range(0, len(own), QUERY_BATCH):
                    s = scores(q[low : low + QUERY_BATCH], len(ids), known[kind], kind)
                    for j, (at, found) in enumerate(best(s, place[low : low + QUERY_BATCH], ids, null, k)):
                        choices.add(low + j, found.tolist(), null[at].tolist(), ids[at].tolist())
        for x in held.values():
            yield from x[0].emit(*x[1:])

    met = left.join(right, "slot").select(*names).mapInArrow(score, _FOUND)
    exact = F.coalesce("exact", F.col("score").cast("string"))
    # longer integers are larger; those that a long holds are compared as longs
    size = F.when(F.col("exact").isNull(), 0).otherwise(F.when(F.col("exact").startswith("-"), -F.length("exact")).otherwise(F.length("exact")))
    digits = F.when(F.col("exact").startswith("-"), F.translate("exact", "0123456789", "9876543210")).otherwise(exact)
    beyond = F.when(F.col("exact").isNotNull(), digits)
    order = Window.partitionBy("query").orderBy(F.desc("score"), size.desc(), beyond.desc(), F.asc_nulls_last("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _as(w: np.ndarray, kind) -> np.ndarray:
    """w in the type that sums are made in."""
    if kind is object:
        return np.array([[int(c) for c in row] for row in w.tolist()], dtype=object).reshape(w.shape)
    return w.astype(kind)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
