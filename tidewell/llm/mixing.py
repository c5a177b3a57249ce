"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of doc_id. From its target follow whole passes over the
source plus a part of one more pass: that part is the blocks that still fit, in a permuted order,
and one block of which only a part is drawn, found by cutting that block into smaller ones. The
number of a source's drawn blocks is its quota, and the quotas are spread over output shards: a tree splits the
shards in two again and again, and at each node a multivariate-hypergeometric draw says how many
blocks of each source go left. A shard takes the next blocks of each source's permuted order, so the
blocks of shards are disjoint, and orders its documents by a hash of their own. A document is taken
once for each pass that some shard has drawn over its block; taken() names these shards, and
shuffled() writes shard after shard.

The plan is made of tables: one row per source, and one per source and block. Sources are put in
groups of about GROUP_SOURCES; the tree runs over the groups on the driver and over the sources of
a group in a task, which is the same draw. No document and no single source comes to the driver.

Defined results: a null text has size 0; sources are ordered by code point with null last; a source
without words has target 0 and takes nothing; repeated rows are taken alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import numbered, saved, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
DIGIT_BITS = 9
LEVELS = 5
SHARDS = 16
SEED = 20240
#: A source is within its target if it misses by so large a share at most, or if no document is left to cut.
TOLERANCE = 0.0005
GROUP_SOURCES = 4096
#: A draw can be made from so many blocks at most, of all sources together.
MOST_BLOCKS = 300_000_000
#: A plan of up to so many rows is broadcast.
BROADCAST_PLAN = 200_000


def with_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """sources (i, source_size) with target: shares by weight of all sizes; what exceeds `most` times a
    source's size is shared anew by weight, until none is above. Only sums come to the driver."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("i", F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    cap = most * F.col("source_size").cast("double")
    share = 0.0
    while True:
        over = F.lit(share) * F.col("weight") > cap if share else F.lit(False)
        s = rows.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        after = (float(s["total"]) - s["capped"]) / s["free"] if s["free"] else share
        if after <= share:
            return rows.withColumn("target", F.when(over, cap).otherwise(F.lit(share) * F.col("weight"))).drop("weight")
        share = after


def splitting_tree(quotas: np.ndarray, wanted: np.ndarray, seed: list[int]) -> np.ndarray:
    """How many of each colour's drawn blocks each shard gets, `wanted` in all; rows are shards, columns colours. What no shard wants is left out."""
    out, all_ = np.zeros((len(wanted), len(quotas)), dtype=np.int64), np.asarray(quotas, dtype=np.int64)
    if all_.sum() > wanted.sum():
        all_ = np.random.default_rng(seed).multivariate_hypergeometric(all_, int(wanted.sum()), method="marginals")

    def split(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        draw = int(wanted[first:middle].sum())
        rng = np.random.default_rng([*seed, first, last])
        left = rng.multivariate_hypergeometric(have, draw, method="marginals") if have.sum() else have
        split(first, middle, left)
        split(middle, last, have - left)

    split(0, len(wanted), all_)
    return out


def choose(words: np.ndarray, n: np.ndarray, rest: float, near: float, last: bool) -> tuple[np.ndarray, int, float]:
    """(taken, the piece to cut or -1, what is left of rest): pieces that fit, in order; the first that doesn't and can be cut is cut.

    Where nothing is left to cut, the least whole piece is taken too if that brings the sum nearer.
    """
    taken, cut = np.zeros(len(words), bool), -1
    whole = n == 1
    if last:
        whole = np.ones(len(n), bool)
    for j, size in enumerate(words.tolist()):
        if not size or rest <= near:
            continue
        if size <= rest:
            taken[j], rest = True, rest - size
        elif cut < 0 and not whole[j]:
            cut = j
    if cut < 0 and rest > near:
        left = np.flatnonzero(~taken & whole & (words > 0))
        if len(left):
            j = left[np.argmin(words[left])]
            if words[j] < 2 * rest:
                taken[j], rest = True, rest - words[j]
    return taken, cut if rest > near else -1, float(rest)


_CHOSEN = "k string, prefix long, words long, n long, level int, extra boolean, cut boolean, rest double"


def _chosen(pieces: DataFrame, level: int) -> DataFrame:
    """pieces (k, prefix, words, n, at, rest, near), at most 2^DIGIT_BITS of a source: which are drawn once more, and which is to be cut."""

    def one(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("prefix").to_numpy(), table.column("at").to_numpy()))
        t = table.take(pa.array(order))
        taken, cut, rest = choose(t.column("words").to_numpy(), t.column("n").to_numpy(), t.column("rest")[0].as_py(), t.column("near")[0].as_py(), level == LEVELS - 1)
        size = len(order)
        columns = [t.column(c) for c in ("k", "prefix", "words", "n")]
        return pa.table([*columns, pa.array([level] * size, pa.int32()), pa.array(taken), pa.array(np.arange(size) == cut), pa.array([rest] * size, pa.float64())], names=[x.split()[0] for x in _CHOSEN.split(", ")])

    return pieces.groupBy("k").applyInArrow(one, _CHOSEN)


class Mix:
    """The plan of one mix: what each source gives, and which shard takes which pass over which block."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, shards: int = SHARDS, seed: int = SEED):
        self.seed = seed
        size = word_count(F.col("text"))
        self.raw = saved(docs.select("doc_id", "source", size.alias("size")).withColumns({"h": self._hash(), "k": _key("source")}), "mix")
        sums = self.raw.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
        sources = numbered(sums, F.asc_nulls_last("source"))
        n = sources.count()
        if n > MOST_BLOCKS:
            raise ValueError(f"{n} sources; at most {MOST_BLOCKS}")
        self.bits = min(DIGIT_BITS, (MOST_BLOCKS // max(1, n)).bit_length() - 1)
        whole = F.least(F.floor(F.try_divide("target", "source_size")), F.lit(MOST_REPEATS))
        sources = with_targets(sources, weights).withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int"))
        rest = F.when((F.col("whole") < MOST_REPEATS) & (F.col("source_size") > 0), F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
        self.sources = saved(sources.withColumns({"rest": rest, "near": TOLERANCE * F.greatest("target", F.lit(1.0))}), "mix-sources")
        self.plan = self._plan(max(1, n // GROUP_SOURCES), shards)

    def _hash(self) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "doc_id"), 1)

    def _prefix(self, level: int) -> Column:
        """The hash's leading bits: the block, then a digit for each level."""
        return F.shiftrightunsigned("h", 63 - self.bits - DIGIT_BITS * level)

    def _plan(self, groups: int, shards: int) -> DataFrame:
        """(k, block, source_size, target, passes, drawn, under): passes over a block, the shard of each pass and of the partial one, and the parts of the block that the partial pass takes."""
        pieces = self.raw.groupBy("k", self._prefix(0).alias("prefix")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        order = F.xxhash64(F.lit(self.seed), "k", "prefix")
        blocks = saved(_chosen(pieces.withColumn("at", order).join(self.sources.select("k", "rest", "near"), "k"), 0), "mix-blocks")
        found, cut = blocks, blocks
        for level in range(1, LEVELS):
            cut = cut.filter("cut").select("k", F.col("prefix").alias("up"), "rest")
            if cut.isEmpty():
                break
            inside = self.raw.withColumn("up", self._prefix(level - 1)).join(cut, ["k", "up"])
            pieces = inside.groupBy("k", self._prefix(level).alias("prefix")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("rest").alias("rest"))
            cut = saved(_chosen(pieces.withColumn("at", F.lit(0).cast("long")).join(self.sources.select("k", "near"), "k"), level), "mix-blocks")
            found = found.union(cut)
        under = found.filter("level > 0 and extra").groupBy("k").agg(F.collect_list(F.struct("level", "prefix")).alias("under"))
        of_block = self.sources.select("k", "source_size", "target", "whole")
        blocks = blocks.join(of_block, "k").select("k", F.col("prefix").alias("block"), "source_size", "target", (F.col("whole") + F.col("extra").cast("int")).alias("passes"), "cut")
        blocks = blocks.join(under, "k", "left").withColumn("under", F.when(F.col("cut"), F.col("under")))
        blocks = saved(blocks.withColumn("draws", F.col("passes") + F.col("under").isNotNull().cast("int")), "mix-blocks")
        return saved(self._drawn(blocks, groups, shards), "mix-plan")

    def _drawn(self, blocks: DataFrame, groups: int, shards: int) -> DataFrame:
        """blocks with `drawn`: the tree's quotas, filled from each source's permuted order of its blocks' passes."""
        group = F.pmod(F.xxhash64(F.lit(self.seed), "k"), F.lit(groups)).cast("int")
        quotas = blocks.groupBy("k").agg(F.sum("draws").alias("quota")).withColumn("g", group)
        of_group = {r["g"]: r["quota"] for r in quotas.groupBy("g").agg(F.sum("quota").alias("quota")).collect()}
        have = np.array([of_group.get(g, 0) for g in range(groups)], dtype=np.int64)
        tree = splitting_tree(have, np.diff(np.arange(shards + 1) * int(have.sum()) // shards), [self.seed])
        seed = self.seed

        def of_sources(table: pa.Table) -> pa.Table:
            g = table.column("g")[0].as_py()
            t = table.sort_by("k")
            parts = splitting_tree(t.column("quota").to_numpy(), tree[:, g], [seed, g])
            ends = np.cumsum(parts, axis=0).T
            return pa.table([t.column("k"), pa.array(list(ends), pa.list_(pa.int64()))], names=["k", "ends"])

        ends = quotas.groupBy("g").applyInArrow(of_sources, "k string, ends array<long>")
        passes = blocks.filter("draws > 0").select("k", "block", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("pass"))
        rank = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(self.seed + 1), "k", "block", "pass"), "block", "pass"))
        placed = passes.withColumn("rank", rank).join(ends, "k").select("k", "block", "pass", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"))
        drawn = placed.filter(F.col("shard") < shards).groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))
        return blocks.join(drawn, ["k", "block"], "left").drop("draws", "cut")

    def _passes(self, rows: DataFrame) -> DataFrame:
        """rows (k, h, doc_id and more) with their block and, for each pass that takes them, the shard that drew it and the place key there."""
        plan = F.broadcast(self.plan) if self.plan.count() <= BROADCAST_PLAN else self.plan
        out = rows.withColumn("block", self._prefix(0)).join(plan, ["k", "block"])
        here = F.lit(False)
        for level in range(1, LEVELS):
            here = here | F.exists("under", lambda u: (u["level"] == level) & (u["prefix"] == self._prefix(level)))  # noqa: B023
        extra = F.coalesce(here, F.lit(False)).cast("int")
        most = F.col("passes") + extra
        shards = F.transform(F.filter(F.coalesce("drawn", F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: d["pass"] <= most), lambda d: d["shard"])
        places = F.transform("shards", lambda _, j: F.xxhash64(F.lit(self.seed), "doc_id", j))
        return out.withColumn("shards", shards).withColumn("passes", F.size("shards")).withColumn("places", places).drop("drawn", "under")

    def taken(self) -> DataFrame:
        """A row per row of the corpus: what the mix takes of it, with the shard and the place key of each pass."""
        return self._passes(self.raw).select(
            "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", "block", "shards", "places"
        )

    def _copied(self, docs: DataFrame) -> DataFrame:
        """(row, shard, place) of each taken copy, docs' rows as one column."""
        inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), _key("source").alias("k"))
        some = self._passes(inner.withColumn("h", self._hash())).select("row", F.explode(F.arrays_zip("shards", "places")).alias("x"))
        return some.select("row", F.col("x.shards").alias("shard"), F.col("x.places").alias("place"))

    def copies(self, docs: DataFrame) -> DataFrame:
        """The mixed corpus: a row for each taken copy, with docs' columns, its shard (_shard) and its place key in the shard (_place)."""
        return self._copied(docs).select("row.*", F.col("shard").alias("_shard"), F.col("place").alias("_place"))

    def shuffled(self, docs: DataFrame) -> DataFrame:
        """The mixed corpus with docs' columns, shard after shard, each in the order of its place keys."""
        order = ("shard", "place")
        return self._copied(docs).repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def _key(column: str) -> Column:
    """A source's name, or what stands for none, as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))
