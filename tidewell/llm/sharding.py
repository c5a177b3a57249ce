"""K-d tree sharding: leaves of near equal bytes.

A document is a point: its dimensions are size (logarithmic), language and source, each from 0 to 1.
A value of language or source has the place where its bytes begin when all values are laid side by
side, the heaviest first; beyond the HEAVIEST ones values share the rest of the line by a hash.
A node that must hold k shards' bytes is split in the ratio of the shards below, at a weighted
quantile (a median where the ratio is even) along the dimension in which its bytes spread widest;
a leaf holds the target bytes of one shard.
Quantiles are found by digits: one aggregation gives the bytes of each of 4096 intervals, for all
nodes and dimensions of a level at once; the interval that holds the quantile is cut again.
Within one value of a dimension documents are ordered by text checksum, so that equal texts stay
together; a group of equal texts too large for that is cut by a hash of doc_id, and one of equal rows by
a hash of the place that a row has where the points are written.

The driver holds histograms and at most HEAVIEST values of a dimension, never documents. The points
are written once; a document's node is an expression of the cuts made so far. The law is "bytes".

Defined results: a null text counts 8 bytes and has checksum 0; null metadata is a value of its own;
repeated rows are placed one by one; an empty table gives no rows; slots are gapless in each shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import saved, utf8_size

SHARDS = 24
ROW_BYTES = 8
DIGIT_BITS = 12
#: A cut is done when it misses the wanted bytes by so large a share of one shard at most.
TOLERANCE = 0.002
SLOT_ROWS = 20_000
#: Places on a dimension, and how many of its values have a place by weight.
PLACES = 1 << 28
HEAVIEST = 4_096
DIMENSIONS = ("d_size", "d_lang", "d_source")
#: Digits of a key: 60 bits of the dimension's value and checksum, 48 of a hash of doc_id, 24 of a hash of the row's place.
DIGITS = 11
_MASK = (1 << DIGIT_BITS) - 1


def _name(column: str) -> Column:
    """A value as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _placed(rows: DataFrame, column: str, total: int) -> DataFrame:
    """rows with the place of their value of `column` (a key), from 0 to PLACES: equal values have equal places."""
    heavy = rows.groupBy(column).agg(F.sum("size").alias("w")).orderBy(F.desc("w"), column).limit(HEAVIEST).collect()
    places, at = [], 0
    for r in heavy:
        places.append((r[column], at * PLACES // total))
        at += r["w"]
    rest = min(PLACES - 1, at * PLACES // max(1, total))
    table = rows.sparkSession.createDataFrame(places, f"{column} string, _place long")
    tail = F.lit(rest) + F.pmod(F.xxhash64(column), F.lit(PLACES - rest))
    return rows.join(F.broadcast(table), column, "left").withColumn(column, F.coalesce("_place", tail)).drop("_place")


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, own (a hash of doc_id), tie (one of the row's place) and the keys of the dimensions, written out."""
    size = utf8_size(F.col("text")) + ROW_BYTES
    own = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 16)
    base = saved(docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("crc"), own.alias("own"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 24)).alias("tie"), _name("lang").alias("lang"), _name("source").alias("source")), "kd")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    for column in ("lang", "source"):
        base = _placed(base, column, total)
    wide = F.least(F.floor((F.log2(F.col("size").cast("double")) - 3) * (PLACES / 20)), F.lit(PLACES - 1)).cast("long")  # 8 bytes to 8 MB and over
    key = lambda value: F.shiftleft(value, 32).bitwiseOR(F.col("crc"))
    return saved(base.select("doc_id", "size", "crc", key(wide).alias("d_size"), key(F.col("lang")).alias("d_lang"), key(F.col("source")).alias("d_source"), "own", "tie"), "kd")


#: The columns that a key's digits come from after the dimension's own: (column, digits up to here).
_PARTS = (("own", 9), ("tie", DIGITS))


def _digit(dim: str, k: int) -> Column:
    """The k-th 12-bit digit: five of the dimension's key, four of the document's own hash, two of the row's."""
    at, end = next(((c, end) for c, end in ((dim, 5), *_PARTS) if k < end))
    return F.shiftrightunsigned(F.col(at), DIGIT_BITS * (end - 1 - k)).bitwiseAND(_MASK).cast("int")


def _below(dim: str, path: list[int]) -> Column:
    """Whether a point lies before the cut that these digits name."""
    out, equal, begin = F.lit(False), F.lit(True), 0
    for column, end in ((dim, 5), *_PARTS):
        own = path[begin:end]
        if own:
            head = F.lit(reduce(lambda a, d: a << DIGIT_BITS | d, own, 0) << DIGIT_BITS * (end - begin - len(own)))
            out, equal = out | equal & (F.col(column) < head), equal & (F.col(column) == head)
        begin = end
    return out


def _case(column: str, choices: list[tuple[int, Column]], other: Column) -> Column:
    return reduce(lambda c, x: c.when(F.col(column) == x[0], x[1]), choices[1:], F.when(F.col(column) == choices[0][0], choices[0][1])).otherwise(other) if choices else other


class _Cut:
    """The search for one node's quantile."""

    def __init__(self, node: int, shards: int):
        self.node, self.shards, self.left = node, shards, shards // 2
        self.dim, self.path, self.goal, self.done, self.unit = "", [], 0.0, False, 0.0

    def start(self, histograms: dict[str, dict[int, tuple[int, int]]]) -> None:
        total = sum(w for w, _ in histograms[DIMENSIONS[0]].values())
        self.goal, self.unit = total * self.left / self.shards, total / self.shards
        self.dim = max(DIMENSIONS, key=lambda d: _spread(histograms[d]))
        self.step(histograms[self.dim])

    def step(self, histogram: dict[int, tuple[int, int]]) -> None:
        """Choose the interval that holds the quantile; goal becomes what is wanted inside it."""
        chosen = max(histogram)
        for digit in sorted(histogram):
            if histogram[digit][0] > self.goal:
                chosen = digit
                break
            self.goal -= histogram[digit][0]
        else:
            chosen, self.goal = chosen + 1, 0.0
        size, n = histogram.get(chosen, (0, 0))
        near, last = TOLERANCE * self.unit, n == 1 or len(self.path) == DIGITS - 1
        if self.goal > 0 and (size - self.goal <= near or last and 2 * self.goal > size):  # the interval's end is nearer or near enough
            chosen, self.goal = chosen + 1, 0.0
        self.path.append(chosen)
        self.done = self.goal <= near or last
        if chosen > _MASK:
            self._carry()

    def _carry(self) -> None:
        while self.path and self.path[-1] > _MASK and len(self.path) > 1:
            self.path.pop()
            self.path[-1] += 1


def _spread(histogram: dict[int, tuple[int, int]]) -> float:
    """Variance of the bytes along a dimension."""
    n = sum(w for w, _ in histogram.values()) or 1
    mean = sum(d * w for d, (w, _) in histogram.items()) / n
    return sum(w * (d - mean) ** 2 for d, (w, _) in histogram.items()) / n


def _histograms(rows: DataFrame, cuts: list[_Cut], dims: tuple[str, ...]) -> dict[tuple[int, str], dict[int, tuple[int, int]]]:
    """Bytes and rows by (node, dimension, next digit), for the nodes whose cuts are open, in one aggregation."""
    if len(dims) > 1:
        digits = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), _digit(d, 0).alias("digit")) for d in dims]))
        some = rows.filter(F.col("node").isin([c.node for c in cuts])).select("node", "size", digits.alias("x")).select("node", "size", "x.dim", "x.digit")
    else:
        inside = F.lit(False)
        for c in cuts:
            up = [*c.path[:-1], c.path[-1] + 1]
            inside = inside | (F.col("node") == c.node) & ~_below(c.dim, c.path) & (_below(c.dim, up) if up[-1] <= _MASK else _prefix_is(c.dim, c.path))
        digit = _case("node", [(c.node, _digit(c.dim, len(c.path))) for c in cuts], F.lit(0))
        some = rows.filter(inside).select("node", "size", F.lit("").alias("dim"), digit.alias("digit"))
    out: dict = {}
    for r in some.groupBy("node", "dim", "digit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        out.setdefault((r["node"], r["dim"]), {})[r["digit"]] = (r["bytes"], r["n"])
    return out


def _prefix_is(dim: str, path: list[int]) -> Column:
    return reduce(lambda a, b: a & b, [_digit(dim, k) == d for k, d in enumerate(path)])


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The leaves are `shards`, or as many as hold about target_bytes each.
    """
    base = points(docs)
    if target_bytes:
        shards = max(1, round((base.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    rows, cuts_of = base.withColumn("node", F.lit(0)), {}
    leaves = {0: (0, shards)}  # node: its first shard, how many
    while any(n > 1 for _, n in leaves.values()):
        cuts = [_Cut(node, n) for node, (_, n) in leaves.items() if n > 1]
        first = _histograms(rows, cuts, DIMENSIONS)
        cuts = [c for c in cuts if (c.node, DIMENSIONS[0]) in first]
        if not cuts:
            break
        for c in cuts:
            c.start({d: first[c.node, d] for d in DIMENSIONS})
        while some := [c for c in cuts if not c.done]:
            more = _histograms(rows, some, ("",))
            for c in some:
                if found := more.get((c.node, "")):
                    c.step(found)
                else:
                    c.done = True
        after = {node: x for node, x in leaves.items() if x[1] == 1}
        for c in cuts:
            at = leaves[c.node][0]
            right = at + c.left
            after[at], after[right] = (at, c.left), (right, c.shards - c.left)
            cuts_of[at, c.shards] = c
        rows, leaves = base.withColumn("node", _node(cuts_of, 0, shards)), after
    return _slotted(rows, shards)


def _node(cuts: dict[tuple[int, int], _Cut], at: int, n: int) -> Column:
    """The node of a point under that of n shards from `at` on: each cut is compared once."""
    if (at, n) not in cuts:
        return F.lit(at)
    c = cuts[at, n]
    return F.when(_below(c.dim, c.path), _node(cuts, at, c.left)).otherwise(_node(cuts, at + c.left, n - c.left))


def _slotted(rows: DataFrame, shards: int) -> DataFrame:
    """Number each shard's rows without a gap: in parts of about SLOT_ROWS, each starting where the parts before it end."""
    placed = rows.select("doc_id", "size", "crc", F.col("node").alias("shard"), "own", "tie")
    n = placed.count()
    parts = max(1, n // (shards * SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("own", "crc", "tie"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("own", "tie", "doc_id")
    return placed.join(starts, ["shard", "part"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
