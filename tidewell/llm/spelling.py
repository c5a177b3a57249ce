"""Grouping of spelling variants: words one edit apart, found by merging subtrees of tries.

Words are counted over the whole corpus. Two words that differ by one replaced, inserted or deleted
code point agree before and after it. So the places where the edit may be, 0 to m for a shorter word of m code
points, are cut into two intervals, and words meet that agree before and after an interval; a
meeting of over GROUP_MOST words has its interval cut again, down to single places, where an
alphabet bounds its size.

A meeting's middles (what lies in the interval) form a path-compressed trie, each branching node or
end of a word is a node. The child with most words is heavy, the others are light (heavy paths). At a node the subtrees of
all children are merged with their first character replaced, and each child's subtree with its first character
skipped is merged with its siblings; only what the lighter subtree holds is walked, so a word is
walked once for each light edge above it, at most the logarithm of the words. Ends that coincide are the one-edit
pairs, each of which is found in just one interval: a replaced character has one place, and a
deletion counts at the end of what the two words share.

Pairs go both ways to their words, where they are counted and the form is chosen. A form is at least
twice as frequent as its word, so chains are short: roots come from doubling joins over the words
that still have somewhere to go.

Defined results: a null or empty text has no runs; a null doc_id counts as the empty string in the
hash; repeated rows count as often as they come; runs and texts of any length are taken whole; ties
go to the smaller word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import saved

#: Runs, which of them are damaged, and which words count.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGE = 97
SHORTEST, LEAST = 5, 3
DOMINANCE = 2
GROUP_MOST = 20_000
#: A task's counts are emitted when so many different words have come together.
HELD = 300_000

PAIRS = "word string, other string, n_other long"


def counted(docs: DataFrame, damage: int = DAMAGE, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n), written out: the words of at least `shortest` code points with at least `least` occurrences in docs (doc_id, text)."""

    def rows(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        total[word] += n
            if len(total) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(total.values(), pa.int64())], names=["word", "n"])
                total = Counter()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(total.values(), pa.int64())], names=["word", "n"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "word string, n long")
    return saved(own.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "words")


@dataclass(slots=True)
class Node:
    """Words low to high share `depth` characters and part there; term is the word that ends there, or -1."""

    low: int
    high: int
    depth: int
    term: int = -1
    children: dict[str, Node] = field(default_factory=dict)


def trie(words: list[str]) -> Node:
    """The path-compressed trie of sorted, different words."""

    def shared(a: str, b: str, at: int) -> int:
        most = min(len(a), len(b))
        if a[at:most] == b[at:most]:
            return most
        while a[at] == b[at]:
            at += 1
        return at

    root = Node(0, len(words), 0)
    todo = [root]
    while todo:
        node = todo.pop()
        at = node.depth = shared(words[node.low], words[node.high - 1], node.depth)
        low = node.low
        if len(words[low]) == at:
            node.term, low = low, low + 1
        while low < node.high:
            c, high = words[low][at], node.high
            a, b = low, high  # the first word with another character
            while a < b:
                middle = (a + b) // 2
                if words[middle][at] == c:
                    a = middle + 1
                else:
                    b = middle
            node.children[c] = child = Node(low, a, at)
            todo.append(child)
            low = a
    return root


#: A place in a trie: below so many characters on the way to a node.
Place = tuple[Node, int]


def meet(words: list[str], one: Place, other: Place) -> Iterator[tuple[int, int]]:
    """Words below two places whose rests are equal; the smaller subtree decides how much is walked."""
    todo = [(one, other)]
    while todo:
        (x, dx), (y, dy) = todo.pop()
        n = min(x.depth - dx, y.depth - dy)
        if n and words[x.low][dx : dx + n] != words[y.low][dy : dy + n]:
            continue
        dx, dy = dx + n, dy + n
        if dx == x.depth and dy == y.depth:
            if x.term >= 0 and y.term >= 0:
                yield x.term, y.term
            less, more = (x, y) if len(x.children) <= len(y.children) else (y, x)
            todo += [((x.children[c], dx), (y.children[c], dy)) for c in less.children if c in more.children]
        elif dx == x.depth:
            if (child := x.children.get(words[y.low][dy])) is not None:
                todo.append(((child, dx), (y, dy)))
        elif (child := y.children.get(words[x.low][dx])) is not None:
            todo.append(((x, dx), (child, dy)))


def merged(words: list[str], places: list[Place]) -> Iterator[tuple[int, int]]:
    """Words below different places whose rests are equal; the first place is the heavy one, it is only looked up."""
    todo = [places]
    while todo:
        now = todo.pop()
        if len(now) == 2:
            yield from meet(words, *now)
            continue
        ends: list[int] = []
        branches: dict[str, list[Place]] = {}
        for k, (node, d) in enumerate(reversed(now)):  # the heavy one comes last, with characters that lights have
            heavy = k == len(now) - 1
            if d < node.depth:
                c = words[node.low][d]
                if not heavy or c in branches:
                    branches.setdefault(c, []).append((node, d + 1))
                continue
            if node.term >= 0:
                ends.append(node.term)
            if heavy:
                for c, own in branches.items():
                    if c in node.children:
                        own.append((node.children[c], d + 1))
            else:
                for c, child in node.children.items():
                    branches.setdefault(c, []).append((child, d + 1))
        yield from ((a, b) for k, a in enumerate(ends) for b in ends[:k])
        todo += [own[::-1] for own in branches.values() if len(own) > 1]


def edit_pairs(words: list[str], short: int, last: bool) -> Iterator[tuple[int, int]]:
    """Pairs of sorted, different words of `short` or `short` + 1 characters that are one edit apart, one of `short` among them.

    A deletion of the end of the longer word counts only if last.
    """
    of_short = [0]
    for w in words:
        of_short.append(of_short[-1] + (len(w) == short))
    todo = [trie(words)]
    while todo:
        v = todo.pop()
        children = sorted(v.children.values(), key=lambda x: x.low - x.high)  # the heavy one first
        todo += [x for x in children if x.high - x.low > 1]
        able = [(x, v.depth + 1) for x in children if of_short[x.high] > of_short[x.low]]
        if len(able) > 1:
            yield from (pair for pair in merged(words, able) if len(words[pair[0]]) == short)
        for first, child in v.children.items():
            at = v.depth + 1
            if child.depth > at:
                c = words[child.low][at]
                if c != first and c in v.children:
                    yield from meet(words, (child, at), (v.children[c], v.depth))
                continue
            if child.term >= 0 and v.term >= 0 and (last or v.depth < short):
                yield child.term, v.term
            less, more = (child, v) if len(child.children) <= len(v.children) else (v, child)
            for c in less.children:
                if c != first and c in more.children:
                    yield from meet(words, (child.children[c], at), (v.children[c], v.depth))


def _meetings(words: DataFrame) -> DataFrame:
    """(word, n, m, low, high): a word and the intervals of places that it takes part with, as the shorter or the longer word."""
    size = F.char_length("word")
    lengths = F.explode(F.array(size, size - 1)).alias("m")
    cut = F.floor(F.col("m") / 2).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("low"), cut.alias("high")), F.struct(cut.alias("low"), F.col("m").alias("high")))
    return words.select("word", "n", lengths).select("word", "n", "m", F.explode(ends).alias("e")).select("word", "n", "m", "e.low", "e.high")


#: What a word has before an interval, and after it.
BEFORE, AFTER = "substring(word, 1, low)", "substring(word, char_length(word) - m + high + 1)"


def meetings(words: DataFrame, most: int = GROUP_MOST) -> DataFrame:
    """(word, n, m, low, high, before, after): those that agree in all but word and n meet; over `most` only at single places."""
    out, open_ = None, _meetings(words)
    while True:
        own = open_.withColumns({"before": F.expr(BEFORE), "after": F.expr(AFTER)})
        key = ["m", "low", "high", "before", "after"]
        large = saved(own.filter(F.col("high") - F.col("low") > 1).groupBy(*key).count().filter(F.col("count") > most).drop("count"), "large")
        if large.isEmpty():
            return own if out is None else out.unionByName(own)
        small = own.join(large, key, "left_anti")
        out = small if out is None else out.unionByName(small)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        cut = own.join(large, key, "left_semi").select("word", "n", "m", F.explode(halves).alias("e"))
        open_ = saved(cut.select("word", "n", "m", "e.low", "e.high"), "cut")


def near_pairs(words: DataFrame, most: int = GROUP_MOST) -> DataFrame:
    """(word, other, n_other) for each ordered pair of words (word, n) that are one edit apart, once."""

    def found(key: tuple, group: list[tuple[str, int]]):
        m, low, high, before, after = key
        group.sort(key=lambda x: x[0][low : len(x[0]) - (m - high)])
        for a, b in edit_pairs([w[low : len(w) - (m - high)] for w, _ in group], high - low, high == m):
            yield group[a][0], *group[b]
            yield group[b][0], *group[a]

    def rows(batches):
        key, group, out = None, [], []
        for batch in batches:
            for *own, word, n in zip(*(batch.column(c).to_pylist() for c in ("m", "low", "high", "before", "after", "word", "n"))):
                if own != key:
                    if len(group) > 1:
                        out += found(key, group)
                    key, group = own, []
                group.append((word, n))
                if len(out) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["word", "other", "n_other"])
                    out = []
        if len(group) > 1:
            out += found(key, group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["word", "other", "n_other"])

    key = ["m", "low", "high", "before", "after"]
    own = meetings(words, most)
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(rows, PAIRS)


def forms(words: DataFrame, most: int = GROUP_MOST) -> DataFrame:
    """(word, n, n_near, form, form_n), written out."""
    pairs = near_pairs(words, most)
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    chosen = joined.withColumn("ok", F.coalesce(-F.col("best.less") >= DOMINANCE * F.col("n"), F.lit(False)))
    out = chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("best.other")).alias("form"), F.when(F.col("ok"), -F.col("best.less")).alias("form_n"))
    return saved(out, "forms")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where the chain of forms (word, form) ends. Each round doubles the steps taken."""
    ahead = links.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        nexts = ahead.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        stepped = ahead.filter("open").join(nexts, F.col("root") == F.col("_word"), "left")
        moved = stepped.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("open"))
        later = saved(moved.unionByName(ahead.filter(~F.col("open"))), "roots")
        if later.filter("open").isEmpty():
            return later.select("word", "root")
        ahead = later


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs (doc_id, text)."""
    own = forms(counted(docs))
    ends = roots(own)
    return own.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 as arithmetic on bytes: a table of 256 remainders, folded over the bytes of a string (as hexadecimal digits).
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, {_STEP}, k + 1 FROM bits WHERE k < 8
), remainders AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY doc_id, w
), bytes AS (
  SELECT doc_id, w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM runs
), hashed AS (
  SELECT doc_id, w, n, xor(list_reduce(list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM bytes, remainders
), damaged AS (
  SELECT CASE WHEN crc % {DAMAGE} = 0 THEN w[:crc % len(w)] || w[crc % len(w) + 2:] ELSE w END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE len(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}
), holes AS (SELECT word, n, i, word[:i] AS a, word[i + 2:] AS b FROM words, range(0, len(word)) AS r(i)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS n_other FROM holes x JOIN holes y USING (i, a, b) WHERE x.word != y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON y.word = x.a || x.b
), near AS (SELECT word, count(*) AS n_near, max(n_other) AS most FROM pairs GROUP BY word),
chosen AS (SELECT word, min(other) AS form, any_value(most) AS form_n FROM pairs JOIN near USING (word) JOIN words USING (word) WHERE n_other = most AND most >= {DOMINANCE} * n GROUP BY word),
chain AS (SELECT word, word AS stop, 0 AS k FROM words UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN chosen f ON c.stop = f.word),
ends AS (SELECT word, arg_max(stop, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM words LEFT JOIN near USING (word) LEFT JOIN chosen USING (word) JOIN ends USING (word)
"""
