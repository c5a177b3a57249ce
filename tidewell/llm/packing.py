"""Best-fit packing by length patterns and non-negative least squares.

Documents become token pieces of at most SEQUENCE tokens. The driver sees only the histogram of
piece lengths: it enumerates the patterns of up to three lengths that fill a sequence, fits repeat
counts to the histogram by non-negative least squares, rounds a share of them down to what is there, and packs
what is left best-fit with the longest first, still in counts by length. The plan maps the r-th
piece of a length to a sequence and an offset; ranks are counted per length in many small parts. A
piece that fills a sequence is one, and takes no part in plan and ranks.

Defined results: a null or empty text is the end token alone; repeated rows are packed one by one;
an empty table gives no rows; a text of any length is tokenized whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import saved

SEQUENCE = 1024
END_ID = 2
PART_ROWS = 1_000
#: Ids of sequences that one piece fills begin here.
WHOLE = 1 << 61
#: A tokenizing task remembers so many words at most.
REMEMBERED = 300_000
#: Marks that are neither white space, letters nor numbers, and that no contraction holds.
MARKS = ".,;:!?#$%&*|"
#: Words or texts that are encoded, and texts that are cut, at a time.
ENCODED, CUT = 2_000, 200
NNLS_COLUMNS = 48
NNLS_TOLERANCE = 1e-2
#: So much of each fitted count is tried to be laid out by patterns; best fit may do better with some of every length left.
FITTED_SHARES = (1.0, 0.75, 0.5, 0.25)


def _rank_encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordTokenizer:
    """Ids of whole texts, word by word.

    The tokenizer's pattern never joins text across a lone space or line feed between two other
    characters, so the words of such a text are encoded once and remembered. Any text with other
    white space is encoded whole. `ranks` may name the same vocabulary as a file of ranks, with
    which tiktoken encodes words, to the same ids, in a quarter of the time.
    """

    def __init__(self, path: str, end: int, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = _rank_encoder(ranks) if ranks else None
        self.heads, self.tails, self.marks, self.end = {}, {}, {}, np.array([end], "<u4").tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for low in range(0, len(texts), ENCODED):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[low : low + ENCODED], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [array("I", self.words(x)).tobytes() for x in words] if self.words else self._encode(words)

    def _learn(self, known: dict[str, bytes], asked: set[str], lead: str) -> None:
        """Remember words' ids. Marks after a letter or a number are a token run of their own, so the word without them is encoded once."""
        new, parts = asked - known.keys(), {}
        for w in new:
            bare = w.rstrip(MARKS)
            if bare and bare != w and bare[-1].isalnum():
                parts[w] = bare
        plain = list((new - parts.keys() | set(parts.values())) - known.keys())
        known.update(zip(plain, self._encode_words([lead + x for x in plain])))
        marks = list({w[len(bare) :] for w, bare in parts.items()} - self.marks.keys())
        self.marks.update(zip(marks, self._encode_words(marks)))
        for w, bare in parts.items():
            known[w] = known[bare] + self.marks[w[len(bare) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.heads) + len(self.tails) > REMEMBERED:
            self.heads, self.tails = {}, {}
        split, heads, tails = [], {"\n"}, set()
        for text in texts:
            lines = [x.split(" ") for x in text.split("\n")]
            if all(x == y.split() for x, y in zip(lines, text.split("\n"))) and lines[0] and lines[0][0]:
                heads.update(x[0] for x in lines)
                for x in lines:
                    tails.update(x[1:])
                split.append(lines)
            else:
                split.append(None)
        self._learn(self.heads, heads, "")
        self._learn(self.tails, tails, " ")
        whole = iter(self._encode([t for t, x in zip(texts, split) if x is None]))
        feed, head, tail = self.heads["\n"], self.heads, self.tails.__getitem__
        out = []
        for lines in split:
            if lines is None:
                out.append(next(whole) + self.end)
            else:
                out.append(feed.join(head[x[0]] + b"".join(map(tail, x[1:])) for x in lines) + self.end)
        return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END_ID, ranks: str | None = None) -> DataFrame:
    """The token pieces of docs: only longer documents are cut, so that all pieces but the first are full."""

    def rows(batches):
        words = WordTokenizer(tokenizer, end, ranks)
        for batch in batches:
            out, ids_of = [], batch.column("doc_id").to_pylist()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for low in range(0, len(texts), CUT):
                for doc, ids in zip(ids_of[low : low + CUT], words.encode(texts[low : low + CUT])):
                    n = len(ids) // 4
                    at, to = 0, n % sequence or sequence
                    piece = 0
                    while at < n:
                        out.append((doc, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                        piece, at, to = piece + 1, to, to + sequence
            if out:
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [x.split()[0] for x in PIECES.split(",")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PIECES)


def patterns(sequence: int) -> np.ndarray:
    """All ways to fill a sequence with two or three pieces; rows are lengths, 0 where there are two."""
    two = np.arange(1, sequence // 2 + 1)
    rows = [np.stack([np.zeros_like(two), two, sequence - two], axis=1)]
    for a in range(1, sequence // 3 + 1):
        b = np.arange(a, (sequence - a) // 2 + 1)
        rows.append(np.stack([np.full_like(b, a), b, sequence - a - b], axis=1))
    return np.concatenate(rows)


def fit(wanted: np.ndarray, ways: np.ndarray) -> dict[int, float]:
    """Repeat counts of patterns that bring the histogram nearest to `wanted`: an active-set NNLS that
    lets in a block of patterns with disjoint lengths at a time, a smaller one when a block lessens the
    squared error by less than a share of NNLS_TOLERANCE, and stops when one pattern does."""
    goal = wanted.astype(float).copy()
    goal[0] = 0.0
    active, x = np.zeros(0, np.int64), np.zeros(0)
    allowed = np.flatnonzero((goal[ways[:, 1]] > 0) & (goal[ways[:, 2]] > 0) & ((ways[:, 0] == 0) | (goal[ways[:, 0]] > 0)))

    def held(cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The histogram of these patterns, repeated so often."""
        out = np.bincount(ways[cols].ravel(), weights=np.repeat(x, 3), minlength=len(goal))
        out[0] = 0.0
        return out

    def common(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Products of the patterns' columns: lengths in common, repeats counted."""
        parts = (ways[some][:, :, None, None] == ways[others].T[None, None]) & (ways[some] > 0)[:, :, None, None]
        return parts.sum(axis=(1, 2)).astype(float)

    gram = np.zeros((0, 0))  # of the active patterns; grows and shrinks with them
    best, most = (np.inf, active, x, gram), NNLS_COLUMNS
    while True:
        left = goal - held(active, x)
        left[0] = 0.0
        error = left @ left
        if error > (1 - NNLS_TOLERANCE) * best[0]:  # the columns let in bring the histogram hardly nearer: fewer at a time, from the best so far
            best = min(best, (error, active, x, gram), key=lambda e: e[0])
            if most == 1:
                break
            _, active, x, gram = best
            most = max(1, most // 4)
            left = goal - held(active, x)
            left[0] = 0.0
        else:
            best = (error, active, x, gram)
        gain = left[ways[allowed]].sum(axis=1)
        gain[np.isin(allowed, active)] = 0.0
        used, new = set(), []
        for j in np.argsort(-gain)[:3000]:
            if gain[j] <= 1e-9 * len(goal) or len(new) == most:
                break
            lengths = set(ways[allowed[j]].tolist()) - {0}
            if not lengths & used:
                used |= lengths
                new.append(allowed[j])
        if not new:
            break
        more = common(active, np.array(new))
        gram = np.block([[gram, more], [more.T, common(np.array(new), np.array(new))]])
        active, x = np.concatenate([active, new]), np.concatenate([x, np.zeros(len(new))])
        while len(active):
            z = np.linalg.solve(gram + 1e-9 * np.eye(len(active)), goal[ways[active]].sum(axis=1))
            if (z > 0).all():
                x = z
                break
            bad = z <= 0
            step = min(1.0, float(np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-12))))
            x = x + step * (z - x)
            stay = x > 1e-9
            stay[np.flatnonzero(bad)[np.argmin(x[bad])]] = False
            active, x, gram = active[stay], x[stay], gram[np.ix_(stay, stay)]
    return dict(zip(best[1].tolist(), best[2].tolist()))


def best_fit(counts: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, in counts: (pattern, repeats)."""
    free: list[int] = []  # room in open sequences, ascending
    open_: dict[int, list[list]] = {}

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(free, room)
        open_[room].append([pattern, n])

    for length in range(sequence, 0, -1):
        n = int(counts[length]) if length < len(counts) else 0
        while n:
            i = bisect_left(free, length)
            if i == len(free):
                each = sequence // length
                if n >= each:
                    put(sequence - each * length, (length,) * each, n // each)
                if n % each:
                    put(sequence - n % each * length, (length,) * (n % each), 1)
                break
            room = free[i]
            pattern, have = open_[room].pop()
            if not open_[room]:
                del open_[room], free[i]
            used = min(n, have)
            if have > used:
                put(room, pattern, have - used)
            put(room - length, (*pattern, length), used)
            n -= used
    return [(p, n) for same in open_.values() for p, n in same]


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that together hold every piece of the histogram that is shorter than a sequence once, in the fewest sequences of those tried."""
    have = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    have[sequence] = 0
    ways = patterns(sequence)
    fitted = sorted(fit(have, ways).items(), key=lambda kv: -kv[1])
    return min((_laid_out(have, ways, fitted, share, sequence) for share in FITTED_SHARES), key=lambda tried: sum(n for _, n in tried))


def _laid_out(have: np.ndarray, ways: np.ndarray, fitted: list[tuple[int, float]], share: float, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    out, left = [], have.copy()
    for j, x in fitted:
        lengths = [int(v) for v in ways[j] if v]
        n = min(int(share * x), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append((tuple(sorted(lengths, reverse=True)), n))
    return out + best_fit(left, sequence)


def _slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per slot of a pattern, ordered: key (length, first rank), first sequence id, offset."""
    at: dict[int, int] = {}
    rows, base = [], 0
    for pattern, n in chosen:
        offset = 0
        for length in pattern:
            rows.append((length << 42 | at.get(length, 0), base, offset))
            at[length] = at.get(length, 0) + n
            offset += length
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END_ID, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, tokenizer, sequence, end, ranks).withColumn("tie", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    whole = cut.filter(F.col("length") == sequence).drop("tie").select("*", (F.monotonically_increasing_id() + F.lit(WHOLE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    keys, bases, offsets = _slots(plan(histogram, sequence))
    parts = F.array(*[F.lit(max(1, histogram.get(length, 0) // PART_ROWS)) for length in range(1, sequence + 1)])
    placed = cut.filter(F.col("length") < sequence).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "tie"), F.element_at(parts, F.col("length").cast("int"))))
    counts = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "tie")
    ranked = placed.join(starts, ["length", "part"]).select(*whole.columns[:-2], (F.col("before") + F.row_number().over(inside) - 1).alias("rank"))

    def rows(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = np.searchsorted(keys, length << 42 | rank, side="right") - 1
            sequence_id = bases[slot] + rank - (keys[slot] & ((1 << 42) - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence_id, pa.int64()), pa.array(offsets[slot], pa.int64())], names=[*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(rows, PIECES + ", sequence_id long, offset long").union(whole)
