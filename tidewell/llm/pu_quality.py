"""A quality classifier learnt from positives and unlabelled text by non-negative unbiased risk.

A text becomes a row of numbers: how often each class of character follows each other one, and
shares of words and lines. Trusted positives are the labelled good texts; all texts that may be
learnt from stand for the unlabelled web, whatever their label. With the prior p of good texts and the logistic
loss, p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]) is the risk of a classifier that sees no bad
example. Newton steps lower it; where the part that must not be negative is, a step raises that part
alone instead, as it then measures only how closely the positives are learnt by heart.

The prior is estimated first: a classifier of positives against unlabelled texts is learnt on one
part of the rows; on the other part the share of unlabelled texts over a score, divided by the share
of positives over it, is least (but for a margin of error) where only good texts are left, and that
least value is the prior.

Every step is a job over all rows; tasks give sums of fixed size (COLUMNS squared), which are
folded in FOLDS tasks before the driver gets them. Nothing is sampled.

Defined results: a null text counts as empty, an empty text is scored like any other; a null doc_id
counts as the empty string where rows are parted (so it is held out) and has no label; rows that
share a doc_id share its label; labels that differ for one doc_id, and null ones, don't make it
trusted; without a trusted positive every score is PRIOR_UNKNOWN; a text of any length is read whole;
repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import saved

#: Rows are parted by crc32 of doc_id modulo PARTS; part 0 is held out, part PRIOR_PART estimates the prior.
PARTS, PRIOR_PART = 5, 4
THRESHOLD = 0.3
PRIOR_UNKNOWN = 0.5
RIDGE = 1e-3
STEPS, CLOSE = 10, 1e-5
#: A column that hardly varies isn't spread out further than this, and no scaled value is larger than WIDEST.
LEAST_SPREAD, WIDEST = 0.02, 6.0
#: Share of a step that raises the negative part of the risk, and how often a step that doesn't lower the risk is halved.
RAISE, HALVINGS = 0.1, 4
#: The prior's estimate: bins of the score, from -REACH to REACH, and the chance that its margin fails.
BINS, REACH, CHANCE = 2000, 20.0, 0.1
FOLDS = 16
#: Characters of a text that are looked at together.
STRETCH = 1 << 20

#: Classes of characters: lower case, upper case, digit, space, line end, mark of a sentence, other ASCII, any other.
CLASSES = 8
_CLASS = np.full(128, 6, np.uint8)
for _i, _of in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:'\"-()?")):
    _CLASS[[ord(c) for c in _of]] = _i
STATISTICS = (
    "log words", "log characters", "mean word", "long words", "distinct words", "most frequent word", "repeated neighbours", "repeated triples",
    "repeated lines", "words of capitals", "words without letters", "words ending in symbols", "log words a line", "any text",
)
COLUMNS = CLASSES * CLASSES + len(STATISTICS)


def class_pairs(text: str) -> np.ndarray:
    """Square roots of the shares of pairs of neighbouring characters, by their classes."""
    counts, last = np.zeros(CLASSES * CLASSES), None
    for at in range(0, len(text), STRETCH):
        code = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(code < 128, _CLASS[np.minimum(code, 127)], np.uint8(7)).astype(np.int64)
        if last is not None:
            counts[last * CLASSES + kind[0]] += 1
        counts += np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
        last = int(kind[-1])
    return np.sqrt(counts / max(1.0, counts.sum()))


def statistics(text: str) -> list[float]:
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    seen, triples = Counter(words), Counter(zip(words, words[1:], words[2:]))
    return [
        math.log1p(n) / 10, math.log1p(len(text)) / 12, min(1.0, sum(map(len, words)) / n / 20), sum(len(w) > 20 for w in words) / n,
        len(seen) / n, max(seen.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(k for k in triples.values() if k > 1) / n,
        1 - len(set(lines)) / len(lines), sum(w.isupper() and len(w) > 1 for w in words) / n, sum(not any(c.isalpha() for c in w) for w in words) / n,
        sum(w[-1] in "#*$%&|<>!~=+_@^" for w in words) / n, math.log1p(n / len(lines)) / 10, 1.0,
    ]


def features(text: str | None) -> np.ndarray:
    return np.concatenate([class_pairs(text or ""), statistics(text or "")]).astype(np.float32)


def part_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % PARTS


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, x), x the row of numbers as packed floats."""

    def rows(batches):
        for batch in batches:
            packed = pa.array([features(x).tobytes() for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), packed], names=["doc_id", "part", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part_of(F.col("doc_id")).cast("int").alias("part"), "text")
    return own.mapInArrow(rows, "doc_id long, part int, x binary")


def trusted(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, trusted) of the doc_ids whose labels are all 1, from rows that aren't held out."""
    own = labels.filter(F.col("doc_id").isNotNull() & (part_of(F.col("doc_id")) != 0))
    all_good = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col(label) == 1, F.lit(False))).alias("trusted"))
    return all_good.filter("trusted")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), COLUMNS).astype(np.float64)


def _softplus(f: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, f)


def _summed(table: DataFrame, sums) -> np.ndarray:
    """The sum over all rows of sums(x, trusted), an array of fixed length."""

    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = sums(_matrix(batch.column("x")), batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def fold(batches):
        total = [np.sum([np.frombuffer(s) for s in batch.column("s").to_pylist()], axis=0) for batch in batches if batch.num_rows]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(total, axis=0).tobytes()], pa.binary())], names=["s"])

    found = table.select("x", "trusted").mapInArrow(part, "s binary").repartition(FOLDS).mapInArrow(fold, "s binary").collect()
    return np.sum([np.frombuffer(bytes(r["s"])) for r in found], axis=0)


@dataclass
class Scale:
    mean: np.ndarray
    spread: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Columns of mean 0 and deviation 1 among the unlabelled, and one of ones."""
        return np.concatenate([np.clip((x - self.mean) / self.spread, -WIDEST, WIDEST), np.ones((len(x), 1))], axis=1)


@dataclass
class Classifier:
    scale: Scale
    weights: np.ndarray
    prior: float
    risks: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scale(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def _scale(table: DataFrame) -> tuple[Scale, int, int]:
    """The columns' scale, and the numbers of unlabelled and of positive rows."""
    s = _summed(table, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    mean = s[2 : 2 + COLUMNS] / s[0]
    spread = np.sqrt(np.maximum(s[2 + COLUMNS :] / s[0] - mean * mean, 0))
    return Scale(mean, np.maximum(spread, LEAST_SPREAD)), int(s[0]), int(s[1])


def _parts_of_risk(table: DataFrame, scale: Scale, w: np.ndarray) -> dict[str, np.ndarray]:
    """Means that the risk at w and its steps are made of: losses, their slopes and the curvature."""
    d = COLUMNS + 1

    def sums(x, p):
        z = scale(x)
        f = z @ w
        g = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        curve = (z * (g * (1 - g))[:, None]).T @ z
        own, fp, gp = z[p], f[p], g[p]
        ends = [len(z), p.sum(), _softplus(f).sum(), _softplus(-fp).sum(), _softplus(fp).sum()]
        return np.concatenate([ends, z.T @ g, own.T @ (gp - 1), own.T @ gp, curve.ravel()])

    s = _summed(table, sums)
    nu, n = s[0], max(1.0, s[1])
    return {
        "u_neg": s[2] / nu, "p_pos": s[3] / n, "p_neg": s[4] / n,
        "d_u_neg": s[5 : 5 + d] / nu, "d_p_pos": s[5 + d : 5 + 2 * d] / n, "d_p_neg": s[5 + 2 * d : 5 + 3 * d] / n,
        "curve": s[5 + 3 * d :].reshape(d, d) / nu,
    }


def non_negative_risk(m: dict, prior: float) -> float:
    return float(prior * m["p_pos"] + max(0.0, m["u_neg"] - prior * m["p_neg"]))


def minimise(table: DataFrame, scale: Scale, prior: float) -> tuple[np.ndarray, list[float]]:
    """The weights of least non-negative risk on table among the steps', and the risk after each step."""
    ridge = np.full(COLUMNS + 1, RIDGE)
    ridge[-1] = 0.0
    w = np.zeros(COLUMNS + 1)
    m = _parts_of_risk(table, scale, w)
    cost = non_negative_risk(m, prior) + 0.5 * ridge @ (w * w)
    risks, best = [cost], (cost, w)
    for _ in range(STEPS):
        rest = m["d_u_neg"] - prior * m["d_p_neg"]
        negative = m["u_neg"] < prior * m["p_neg"]
        slope = -RAISE * rest if negative else prior * m["d_p_pos"] + rest + ridge * w
        step = np.linalg.solve(m["curve"] + np.diag(ridge + 1e-6), slope)
        for _ in range(HALVINGS + 1):
            m_next = _parts_of_risk(table, scale, w - step)
            next_cost = non_negative_risk(m_next, prior) + 0.5 * ridge @ ((w - step) ** 2)
            if negative or next_cost <= cost:
                break
            step = step / 2
        if not negative and next_cost > cost:
            break
        w, m, gain, cost = w - step, m_next, cost - next_cost, next_cost
        risks.append(float(cost))
        best = min(best, (cost, w), key=lambda x: x[0])
        if not negative and gain < CLOSE:
            break
    return best[1], risks


def discriminate(table: DataFrame, scale: Scale) -> np.ndarray:
    """Weights of a logistic classifier of positives against unlabelled rows, both classes with weight one half."""
    ridge = np.full(COLUMNS + 1, RIDGE)
    ridge[-1] = 0.0
    w, last = np.zeros(COLUMNS + 1), math.inf
    for _ in range(STEPS):
        m = _parts_of_risk(table, scale, w)
        cost = m["u_neg"] + m["p_pos"]
        if last - cost < 10 * CLOSE:
            break
        last = cost
        w = w - np.linalg.solve(2 * m["curve"] + np.diag(ridge + 1e-6), m["d_u_neg"] + m["d_p_pos"] + ridge * w)
    return w


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from counts of scores in bins: least share of unlabelled over a score / share of positives over it, with margins."""
    p, u = np.cumsum(positive[::-1]), np.cumsum(unlabelled[::-1])
    margin = math.sqrt(math.log(4 / CHANCE) / 2 / u[-1]) + math.sqrt(math.log(4 / CHANCE) / 2 / p[-1])
    qp, qu = p[p > 0] / p[-1], u[p > 0] / u[-1]
    return float(min(1.0, (qu / qp)[np.argmin((qu + margin) / qp)]))


def estimate_prior(table: DataFrame, scale: Scale) -> float:
    """The share of good texts among the unlabelled; 1 part of the rows is kept for the estimate if it has positives."""
    kept = table.filter(F.col("part") == PRIOR_PART)
    w = discriminate(table.filter(F.col("part") != PRIOR_PART), scale)

    def sums(x, p):
        at = np.clip((scale(x) @ w + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(at[p], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(np.float64)

    s = _summed(kept, sums)
    if not np.size(s) or not s[:BINS].any():
        s = _summed(table, sums)
    return least_ratio(s[:BINS], s[BINS:])


def fit(table: DataFrame) -> Classifier | None:
    """The classifier learnt from table (part, x, trusted), the rows of part 0 left out; None without a positive."""
    own = table.filter(F.col("part") != 0)
    if own.filter("trusted").isEmpty():
        return None
    scale, _, _ = _scale(own)
    prior = estimate_prior(own, scale)
    weights, risks = minimise(own, scale, prior)
    return Classifier(scale, weights, prior, risks)


def prepared(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, x, trusted), written out."""
    joined = featured(docs).join(trusted(labels), "doc_id", "left")
    return saved(joined.select("doc_id", "part", "x", F.coalesce("trusted", F.lit(False)).alias("trusted")), "quality")


def scored(table: DataFrame, model: Classifier | None) -> DataFrame:
    def rows(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            score = model.score(x) if model else np.full(len(x), PRIOR_UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(score)], names=["doc_id", "part", "score"])

    out = table.select("doc_id", "part", "x").mapInArrow(rows, "doc_id long, part int, score double")
    return out.select("doc_id", (F.col("part") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); labels: (doc_id, quality)."""
    table = prepared(docs, labels)
    return scored(table, fit(table))
