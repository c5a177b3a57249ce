"""Vector code compression: product codes whose codebooks are kept up to date by changes alone.

A vector becomes whole numbers and is cut into PARTS equal parts; each part position has a codebook
of ENTRIES entries, and a part's code is its nearest entry. The codebooks come from Lloyd's rounds.
A round writes each row with its new codes and, beside them, the codes it had before; only parts
whose code changed are summed, with plus at the new entry and minus at the old one, per task, and
only these sums are shuffled. They are added to running sums and counts (whole numbers, so nothing
drifts), from which the entries follow. A round without changes is the last, as all later ones
would repeat it.

The driver holds the codebooks and the running sums: PARTS x ENTRIES rows of a part's length.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped;
vectors shorter than the longest one, or than a multiple of PARTS, count as filled with zeros; a row
without an id or a label is coded like any other, and starts a codebook only after the rows with
ids; repeated rows are coded one by one, each counts; rows that share an id start codebooks in the
order of their vectors; with fewer rows than ENTRIES there are as many entries as rows; a vector
that has no components has error 0; components beyond LARGEST in size are refused (sums of squares
must fit a long); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest size of a component, scaled.
LARGEST = 1 << 26
#: Doubles hold the distances exactly while parts are so short and components so small.
EXACT = 1 << 52
#: So many components are looked at together.
BATCH = 1 << 20
#: Sums of labels are broadcast up to so many labels, else joined by a shuffle.
BROADCAST_LABELS = 100_000
NO_CODE = 255


def whole(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, exactly for a scale that is a power of two; null for a vector that takes no part."""
    x = F.col(vector).cast("array<double>")
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))
    return F.when(usable, F.transform(x, lambda c: F.when(F.abs(c) * scale < float(1 << 62), F.floor(c * scale)).otherwise(F.lit(1 << 62))))


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, PARTS, width), shorter vectors filled with zeros."""
    column, rows = batch.column("v"), batch.num_rows
    out, sizes = np.zeros((rows, PARTS * width), np.int64), np.diff(column.offsets.to_numpy())
    out[np.arange(PARTS * width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(rows, PARTS, width)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PARTS)


def _slices(batches, width: int):
    step = max(1, BATCH // max(1, PARTS * width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (the lowest among ties) and its squared distance; books: (PARTS, entries, width)."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, parts.shape[2]) < EXACT else np.int64
    codes, errors = np.empty(parts.shape[:2], np.uint8), np.empty(parts.shape[:2], np.int64)
    for p in range(PARTS):
        x, c = np.ascontiguousarray(parts[:, p]).astype(kind), books[p].astype(kind)
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        codes[:, p] = far.argmin(axis=1)
        errors[:, p] = far[np.arange(len(x)), codes[:, p]]
    return codes, errors


class Codebooks:
    """Codebooks fitted to all rows of vectors, and the rows' codes. extra: columns that stay with the rows."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, scale: int = SCALE):
        self.spark = vectors.sparkSession
        rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), whole(vector, scale).alias("v")).filter(F.col("v").isNotNull())
        table = saved(rows.withColumn("code", F.lit(bytes([NO_CODE] * PARTS))).withColumn("before", F.col("code")), "codes")
        size = F.array_max(F.transform("v", F.abs))
        self.rows, longest, most = table.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
        if most > LARGEST:
            raise ValueError(f"components must not exceed {LARGEST / scale} in size")
        self.width = -(-longest // PARTS)
        self.books = self._first(table)
        self.sums, self.counts = np.zeros(self.books.shape, object), np.zeros(self.books.shape[:2], object)
        for _ in range(rounds if self.rows else 0):
            later = saved(self._assign(table), "codes")
            discard(table)
            table = later
            if not self._add(table):
                break
        self.table = table

    def _first(self, table: DataFrame) -> np.ndarray:
        chosen = table.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
        filled = np.zeros((len(chosen), PARTS * self.width), np.int64)
        for row, r in zip(filled, chosen):
            row[: len(r["v"])] = r["v"]
        return filled.reshape(len(chosen), PARTS, self.width).transpose(1, 0, 2)

    def _assign(self, table: DataFrame) -> DataFrame:
        """The rows with their codes by the present codebooks, and those they had before."""
        books, width, names = self.books, self.width, table.columns

        def rows(batches):
            for batch in _slices(batches, width):
                codes = pa.array([x.tobytes() for x in nearest(_parts(batch, width), books)[0]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), codes, batch.column("code")], names=names)

        return table.mapInArrow(rows, table.schema)

    def _add(self, table: DataFrame) -> int:
        """Add what the changed parts bring and take to the running sums; the number of sums that they touch."""
        width, entries = self.width, self.books.shape[1]

        def changes(batches):
            total = np.zeros((PARTS, entries, width + 1), np.int64)
            for batch in _slices(batches, width):
                parts, now, before = _parts(batch, width), _codes(batch.column("code")), _codes(batch.column("before"))
                for p in range(PARTS):
                    moved = np.flatnonzero(now[:, p] != before[:, p])
                    own = np.concatenate([parts[moved, p], np.ones((len(moved), 1), np.int64)], axis=1)
                    np.add.at(total[p], now[moved, p], own)
                    old = before[moved, p] != NO_CODE
                    np.subtract.at(total[p], before[moved, p][old], own[old])
            at = np.nonzero(total)
            if len(at[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in at), pa.array(total[at])], names=["part", "entry", "i", "change"])

        moved = table.filter(F.col("code") != F.col("before")).select("v", "code", "before")
        found = moved.mapInArrow(changes, "part int, entry int, i int, change long").groupBy("part", "entry", "i").agg(F.sum("change").alias("change")).collect()
        for r in found:
            if r["i"] == width:
                self.counts[r["part"], r["entry"]] += r["change"]
            else:
                self.sums[r["part"], r["entry"], r["i"]] += r["change"]
        if found:
            used = self.counts > 0
            books = self.books.copy()
            books[used] = (self.sums[used] // self.counts[used][:, None]).astype(np.int64)
            self.books = books
        return len(found)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """(vec_id, label, code, error), code in two hexadecimal digits a part."""
        books, width = self.books, self.width

        def rows(batches):
            for batch in _slices(batches, width):
                codes, errors = nearest(_parts(batch, width), books)
                text = pa.array([x.tobytes().hex() for x in codes], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

        kind = self.table.schema["label"].dataType.simpleString()
        return self.table.select("vec_id", "label", "v").mapInArrow(rows, f"vec_id long, label {kind}, code string, error long")

    def decoded(self, codes: DataFrame, code: str = "code", scale: int = SCALE) -> DataFrame:
        """codes with the column `vector`: the entries that the code names, at the scale of the input; null for a null code."""
        entries = F.lit([[[x / scale for x in entry] for entry in book] for book in self.books.tolist()]) if self.rows else None
        if entries is None:
            return codes.withColumn("vector", F.lit(None).cast("array<double>"))
        places = [F.element_at(entries, p + 1)[F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")] for p in range(PARTS)]
        return codes.withColumn("vector", F.concat(*places))


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the errors summed over equal labels (nulls together)."""
    sums = saved(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "codes")
    small = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return codes.join(small, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each row of vectors that takes part."""
    fitted = Codebooks(vectors)
    out = label_errors(saved(fitted.codes(), "codes"))
    discard(fitted.table)
    return out.select("vec_id", "code", "error", "label_error", F.lit(fitted.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    usable = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {usable})",
        f"parts AS (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS q(p))",
        f"b0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{k} AS (SELECT r, p, min({far} * {ENTRIES} + e) AS best FROM parts JOIN b{k} USING (p) GROUP BY r, p)")
        if k < ROUNDS:
            steps += [
                f"s{k} AS (SELECT p, best % {ENTRIES} AS e, i, sum(x[i]) AS s, count(*) AS n FROM parts JOIN a{k} USING (r, p), range(1, len(x) + 1) AS q(i) GROUP BY ALL)",
                f"m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY p, e)",
                f"b{k + 1} AS (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))",
            ]
    steps += [
        f"coded AS (SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"


ORACLE_SQL = _oracle()
