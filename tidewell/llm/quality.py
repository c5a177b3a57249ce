"""Quality rules: base counts of words and lines, and compression bands.

A text's zstandard ratio (compressed by raw bytes), over the whole text and over fixed chunks, must
lie in a band that depends on its length: repetitive text falls below, incompressible text above.
A chunk that is shorter than the others, the last one or the only one, has the band of its length.

Defined results: a null or empty text has all counts zero and fails the base rules; a text of any
length is judged whole; repeated rows are judged alike, each in its own row; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the ratio for texts of up to so many bytes: (bytes, lowest, highest).
BANDS = ((99, 0.0, 99.0), (299, 0.40, 1.20), (999, 0.30, 0.90), (3_999, 0.30, 0.74), (15_999, 0.28, 0.70), (1 << 62, 0.25, 0.70))
CHUNK_BYTES = 4096
#: Chunks of CHUNK_BYTES have a band of their own; chunks with so large a share of the bytes may lie outside.
CHUNK_BAND = (0.15, 0.72)
CHUNK_SHARE = 0.25
LEVEL = 3
MIN_WORDS = 50
#: Fixed values.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated, n = 0, len(words)
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = -1
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 2 - max(covered, i - 1)
                    covered = i + 2
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def band(n: int) -> tuple[float, float]:
    """The limits of the ratio of a text of n bytes."""
    return next((low, high) for most, low, high in BANDS if n <= most)


def ratios(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """The whole text's ratio, its number of chunks, how many of them lie outside their bands, and the bytes of these."""
    if not data:
        return 0.0, 0, 0, 0
    whole = len(compressor.compress(data)) / len(data)
    n = bad = outside = 0
    for at in range(0, len(data), CHUNK_BYTES):
        chunk = data[at : at + CHUNK_BYTES]
        low, high = CHUNK_BAND if len(chunk) == CHUNK_BYTES else band(len(chunk))
        n += 1
        if not low <= (whole if len(chunk) == len(data) else len(compressor.compress(chunk)) / len(chunk)) <= high:
            bad, outside = bad + 1, outside + len(chunk)
    return whole, n, bad, outside


def judge(text: str, compressor: zstandard.ZstdCompressor) -> tuple:
    n, chars, symbols, dup_lines, repeated = base_counts(text)
    data = text.encode("utf-8", "surrogatepass")
    ratio, chunks, bad, outside = ratios(data, compressor)
    failed = n < MIN_WORDS or 100 * repeated > 50 * n
    low, high = band(len(data))
    return n, chars, symbols, dup_lines, repeated, failed, not failed and low <= ratio <= high and outside <= CHUNK_SHARE * len(data), ratio, chunks, bad


def assess(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), with its counts and the verdict."""

    def rows(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = list(zip(*(judge(x or "", compressor) for x in batch.column("text").to_pylist())))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], names=names)

    names = [x.split()[0] for x in SCHEMA.split(",")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text passes, with the columns they came with."""
    columns = docs.columns

    def rows(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            good = [judge(x or "", compressor)[6] for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.select(*columns).mapInArrow(rows, docs.schema)
