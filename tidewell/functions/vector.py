"""Vector expressions over ARRAY<FLOAT>, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that an embedder gets in one call.
EMBED_BATCH = 32


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(x, use: Callable[[Column], Column]) -> Column:
    """use(x), x being computed once a row however often use names it; inside a lambda a plain column would be computed for each element."""
    return F.get(F.transform(F.array(_c(x)), use), F.lit(0))


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """The vector at unit length, as doubles; null for a zero vector."""
    return _once(a, lambda v: _once(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def search_score(a, b) -> Column:
    """Cosine moved to [0, 1]."""
    return (1 + cosine(a, b)) / 2


def fake_embedding(text, dimension: int) -> Column:
    """A unit vector that depends on the text alone: normal numbers from digests of the text's md5 and their place. For tests and trials."""
    places = F.sequence(F.lit(1), F.lit(dimension))
    uniform = lambda d, at: (F.conv(F.substring(d, at, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
    digests = _once(F.md5(_c(text)), lambda own: F.transform(places, lambda i: F.md5(F.concat(own, F.lit(":"), i.cast("string")))))
    normal = F.transform(digests, lambda d: F.sqrt(-2 * F.log(uniform(d, 1))) * F.cos(2 * F.pi() * uniform(d, 13)))
    return unit(normal).cast("array<float>")


def paired(answers: list[tuple[int, list[float]]], wanted: int, dimension: int) -> list[list[float]]:
    """Vectors in the order of their inputs, from (index, vector) in any order; raises where one is missing, double or of another length."""
    out: list = [None] * wanted
    for index, vector in answers:
        if not 0 <= index < wanted:
            raise ValueError(f"embedding index {index} is outside 0 to {wanted - 1}")
        if out[index] is not None:
            raise ValueError(f"embedding index {index} comes twice")
        if len(vector) != dimension:
            raise ValueError(f"embedding {index} has {len(vector)} components; {dimension} are wanted")
        out[index] = vector
    if len(answers) != wanted:
        raise ValueError(f"{len(answers)} embeddings for {wanted} texts")
    return out


def batched(call: Callable[[list[str]], list[tuple[int, list[float]]]], dimension: int, size: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """An embedder that calls `call` with `size` texts of a partition at a time, in order; its answers are (index, vector) in any order.

    A null text isn't sent and has a null vector.
    """

    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        waiting: list = []

        def flush(n: int) -> pd.Series:
            own, waiting[:] = waiting[:n], waiting[n:]
            texts = [t for t in own if t is not None]
            vectors = iter([v for at in range(0, len(texts), size) for v in paired(call(texts[at : at + size]), len(texts[at : at + size]), dimension)])
            return pd.Series([None if t is None else next(vectors) for t in own], dtype=object)

        for batch in batches:
            waiting += batch.tolist()
            # only whole calls' worth leaves before the end
            sent, n = 0, 0
            for i, t in enumerate(waiting):
                sent += t is not None
                if t is not None and sent % size == 0:
                    n = i + 1
            if n:
                yield flush(n)
        if waiting:
            yield flush(len(waiting))

    return embedded
