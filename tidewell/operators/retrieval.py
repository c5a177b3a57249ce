"""Dense retrieval, its evaluation, and what fits an observation."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import vector
from tidewell.functions.text import CAP_BYTES

K_DEFAULT, K_MOST, AGENT_K = 10, 50, 5
#: A query set of up to so many rows is broadcast; a larger one is cut into blocks by the caller.
QUERIES_MOST = 20_000
#: Queries that a batch of chunks is multiplied with at a time.
QUERY_BATCH = 256


def clamp_k(k: int | None, default: int = K_DEFAULT) -> int:
    return default if not k or k < 1 else min(k, K_MOST)


def knn(chunks: DataFrame, query: list[float], k: int | None = None, key: str = "chunk_id", embedding: str = "embedding", **equal) -> DataFrame:
    """The k chunks nearest to one vector, exactly; filters hold before ranking and a null never matches."""
    for column, value in equal.items():
        if value not in (None, ""):
            chunks = chunks.filter(F.col(column) == value)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.withColumn("score", vector.search_score(embedding, q)).drop(embedding)
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(clamp_k(k))


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int | None = None, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest chunks of each query (query_id, query_vector): query_id, rank, key, score and the other columns.

    Vectors are brought to unit length once on either side. The query set goes to every task after a check of its
    size; a batch of chunks is multiplied with it there, and only its k best for each query leave the task. A chunk
    without a direction has no score and comes last, ties go to the smaller key.
    """
    asked = queries.select("query_id", vector.unit("query_vector").alias("q")).limit(QUERIES_MOST + 1).toArrow()
    n, most = asked.num_rows, clamp_k(k)
    if n > QUERIES_MOST:
        raise ValueError(f"{queries.count()} queries; at most {QUERIES_MOST} at once")
    ids, q = asked.column("query_id").combine_chunks(), _rows_of(asked.column("q").combine_chunks())
    others = [c for c in chunks.columns if c != embedding]

    def best(batches):
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            v = _rows_of(batch.column("_v"))
            d = max(v.shape[1], q.shape[1])
            v, u = (np.pad(x, ((0, 0), (0, d - x.shape[1])), constant_values=np.nan) for x in (v, q))
            keys = batch.column(key)
            place = np.empty(len(v), np.int64)
            place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(v))
            for at in range(0, n, QUERY_BATCH):
                cost = -(1 + u[at : at + QUERY_BATCH] @ v.T) / 2
                cost[np.isnan(cost)] = np.inf
                last = np.partition(cost, min(most, len(v)) - 1, axis=1)[:, min(most, len(v)) - 1]
                who, which = np.nonzero(cost <= last[:, None])
                order = np.lexsort((place[which], cost[who, which], who))
                who, which = who[order], which[order]
                first = np.searchsorted(who, who)
                kept = np.arange(len(who)) - first < most
                who, which = who[kept], which[kept]
                score = -cost[who, which]
                columns = [batch.column(c).take(pa.array(which)) for c in others]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who + at)), *columns, pa.array(score, mask=np.isinf(score))], names=["query_id", *others, "score"])

    kinds = dict(chunks.dtypes)
    schema = ", ".join([f"query_id {dict(queries.dtypes)['query_id']}", *[f"`{c}` {kinds[c]}" for c in others], "score double"])
    scored = chunks.select(*others, vector.unit(embedding).alias("_v")).mapInArrow(best, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _rows_of(column: pa.Array) -> np.ndarray:
    """Vectors as rows; what is missing in one, or all of a null one, isn't a number."""
    sizes = np.diff(column.offsets.to_numpy())
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    out = np.full((len(column), int(sizes.max(initial=1))), np.nan)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def first_hits(queries: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """Each query's rank of its first relevant result, 0 if there is none.

    labels (query_id, source, must_contain): a result matches with the same source and, if it is given, a case-sensitive substring.
    """
    need = F.coalesce(F.col("must_contain"), F.lit(""))
    hits = results.join(labels, ["query_id", "source"]).filter((need == "") | F.contains(F.col("content"), need))
    ranks = hits.groupBy("query_id").agg(F.min("rank").alias("_rank"))
    return queries.select("query_id").join(ranks, "query_id", "left").select("query_id", F.coalesce("_rank", F.lit(0)).alias("hit_rank"))


def hit_rate(ranks: DataFrame, *ks: int) -> DataFrame:
    """k, hit_rate: the share of queries with a hit at rank k or better; 0 for no queries."""
    rates = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.avg(F.when(F.col("hit_rank").between(1, k), 1.0).otherwise(0.0)), F.lit(0.0)).alias("hit_rate")) for k in ks])
    return ranks.agg(rates.alias("x")).select(F.inline("x"))


def pair_embeddings(inputs: DataFrame, answers: DataFrame, dimension: int) -> DataFrame:
    """inputs (index and more) with the embedding that the answer (index, embedding) of the same index holds.

    Answers may come in any order; raises unless there is just one for each index, all of the right size.
    """
    wanted = inputs.agg(F.count("*").alias("n"), F.max("index").alias("last")).first()
    got = answers.agg(
        F.count("*").alias("n"), F.count_distinct("index").alias("distinct"), F.coalesce(F.count_if((F.col("index") < 0) | (F.col("index") > F.lit(wanted["last"])) | F.col("index").isNull()), F.lit(0)).alias("outside"),
        F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).alias("wrong"),
    ).first()
    problems = [f"{got['n']} answers for {wanted['n']} inputs"] if got["n"] != wanted["n"] else []
    problems += [f"{got[k]} {text}" for k, text in (("outside", "indices out of range"), ("wrong", f"vectors that haven't {dimension} components")) if got[k]]
    problems += ["an index comes twice"] if got["distinct"] < got["n"] - got["outside"] else []
    if problems:
        raise ValueError("; ".join(problems))
    return inputs.join(answers.select("index", "embedding"), "index")


def unresolved_labels(labels: DataFrame, corpus: DataFrame, key: str | None = None) -> DataFrame:
    """Labels (source, must_contain) that no chunk of the corpus (source, content; a unique key, else the content itself) can satisfy; without must_contain any chunk of the source does."""
    named = labels.withColumn("_need", F.coalesce("must_contain", F.lit("")))
    phrases = named.filter("_need <> ''").select("source", F.col("_need").alias("phrase")).distinct()
    chunks = corpus.select(*([key] if key else []), "source", F.col("content").alias("text"))
    found = containing(chunks, phrases, key or "text", within="source").select("source", F.col("phrase").alias("_need"))
    every = corpus.select("source", F.lit("").alias("_need")).unionByName(found).distinct()
    return named.join(every, ["source", "_need"], "left_anti").select(*labels.columns)


#: So many phrases of one or two words are compared with every text.
SHORT_PHRASES = 1_000
#: Keys of up to so many phrases go to every task.
BROADCAST_PHRASES = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_keys(words: list[str], sizes: list[int], within: str | None = None) -> dict[int, np.ndarray]:
    """For each size, a 64-bit number for each run of so many words; equal runs (within equal things) have equal numbers."""
    each = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) + np.uint64(1)
    salt, out = np.uint64(0 if within is None else zlib.crc32(within.encode("utf-8", "surrogatepass")) + 1), {}
    for m in sizes:
        n = max(0, len(words) - m + 1)
        h = np.full(n, salt * np.uint64(31) + np.uint64(m), np.uint64)
        for k in range(m):
            h = (h ^ (h >> np.uint64(29))) * _BASE + each[k : k + n]
        out[m] = h.view(np.int64)
    return out


def containing(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "phrase", words: int = 5, within: str | None = None) -> DataFrame:
    """(key, the phrases' columns) of each pair of a text, known by a unique key, and a phrase in it, without comparing all pairs.

    The words after a phrase's first, which any text that contains it has between the same spaces,
    are the join key: `words` of them, or as many as there are before the last. Tasks number the runs
    of words of their texts (in Arrow batches) and keep those that are some phrase's, or all where phrases are over BROADCAST_PHRASES; the
    pairs that a join gives fetch their text, and `contains` decides. Phrases of two words or fewer have no such key: they
    are compared with every text, and refused beyond SHORT_PHRASES. With within, a column of both, text and phrase must agree in it.
    """
    size = F.least(F.size(F.split(phrase, " ")) - 2, F.lit(words))
    keyed = phrases.filter(F.col(phrase).isNotNull()).withColumn("_size", F.greatest(size, F.lit(0)))
    sizes = {r["_size"]: r["n"] for r in keyed.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    some, names = sorted(m for m in sizes if m > 0), phrases.columns
    same = [] if within is None else [within]
    context = (lambda batch: batch.column("_within").to_pylist()) if within else (lambda batch: [None] * batch.num_rows)

    def phrase_keys(batches):
        for batch in batches:
            inner = [(t.split(" ")[1 : 1 + m], m, w) for t, m, w in zip(batch.column("_phrase").to_pylist(), batch.column("_size").to_pylist(), context(batch))]
            numbers = pa.array([int(_gram_keys(x, [m], w)[m][0]) for x, m, w in inner], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), numbers], names=[*names, "_key"])

    out = None
    if some:
        extra = [F.col(phrase).alias("_phrase"), "_size", *[F.col(within).cast("string").alias("_within") for _ in same]]
        long = keyed.filter("_size > 0").select(*phrases.columns, *extra)
        kinds = ", ".join(f"`{c}` {k}" for c, k in phrases.dtypes)
        side = long.filter(F.col(within).isNotNull()) if within else long
        side = side.mapInArrow(phrase_keys, f"{kinds}, _key long")
        few = sum(sizes[m] for m in some) <= BROADCAST_PHRASES
        wanted = np.unique(np.array([r[0] for r in side.select("_key").distinct().collect()], np.int64)) if few else None

        def text_keys(batches):
            for batch in batches:
                at, found = [], []
                for k, (t, w) in enumerate(zip(batch.column("_text").to_pylist(), context(batch))):
                    if t is None or within and w is None:
                        continue
                    own = np.unique(np.concatenate(list(_gram_keys(t.split(" "), some, w).values())))
                    if wanted is not None:
                        own = own[np.isin(own, wanted)]
                    at += [k] * len(own)
                    found.append(own)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(np.concatenate(found))], names=[key, "_key"])

        own = texts.select(key, F.col(text).alias("_text"), *[F.col(within).cast("string").alias("_within") for _ in same])
        placed = own.mapInArrow(text_keys, f"`{key}` {dict(texts.dtypes)[key]}, _key long")
        met = placed.join(F.broadcast(side) if few else side, "_key").drop("_key")
        full = texts.select(key, F.col(text).alias("_text"), *[F.col(within).alias("_in") for _ in same])
        holds = F.contains(F.col("_text"), F.col(phrase)) & (F.col("_in") == F.col(within) if within else F.lit(True))
        out = met.join(full, key).filter(holds).select(key, *phrases.columns)
    if sizes.get(0):
        if sizes[0] > SHORT_PHRASES:
            raise ValueError(f"{sizes[0]} phrases of two words or fewer; at most {SHORT_PHRASES}")
        short = F.broadcast(keyed.filter("_size = 0").drop("_size"))
        full = texts.select(key, F.col(text).alias("_text"), *[F.col(within).alias("_in") for _ in same])
        holds = F.contains(F.col("_text"), F.col(phrase)) & (F.col("_in") == F.col(within) if within else F.lit(True))
        more = full.join(short, holds).select(key, *phrases.columns)
        out = more if out is None else out.unionByName(more)
    return out if out is not None else texts.select(key).join(phrases, F.lit(False)).select(key, *phrases.columns)


def prefix_that_fits(hits: DataFrame, group: str, rank: str = "rank", size: str = "bytes", most: int = CAP_BYTES) -> DataFrame:
    """Per group, how many leading hits fit when a notice is added if any is left out: shown, total."""
    w = Window.partitionBy(group).orderBy(rank)
    # the notice is a fixed value
    notice = F.octet_length(F.format_string("\n\n(%d of %d hits shown; the rest did not fit)", F.col("_n"), F.col("total")))
    run = (
        hits.withColumn("_n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy(group)))
        .withColumn("_bytes", F.sum(F.col(size) + F.when(F.col("_n") > 1, 2).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    fits = F.col("_bytes") + F.when(F.col("_n") < F.col("total"), notice).otherwise(0) <= most
    return run.groupBy(group).agg(F.coalesce(F.max(F.when(fits, F.col("_n"))), F.lit(1)).cast("int").alias("shown"), F.max("total").alias("total"))
