"""Nearest chunks of many queries and phrases in texts, on odd rows and against brute force."""

import numpy as np
import pytest

from tidewell.operators import retrieval


def brute(chunks, queries, k):
    out = []
    for q, u in queries:
        scored = []
        for key, v, note in chunks:
            ok = u is not None and v is not None and len(u) == len(v) and None not in v and any(u) and any(v)
            s = (1 + np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)) / 2 if ok else None
            scored.append((s is None, 0 if s is None else -round(float(s), 9), key is not None, key or 0, note, s))
        out += [(q, n + 1, x[3] if x[2] else None, x[4], None if x[5] is None else round(float(x[5]), 6)) for n, x in enumerate(sorted(scored, key=lambda x: x[:4])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,batch", [(3, 256), (50, 2)])
def test_nearest_of_many(spark, monkeypatch, k, batch):
    monkeypatch.setattr(retrieval, "QUERY_BATCH", batch)
    rng = np.random.default_rng(k)
    chunks = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), f"n{i}") for i in range(40)]  # many ties
    chunks += [(50, None, "null"), (51, [0.0] * 4, "zero"), (52, [1.0, None, 0.0, 0.0], "hole"), (53, [1.0, 2.0], "short"), (None, [1.0, 0.0, 0.0, 0.0], "no key"), (3, [2.0, 2.0, 2.0, 2.0], "again")]
    queries = [(f"q{i}", rng.normal(size=4).round(1).tolist()) for i in range(5)] + [("none", None), ("zero", [0.0] * 4)]
    c = spark.createDataFrame(chunks, "chunk_id LONG, embedding ARRAY<DOUBLE>, note STRING").repartition(3)
    q = spark.createDataFrame(queries, "query_id STRING, query_vector ARRAY<DOUBLE>")
    got = [(r["query_id"], r["rank"], r["chunk_id"], r["note"], None if r["score"] is None else round(r["score"], 6)) for r in retrieval.knn_batch(c, q, k).collect()]
    want = brute(chunks, queries, k)
    assert sorted((x[:3] + x[4:] for x in got), key=repr) == sorted((x[:3] + x[4:] for x in want), key=repr)
    assert retrieval.knn_batch(c.limit(0), q, 3).collect() == [] and retrieval.knn_batch(c, q.limit(0), 3).collect() == []


def test_too_many_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_MOST", 2)
    q = spark.createDataFrame([(i, [1.0]) for i in range(3)], "query_id INT, query_vector ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="3 queries"):
        retrieval.knn_batch(spark.createDataFrame([(1, [1.0])], "chunk_id INT, embedding ARRAY<DOUBLE>"), q, 3)


@pytest.mark.parametrize("most", [200_000, 0])
def test_phrases_within_a_source(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "BROADCAST_PHRASES", most)
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(list("abc"), 30)), ["s1", "s2", None][i % 3]) for i in range(30)] + [(30, None, "s1"), (31, "", "s1"), (32, "a  b c", "s2")]
    phrases = [(i, " ".join(rng.choice(list("abc"), int(rng.integers(1, 9)))), ["s1", "s2", None][i % 3]) for i in range(40)] + [(40, None, "s1"), (41, "a  b c", "s2")]
    t = spark.createDataFrame(texts, "doc_id INT, text STRING, source STRING")
    p = spark.createDataFrame(phrases, "item_id INT, phrase STRING, source STRING")
    pairs = [(i, d, s == r and s is not None) for i, x, s in phrases for d, y, r in texts if x is not None and y is not None and x in y]
    got = retrieval.containing(t, p, "doc_id", within="source").collect()
    assert sorted((r["item_id"], r["doc_id"]) for r in got) == sorted((i, d) for i, d, same in pairs if same) and got
    free = retrieval.containing(t, p.drop("source"), "doc_id").collect()
    assert sorted((r["item_id"], r["doc_id"]) for r in free) == sorted((i, d) for i, d, _ in pairs)


def test_labels_within_their_source(spark):
    corpus = spark.createDataFrame([(1, "a", "the pool was full of waiting calls"), (2, "b", None), (3, "c", "x")], "chunk_id INT, source STRING, content STRING")
    labels = spark.createDataFrame([(1, "a", "was full of waiting"), (2, "c", "was full of waiting"), (3, "a", ""), (4, "d", None), (5, "b", None), (6, None, "x"), (7, "c", "x"), (8, "a", "the pool is full")], "query_id INT, source STRING, must_contain STRING")
    for key in (None, "chunk_id"):
        assert sorted(r["query_id"] for r in retrieval.unresolved_labels(labels, corpus, key).collect()) == [2, 4, 6, 8]
