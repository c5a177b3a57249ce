"""Classifier, vector codes and spelling variants against brute force, SQL and held-out labels, and on odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, mixing, packing, pu_quality, quality, queries, sharding, simhash, spelling, suffix_dedup, vector_codes

SF = "/root/testdata/sf0.01"
ODD = "doc_id LONG, text STRING, lang STRING, source STRING, word STRING, n LONG, part INT, x BINARY, trusted BOOLEAN, score DOUBLE, m INT, low INT"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", "w", 9, 0, b"x", True, 0.5, 3, 1) for i, t in rows], ODD)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_spelling_variants"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*rel.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))


# 11


def junk(rng, kind):
    words = ["".join(rng.choice(list("aeioustrnl"), 5)) for _ in range(60)]
    return [" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60), " ".join(w + "%%%" for w in words)][kind]


def good(rng):
    return " ".join("".join(rng.choice(list("aeioustrnl"), rng.integers(2, 8))) for _ in range(60)).capitalize() + "."


@pytest.fixture(scope="module")
def marked(spark):
    """1,200 documents, a quarter bad; half of the good ones are labelled."""
    rng = np.random.default_rng(5)
    truth = [int(rng.random() > 0.25) for _ in range(1200)]
    docs = odd_docs(spark, [(i, good(rng) if q else junk(rng, i % 4)) for i, q in enumerate(truth)])
    labels = spark.createDataFrame([(i, q, "extra") for i, q in enumerate(truth) if i % 2], "doc_id LONG, quality INT, text STRING")
    return docs, labels, truth


def test_classifier_on_held_out_rows(marked):
    docs, labels, truth = marked
    model = pu_quality.fit(pu_quality.prepared(docs, labels))
    assert abs(model.prior - 0.75) < 0.06
    out = pu_quality.classify(docs, labels).collect()
    assert len(out) == 1200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_classifier_on_given_labels(spark):
    got = queries.op11_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.98 * len(got)
    assert sum(r["predicted"] == 0 for r in bad) >= 0.93 * len(bad)


def test_neither_held_out_nor_bad_labels_are_read(marked):
    docs, labels, _ = marked
    others = labels.withColumn("quality", F.when((pu_quality.part_of(F.col("doc_id")) == 0) | (F.col("quality") == 0), 0).otherwise(F.col("quality")))
    fewer = labels.filter((F.col("quality") == 1) & (pu_quality.part_of(F.col("doc_id")) != 0))
    a, b, c = (pu_quality.fit(pu_quality.prepared(docs, x)).weights for x in (labels, others, fewer))
    assert np.allclose(a, b) and np.allclose(a, c)


def test_risk_and_its_slope(spark, marked):
    docs, labels, _ = marked
    table = pu_quality.prepared(docs, labels).filter("part != 0")
    scale, n, positives = pu_quality._scale(table)
    rows = table.collect()
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows], np.float64)
    p = np.array([r["trusted"] for r in rows])
    assert (n, positives) == (len(x), p.sum())
    w = np.random.default_rng(0).normal(size=pu_quality.COLUMNS + 1) * 0.05
    z = scale(x)

    def risk(w):
        f = z @ w
        rest = np.logaddexp(0, f).mean() - 0.6 * np.logaddexp(0, f[p]).mean()
        return 0.6 * np.logaddexp(0, -f[p]).mean() + max(0.0, rest), rest

    m = pu_quality._parts_of_risk(table, scale, w)
    assert np.isclose(pu_quality.non_negative_risk(m, 0.6), risk(w)[0]) and risk(w)[1] > 0
    slope = 0.6 * m["d_p_pos"] + m["d_u_neg"] - 0.6 * m["d_p_neg"]
    for k in (0, 9, pu_quality.COLUMNS):
        step = np.eye(len(w))[k] * 1e-5
        assert np.isclose(slope[k], (risk(w + step)[0] - risk(w - step)[0]) / 2e-5, atol=1e-5)


def test_negative_part_is_raised(spark, marked):
    docs, labels, _ = marked
    table = pu_quality.prepared(docs, labels).filter("part != 0")
    scale, _, _ = pu_quality._scale(table)
    weights, risks = pu_quality.minimise(table, scale, 1.0)  # too large a prior: the unlabelled risk falls below the positives'
    assert np.isfinite(weights).all() and min(risks) >= 0 and any(b > a for a, b in zip(risks, risks[1:]))


def test_least_ratio():
    rng = np.random.default_rng(2)
    good_scores, bad_scores = rng.normal(3, 1, 40_000), rng.normal(-3, 1, 40_000)
    bins = lambda s: np.bincount(np.clip((s + 20) / 40 * 2000, 0, 1999).astype(int), minlength=2000)
    for prior in (0.2, 0.5, 0.9):
        n = int(20_000 * prior)
        mix = np.concatenate([good_scores[20_000 : 20_000 + n], bad_scores[: 20_000 - n]])
        assert abs(pu_quality.least_ratio(bins(good_scores[:20_000]), bins(mix)) - prior) < 0.03


def test_features_of_odd_texts():
    for text in (None, "", " \n\t", "a", "\x00", "\ud800x", "é" * 10, "x" * 3_000_000):
        x = pu_quality.features(text)
        assert x.shape == (pu_quality.COLUMNS,) and np.isfinite(x).all()
    assert (pu_quality.features(None) == pu_quality.features("")).all()
    long = "".join(random.Random(1).choices("aB3 .\n%é", k=5000))
    whole = pu_quality.class_pairs(long)
    pairs = Counter(zip(long, long[1:]))
    at = lambda c: "aB3 \n.%é".index(c)
    for (a, b), n in pairs.items():
        assert np.isclose(whole[at(a) * 8 + at(b)], (n / 4999) ** 0.5)


def test_class_pairs_across_stretches(monkeypatch):
    text = "".join(random.Random(3).choices("aB3 .\n%é", k=1000))
    whole = pu_quality.class_pairs(text)
    monkeypatch.setattr(pu_quality, "STRETCH", 7)
    assert np.allclose(whole, pu_quality.class_pairs(text))


def test_classifier_odd_rows(spark, marked):
    docs, labels, _ = marked
    odd = odd_docs(spark, [(None, None), (None, good(np.random.default_rng(1))), (5000, ""), (5000, ""), (5001, "Zeile\n" * 50_000)])
    marks = labels.union(spark.createDataFrame([(None, 1, "x"), (5000, 1, "x"), (5000, 0, "x"), (5001, None, "x")], labels.schema))
    out = pu_quality.classify(docs.union(odd), marks).filter("doc_id is null or doc_id >= 5000").collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] for r in out if r["doc_id"] is None)
    assert len({r["score"] for r in out if r["doc_id"] == 5000}) == 1
    assert pu_quality.classify(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in pu_quality.classify(odd, labels.limit(0)).collect()} == {pu_quality.PRIOR_UNKNOWN}
    assert pu_quality.trusted(marks).filter("doc_id = 5000 or doc_id is null").isEmpty()


# 12


def brute_codes(rows, rounds=6):
    """Lloyd's rounds from scratch: (vec_id, code, error) and the codebooks' digest."""
    rows = [(i, [int(np.floor(4096 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v in rows) // 8)
    parts = [[(v + [0] * (8 * width))[p * width : (p + 1) * width] for p in range(8)] for _, v in rows]
    books = [[parts[k][p] for k in range(min(16, len(rows)))] for p in range(8)]

    def best(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            chosen = [best(x[p], p)[1] for x in parts]
            books[p] = [[sum(x) // len(own) for x in zip(*own)] if (own := [x[p] for x, c in zip(parts, chosen) if c == e]) else books[p][e] for e in range(len(books[p]))]
    out = [(i, "".join(f"{best(x[p], p)[1]:02x}" for p in range(8)), sum(best(x[p], p)[0] for p in range(8))) for (i, _), x in zip(rows, parts)]
    return out, hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


VECTORS = "vec_id LONG, embedding ARRAY<DOUBLE>, label STRING, code STRING, before STRING, v INT, error INT"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", "b", 1, 2) for i, v, lab in rows], VECTORS)


@pytest.mark.parametrize("n,d", [(90, 16), (90, 21), (7, 8), (16, 8), (1, 3)])
def test_codes(spark, n, d):
    rng = np.random.default_rng(n + d)
    rows = [(int(i), rng.normal(0, 0.2, d).round(3).tolist(), ["a", "b", None][i % 3]) for i in rng.permutation(n)]
    rows += [(n, None, "a"), (n + 1, [float("nan")] * d, "a"), (n + 2, [float("inf")] + [0.0] * (d - 1), "a"), (n + 3, [None] * d, "a")]
    rows += [rows[0], rows[0], (None, rows[0][1], "b"), (n + 9, [0.5], None)]
    got = vector_codes.compress(vectors(spark, rows)).collect()
    want, digest = brute_codes([(i, v) for i, v, _ in rows])
    assert sorted(map(repr, ((r["vec_id"], r["code"], r["error"]) for r in got))) == sorted(map(repr, want))
    assert {r["codebooks_sha256"] for r in got} == {digest}
    by_label = Counter()
    errors = {(i, c): e for i, c, e in want}
    labels = {(r[0], tuple(r[1])): r[2] for r in rows if r[1]}
    assert len(errors) <= len(want) and len(labels) <= len(rows)
    fitted = vector_codes.label_errors(vector_codes.Codebooks(vectors(spark, rows)).codes()).collect()
    for r in fitted:
        by_label[r["label"]] += r["error"]
    assert all(r["label_error"] == by_label[r["label"]] for r in fitted)


def test_codes_decode(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 16).tolist(), "a") for i in range(40)]
    fitted = vector_codes.Codebooks(vectors(spark, rows))
    out = {r["vec_id"]: r for r in fitted.decoded(fitted.codes()).collect()}
    for i, v, _ in rows:
        whole = [np.floor(4096 * c) for c in v]
        assert sum((a - 4096 * b) ** 2 for a, b in zip(whole, out[i]["vector"])) == out[i]["error"]


def test_only_changes_move(spark, monkeypatch):
    """Running sums equal sums from scratch after every round, and a round without changes ends the work."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).tolist(), "a") for i in range(200)]
    seen = []
    add = vector_codes.Codebooks._add

    def checked(self, table):
        seen.append(table.filter("code != before").count())
        found = add(self, table)
        sums = {}
        for r in table.collect():
            for p, e in enumerate(bytes(r["code"])):
                sums.setdefault((p, e), []).append(r["v"][p])
        assert all(self.sums[k][0] == sum(x) and self.counts[k] == len(x) for k, x in sums.items())
        return found

    monkeypatch.setattr(vector_codes.Codebooks, "_add", checked)
    vector_codes.Codebooks(vectors(spark, rows), rounds=60)
    assert seen[0] == 200 and seen[-1] == 0 and len(seen) < 60


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, "a")])).collect() == []
    assert [r["error"] for r in vector_codes.compress(vectors(spark, [(1, [], "a"), (2, [], "a")])).collect()] == [0, 0]
    assert vector_codes.compress(vectors(spark, [(i, [0.25] * 8, "a") for i in range(30)])).select("error").distinct().collect()[0][0] == 0
    with pytest.raises(ValueError, match="exceed"):
        vector_codes.compress(vectors(spark, [(1, [1e300] * 8, "a")]))
    large = [(i, [float(i * 500)] * 8, "a") for i in range(30)]  # distances beyond what doubles hold exactly
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in vector_codes.compress(vectors(spark, large)).collect()) == sorted(brute_codes([r[:2] for r in large])[0])


def test_label_errors_without_broadcast(spark, monkeypatch):
    rows = vectors(spark, [(i, [i / 50] * 8, ["a", None][i % 2]) for i in range(40)])
    want = sorted(map(tuple, vector_codes.compress(rows).collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, vector_codes.compress(rows).collect())) == want


def test_discard_takes_only_saved_tables(spark, tmp_path):
    table = common.saved(spark.range(5), "x")
    common.discard(table)
    spark.range(5).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        common.discard(spark.read.parquet(f"{tmp_path}/other"))


# 13


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters", ["ab", "abcd", "aé\U00010400z"])
def test_edit_pairs(letters):
    rng = random.Random(len(letters))
    for _ in range(700):
        k = rng.randint(0, 7)
        words = sorted({"".join(rng.choices(letters, k=rng.choice([k, k + 1]))) for _ in range(rng.randint(1, 50))})
        got = [tuple(sorted((words[a], words[b]))) for a, b in spelling.edit_pairs(words, k, True)]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b) and k in (len(a), len(b))}


def brute_variants(rows):
    total = Counter()
    for i, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in words.items():
        own = [(-words[o], o) for o in words if o != w and one_edit(w, o)]
        near[w] = len(own)
        form[w] = min(own)[1] if own and -min(own)[0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return out


def prose(seed, words=1500):
    """Words of two letters' alphabets with many neighbours, some far more frequent than others."""
    rng = random.Random(seed)
    stock = ["".join(rng.choices("aàb", k=rng.randint(5, 7))) for _ in range(150)]
    return [" ".join(rng.choice(stock[: 1 + int(150 * rng.random() ** 3)]) for _ in range(words)).capitalize() for _ in range(8)]


@pytest.mark.parametrize("most", [20_000, 8, 1])
def test_variants(spark, monkeypatch, most):
    rows = list(enumerate(prose(3))) + [(None, "Ünder öfter öfter öfter " * 3), (9, None), (9, ""), (9, "a1b2 ß× ÀÉ"), (10, "x" * 40_000 + " "), (10, "x" * 40_000 + " "), (11, ("x" * 40_000 + " ") * 3)]
    monkeypatch.setattr(spelling, "HELD", 50)
    forms = spelling.forms
    monkeypatch.setattr(spelling, "forms", lambda words: forms(words, most))
    got = sorted(map(repr, map(tuple, spelling.variants(odd_docs(spark, rows)).collect())))
    want = brute_variants(rows)
    assert got == sorted(map(repr, want))
    assert any(r[1] and r[1] != r[2] for r in want) and sum(r[4] for r in want) > 100


def test_long_words_one_edit_apart(spark):
    long = "abcdefghij" * 3_000
    rows = [(i, " ".join([long] * 6 + [long[:77] + "x" + long[78:]] * 3 + [long + "q"] * 3)) for i in range(4)]
    assert sorted(map(repr, map(tuple, spelling.variants(odd_docs(spark, rows)).collect()))) == sorted(map(repr, brute_variants(rows)))


def test_pairs_come_once_and_meetings_are_bounded(spark):
    words = spark.createDataFrame([("a" * 6 + x + y, 3) for x in "abcdefgh" for y in "abcdefgh"], "word STRING, n LONG")
    for most in (64, 5, 1):
        pairs = spelling.near_pairs(words, most).collect()
        assert len(pairs) == len({(r["word"], r["other"]) for r in pairs}) == 64 * 14
    met = spelling.meetings(words, 5).groupBy("m", "low", "high", "before", "after").count()
    assert met.filter("count > 5 and high - low > 1").isEmpty()


def test_variants_of_nothing(spark):
    assert spelling.variants(odd_docs(spark, [])).collect() == []
    assert spelling.variants(odd_docs(spark, [(1, "word word")])).collect() == []


# Names that clash, equal rows, empty tables: the stages and operators that number or carry rows.


CLASHING = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, _k1 STRING, _k2 STRING, _shard STRING, _place STRING, shard STRING, place STRING, row STRING, x INT, node INT, root INT, first STRING, own STRING, tie INT"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", 1, "k1", "k2", "sh", "pl", "a", "b", "r", 1, 2, 3, "f", "o", 4) for k, (i, t) in enumerate(rows)], CLASHING)


def test_columns_keep_their_values(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("aeioustrnl", k=5)) for _ in range(80)) for _ in range(20)]
    docs = clashing(spark, [*enumerate(texts), (20, texts[0]), (21, texts[1] + " more")])
    own = tuple(docs.first())[5:]
    for out in (simhash.keep_similar_one(docs, 5, 0.8), mixing.Mix(docs).shuffled(docs), suffix_dedup.without_repeats(docs), quality.keep_good(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(tuple(r)[5:] == own for r in rows)
    assert sorted(r["doc_id"] for r in simhash.keep_similar_one(docs, 5, 0.8).collect()) == list(range(20))
    assert len(sharding.shard(docs).collect()) == 22


def test_stages_of_empty_tables(spark):
    empty = clashing(spark, [(1, "x")]).limit(0)
    for out in (simhash.keep_similar_one(empty, 5, 0.8), mixing.Mix(empty).shuffled(empty), suffix_dedup.without_repeats(empty), quality.keep_good(empty)):
        assert out.collect() == [] and out.columns == empty.columns


@pytest.mark.parametrize("doc_id", [7, None])
def test_equal_rows_fill_all_shards(spark, doc_id):
    docs = odd_docs(spark, [(doc_id, "the same row again and again")] * 2400)
    rows = sharding.shard(docs).collect()
    n = Counter(r["shard"] for r in rows)
    assert len(n) == 24 and max(n.values()) - min(n.values()) <= 20  # places are hashes of 24 bits
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k)) for s, k in n.items())


def test_equal_rows_are_packed_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    docs = odd_docs(spark, [(7, "the same row again and again")] * 1000)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 1000 and all(sorted(x)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:])) for x in by.values())
    length = rows[0]["length"]
    assert len(by) == -(-1000 // (1024 // length))


def test_fit_equals_dense_products():
    """The products of patterns that grow with the active set are those of whole columns."""
    rng = np.random.default_rng(0)
    have = np.bincount(rng.integers(1, 64, 3000), minlength=65)
    ways = packing.patterns(64)
    found = packing.fit(have, ways)
    m = np.zeros((65, len(found)))
    for k in range(3):
        np.add.at(m, (ways[list(found), k], np.arange(len(found))), 1.0)
    m[0] = 0
    goal = have.astype(float)
    goal[0] = 0
    z = np.linalg.lstsq(m, goal, rcond=None)[0]
    assert np.allclose(m @ z, m @ np.array(list(found.values())), atol=1e-3) and min(found.values()) > 0
