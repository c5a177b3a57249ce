"""The pipeline's stages on a small table, each against brute force on its own input."""

from collections import Counter

import numpy as np
import public_tokenizers

import __spark_entry__
import corpus_pipeline
from test_llm_operators import WORDS, brute_components, brute_fingerprint, brute_quality, brute_repeats, noise
from tidewell.llm import mixing, packing, simhash


def table(tmp_path, spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("aeioustrnlmpc"), rng.integers(3, 9))) for _ in range(n))
    shared = prose(60)
    rows = [(k, prose(int(rng.integers(40, 200))), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(k, prose(80) + " " + shared + " " + prose(80), "de", "s1", 0) for k in range(60, 70)]
    rows += [(70 + k, rows[k][1], "en", "s2", 0) for k in range(10)] + [(80, None, None, None, None), (81, "", "en", "s0", 0), (82, "spam " * 300, "en", "s0", 1500), (83, noise(80), "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf = table(tmp_path, spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "mixture", "packed_sequences"]
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality_rules"](spark, docs, sf).cache()
    assert good.columns == docs.columns
    base_good = {r["doc_id"] for r in docs.collect() if not brute_quality(r["text"])[5]}
    assert 83 in base_good and {r["doc_id"] for r in good.collect()} == base_good - {83}  # a band rejects what the base rules let through

    one = stage["near_duplicates"](spark, good, sf).cache()
    root = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in good.collect()})
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(root.values())) and one.columns == docs.columns

    bare = stage["repeated_passages"](spark, one, sf).cache()
    gone = {i: n for i, _, n, _, _ in brute_repeats([(r["doc_id"], r["text"]) for r in one.collect()])}
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    assert sum(gone.values()) > 1000 and bare.columns == docs.columns
    for r in bare.collect():
        assert len(r["text"].encode()) == len(before[r["doc_id"]].encode()) - gone[r["doc_id"]] and r["n_chars"] == len(r["text"])

    mixed = stage["mixture"](spark, bare, sf).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    words = lambda rows: sum(len(WORDS.findall(r["text"] or "")) for r in rows)
    assert abs(words(mixed.collect()) - words(bare.collect())) < 0.05 * words(bare.collect())

    packed = stage["packed_sequences"](spark, mixed, sf).collect()
    w = packing.WordTokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER), 2)
    assert sum(r["length"] for r in packed) == sum(len(w.encode([r["text"] or ""])[0]) // 4 for r in mixed.collect())

    run = __spark_entry__.queries()["pipeline"](spark, sf)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run.collect())) == sorted(map(key, packed))


def brute_similar(texts):
    """Each text's smallest linked position, by the Jaccard similarity of all pairs' sets of five words."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0]
    root, before = list(range(len(texts))), None
    while root != before:
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_duplicates_are_texts_of_similarity_0_8(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: ["".join(rng.choice(list("aeioustrnlmpc"), 6)) for _ in range(n)]
    texts = [None, "", "one two", "one two"]
    for n in (30, 90, 200, 400):
        base = prose(n)
        for edits in (0, 1, 2, 4, 8, 16):
            own = list(base)
            for k in rng.choice(n, edits * n // 200, replace=False):
                own[k] = "changed%d" % rng.integers(10**6)
            texts.append(" ".join(own))
        texts += [" ".join(base[: n * 85 // 100]), " ".join(base[: n * 60 // 100])]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(brute_similar(texts))) and 8 < len(kept) < 25


def test_mixture_is_written_by_shard(spark):
    docs = spark.createDataFrame([(k, "word " * (5 + k % 40), "en", f"s{k % 3}", 0) for k in range(400)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    m = mixing.Mix(docs)
    copies = sorted((r["_shard"], r["_place"], r["doc_id"]) for r in m.copies(docs).collect())
    assert len({s for s, _, _ in copies}) == mixing.SHARDS
    assert sorted((s, p, r["doc_id"]) for r in m.taken().collect() for s, p in zip(r["shards"], r["places"])) == copies
    assert [r["doc_id"] for r in corpus_pipeline.mixture(spark, docs, "").collect()] == [i for _, _, i in copies]


def test_mixture_takes_what_the_tree_draws(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * 9, "en", f"s{k % 3}", 0) for k in range(300)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *x: np.where(np.arange(len(x[1]))[:, None] == 3, tree(*x), 0))
    rows = mixing.Mix(docs).taken().collect()
    assert {s for r in rows for s in r["shards"]} == {3}
    assert all(r["taken"] == r["size"] * len(r["shards"]) for r in rows) and any(not r["shards"] for r in rows)


def test_near_duplicates_keep_a_row_of_each_group(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (7, texts[3]), (9, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    kept = sorted((r["text"], r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == [(texts[0], None), (texts[1], None), (texts[2], 7), (texts[3], 7), (texts[4], 9)]


def test_a_loose_group_asks_few_pairs(spark, monkeypatch):
    """Copies with edits of their own, most too far apart to be alike: the same groups as by all pairs, from few verified pairs."""
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("aeioustrnlmpc"), 7))
    base = [word() for _ in range(160)]

    def edited(n):
        out = list(base)
        for at in rng.choice(160, n, replace=False):
            out[at] = word()
        return " ".join(out)

    texts = [edited(int(rng.integers(1, 9))) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    asked, verified = [], simhash._alike

    def counting(pairs, sets, similarity):
        asked.append(pairs.count())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "_alike", counting)
    kept = sorted(r["doc_id"] for r in simhash.keep_similar_one(docs, 5, 0.8).collect())
    assert kept == sorted(set(brute_similar(texts))) and 1 < len(kept) < 250
    assert len(asked) == 3 and sum(asked) < 250 * 249 / 2 / 4


def test_sketches_never_part_sets_that_are_alike():
    rng = np.random.default_rng(32)
    for size in (1, 2, 4, 5, 9, 20, 60, 160, 500, 3000, 40_000):
        apart = 0
        for _ in range(40):
            union = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            common = int(np.ceil(0.8 * len(union)))
            mine = int(rng.integers(0, len(union) - common + 1))
            order = rng.permutation(len(union))
            x, y = np.sort(union[order[: common + mine]]), np.sort(np.concatenate([union[order[:common]], union[order[common + mine :]]]))
            z = np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            marks = [np.frombuffer(simhash.sketch(v), np.uint8)[None] for v in (x, y, z)]
            assert simhash.sketches_meet(marks[0], marks[1], np.array([len(x) + len(y)]), 0.8)[1].all()
            apart += not simhash.sketches_meet(marks[0], marks[2], np.array([len(x) + len(z)]), 0.8)[1].all()
        assert apart == 40 or size < 5
    assert simhash.sketch(np.zeros(0, np.uint64)) == bytes(simhash.SKETCH)


def test_near_copies_go_through_blocks_and_pivots(spark, monkeypatch):
    """Close fingerprints share a bucket of blocks, also where no band of least hashes meets; the pivot table is asked."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    fp, near = simhash.majority(base), 0
    for k in range(40):
        other = base.copy()
        other[rng.integers(0, 4000, 60)] ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        if (fp ^ simhash.majority(other)).bit_count() <= simhash.MOST_BITS:
            near += 1
            assert set(simhash.set_keys(base)[simhash.BANDS :].tolist()) & set(simhash.set_keys(other)[simhash.BANDS :].tolist())
    assert near > 5 and len(simhash.set_keys(base)) == simhash.KEYS and not len(simhash.set_keys(base[:0]))
    asked, pivots = [], simhash.pivots
    monkeypatch.setattr(simhash, "pivots", lambda *a: asked.append(1) or pivots(*a))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z u v w")], "doc_id LONG, text STRING")
    assert sorted(r["doc_id"] for r in simhash.keep_similar_one(docs, 5, 0.8).collect()) == [1, 3] and asked
