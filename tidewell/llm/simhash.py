"""SimHash near-duplicates through pivot distance tables.

Every text has a 64-bit fingerprint; equal fingerprints are one class, found by an aggregate. Two
fingerprints that differ in at most two bits agree in four of six bit blocks at least, so each class
representative goes to fifteen buckets, one for each choice of four blocks; buckets are runs of a
sorted partition. In a bucket the table of Hamming distances to PIVOTS reference fingerprints
discards a pair when some coordinate differs by more than the limit (triangle inequality), and the
survivors are verified. A bucket holds 2^22 fingerprints at most, those that agree in its bits; one
with over DENSE members looks up each member's neighbours instead, at most 253 each, which finds
the same links. Only a spanning forest of a batch's links leaves the task.

The pipeline's stage has another rule, links between texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more (keep_similar_one). Their fingerprints differ in 10 bits on
average, so blocks of bits alone would miss most of them: a set goes to the fifteen buckets of its
fingerprint and to buckets that are bands of least hashes. Pairs with a bucket's smallest member are
verified at once; of the others the pivot table discards, Hamming distances and sketches screen what
is left, and the sets verify the survivors.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked
like any other; repeated rows share their fingerprint; component_id is the smallest doc_id that can
be reached; a null doc_id doesn't count for it, and a component with no other id has a null one; an
empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components, saved

SEED = 42
SHINGLE = 3
MOST_BITS = 2
PIVOTS = 24
DENSE = 1024
#: Bits of the six blocks, from the lowest.
BLOCKS = (11, 11, 11, 11, 10, 10)
BATCH_HASHES = 200_000
#: Of similar_links: BANDS keys of ROWS least hashes each. Sets of similarity 0.8 share no key with a chance of (1 - 0.8^4)^20 = 0.00003.
BANDS, ROWS = 20, 4
#: Keys of a set: its bands' and those of fifteen choices of blocks.
KEYS = BANDS + 15
#: Fingerprints of sets with similarity 0.8 differ in 10 bits on average, deviation 3.
WIDE_BITS = 24
#: A set's sketch has the least hash of each of SKETCH ranges. The share of equal ones among ranges in use estimates the
#: similarity; pairs whose estimate is over SKETCH_DEVIATIONS of its standard deviations below the limit aren't verified.
SKETCH, SKETCH_DEVIATIONS = 512, 5


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    lows, highs = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], seed) for a, b in zip(lows, highs)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, BATCH_HASHES):
        part = hashes[at : at + BATCH_HASHES].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def rows(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


def bucket_masks() -> list[int]:
    edges = np.concatenate([[0], np.cumsum(BLOCKS)])
    block = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(len(BLOCKS)), len(BLOCKS) - MOST_BITS)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def links(keys: np.ndarray, fps: np.ndarray, masks: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of positions within runs of equal keys; fps ascend in a run, masks has each row's bucket bits."""
    n = len(fps)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    run = np.cumsum(first) - 1
    sizes = np.bincount(run)
    keep = sizes[run] > 1
    out_a, out_b = [], []
    small = np.flatnonzero(keep & (sizes[run] <= DENSE))
    if len(small):
        f, r = fps[small], run[small]
        table = np.bitwise_count(f[:, None] ^ references[None, :]).astype(np.int8)
        for step in range(1, int(sizes[r].max())):
            i = np.flatnonzero(r[step:] == r[:-step])
            if not len(i):
                break
            near = np.abs(table[i] - table[i + step]).max(axis=1) <= MOST_BITS
            i = i[near]
            i = i[np.bitwise_count(f[i] ^ f[i + step]) <= MOST_BITS]
            out_a.append(small[i])
            out_b.append(small[i + step])
    for k in np.flatnonzero(sizes > DENSE):
        at = np.flatnonzero(run == k)
        f, free = fps[at], [b for b in range(64) if not int(masks[at[0]]) >> b & 1]
        for bits in [*combinations(free, 1), *combinations(free, 2)]:
            asked = f ^ np.uint64(sum(1 << b for b in bits))
            place = np.minimum(np.searchsorted(f, asked), len(f) - 1)
            hit = np.flatnonzero((f[place] == asked) & (f < asked))
            out_a.append(at[hit])
            out_b.append(at[place[hit]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with the links' components; roots and lone nodes are left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def whole_runs(batches, names: tuple[str, ...], keys: int):
    """The batches' columns cut anew, so that no run of equal values in the first `keys` columns is parted."""
    left = None
    for batch in batches:
        have = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if left is not None:
            have = [np.concatenate(x) for x in zip(left, have)]
        if not len(have[0]):
            continue
        ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in have[:keys]], axis=0))
        cut = int(ends[-1]) + 1 if len(ends) else 0  # the last run may go on in the next batch
        left = [x[cut:] for x in have]
        if cut:
            yield [x[:cut] for x in have]
    if left is not None and len(left[0]):
        yield left


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of classes (fp), a spanning forest of each batch's."""
    masks = bucket_masks()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    buckets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)]))
    placed = classes.select("fp", buckets.alias("x")).select("x.k", "x.bits", "fp").repartition("k", "bits").sortWithinPartitions("k", "bits", "fp")
    references, by_k = pivots(), np.array(masks, dtype=np.uint64)

    def rows(batches):
        for k, bits, fp in whole_runs(batches, ("k", "bits", "fp"), 2):
            yield from found(k, bits, fp)

    def found(k, bits, fp):
        u = np.ascontiguousarray(fp).view(np.uint64)
        order = np.lexsort((u, bits, k))
        k, bits, u = k[order], bits[order], u[order]
        key = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (bits[1:] != bits[:-1]))])
        a, b = links(key, u, by_k[k], references)
        if len(a):
            node, root = forest(u[a].view(np.int64), u[b].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    return placed.mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (hex), component_id."""
    own = saved(fingerprints(docs), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(candidate_links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng([SEED, 1])
    mask, factor = (rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, at : at + 4096] ^ mask) * factor).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.astype("<u8").reshape(BANDS, ROWS))], dtype=np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each of SKETCH ranges of hash values: 0 if the ascending hashes have none there, else 1 to 255 from the least."""
    starts = np.searchsorted(hashes >> np.uint64(64 - SKETCH.bit_length() + 1), np.arange(SKETCH + 1, dtype=np.uint64))
    used = starts[1:] > starts[:-1]
    out = np.zeros(SKETCH, np.uint8)
    out[used] = hashes[starts[:-1][used]] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def sketches_meet(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of sketches of sets with so many members together: the estimated similarity, and whether the true one can reach the limit.

    The variance is that of one-permutation hashing; a range is let off for sets of few members.
    """
    used, equal = ((x | y) != 0).sum(axis=1), ((x == y) & (x != 0)).sum(axis=1)
    others = np.maximum(sizes / (1 + similarity) - 1, 1)
    deviation = np.sqrt(similarity * (1 - similarity) * np.maximum((1 + 1 / others) / np.maximum(used, 1) - 1 / others, 0))
    return equal / np.maximum(used, 1), equal + 1 >= (similarity - SKETCH_DEVIATIONS * deviation) * used



def set_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's buckets: its bands' and those of its fingerprint's blocks; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    fp = majority(hashes)
    blocks = [xxhash.xxh64_intdigest((fp & m).to_bytes(8, "little"), BANDS + k) for k, m in enumerate(bucket_masks())]
    return np.concatenate([band_keys(hashes), np.array(blocks, dtype=np.uint64)])


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, _k1, _k2): docs' rows as one column, whatever their columns are called, and two hashes of each."""
    columns = [docs[c] for c in docs.columns] + [docs[c].isNull() for c in docs.columns]
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return docs.select(row, docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(SEED), *columns).alias("_k2"))


def set_marks(keyed: DataFrame, shingle: int) -> DataFrame:
    """Per row its keys, doc_id, and of its set of shingles: an id, the size, the fingerprint and the keys of its buckets."""

    def rows(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in batch.column("text").to_pylist()]
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64), pa.int64())
            bands = [set_keys(x).view(np.int64) for x in sets]
            columns = [signed([_set_id(x) for x in sets]), pa.array(map(len, sets), pa.int64()), signed([majority(x) for x in sets]), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), batch.column("doc_id"), *columns], names=["_k1", "_k2", "doc_id", "node", "n", "fp", "bands"])

    return keyed.select("_k1", "_k2", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "_k1 long, _k2 long, doc_id long, node long, n long, fp long, bands array<long>")


def shingle_sets(keyed: DataFrame, shingle: int) -> DataFrame:
    """(node, members, sketch, bands) of each distinct set of shingles, bands being its keys as bytes."""

    def rows(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in batch.column("text").to_pylist()]
            ids = np.array([_set_id(x) for x in sets], dtype=np.uint64).view(np.int64)
            columns = [pa.array(ids, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(map(sketch, sets), pa.binary()), pa.array([set_keys(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "members", "sketch", "bands"])

    return keyed.select("text").mapInArrow(rows, "node long, members array<long>, sketch binary, bands binary")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity at least."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.filter(F.col("common") + 1e-9 >= similarity * (F.col("n") - F.col("common"))).select("a", "b")


def _asked(met: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, best: bool) -> DataFrame:
    """Pairs (a, b) of a bucket in different components that can have that similarity; with best only each member's likeliest.

    Two members that share several buckets are a pair of the first one only.
    """
    roots = roots.withColumnsRenamed({"node": "own"})
    tagged = saved(met.drop("a").join(roots, met["node"] == roots["own"], "left").select("key", F.coalesce("root", "node").alias("root"), "node", "n", "fp"), "simhash-tagged")
    mixed = tagged.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a < z").select("key")
    rest = tagged.join(mixed, "key", "left_semi").join(sets.select("node", "sketch", "bands"), "node")
    rest = rest.select("key", "root", "node", "n", "fp", "sketch", "bands").repartition("key").sortWithinPartitions("key", "node")

    references = pivots()

    def rows(batches):
        for key, root, node, n, fp, marks, bands in whole_runs(batches, ("key", "root", "node", "n", "fp", "sketch", "bands"), 1):
            i, step, u = np.arange(len(key)), 0, np.ascontiguousarray(fp).view(np.uint64)
            marks, bands = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, SKETCH), np.frombuffer(b"".join(bands), np.int64).reshape(-1, KEYS)
            table = np.bitwise_count(u[:, None] ^ references[None, :]).astype(np.int8)
            likest, partner = np.full(len(key), -1.0), np.zeros(len(key), np.int64)
            while True:
                step += 1
                i = i[i + step < len(key)]
                i = i[key[i] == key[i + step]]
                if not len(i):
                    break
                j = i + step
                near = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                at = i[near]
                at = at[np.abs(table[at] - table[at + step]).max(axis=1) <= WIDE_BITS]
                at = at[np.bitwise_count(u[at] ^ u[at + step]) <= WIDE_BITS]
                like, meets = sketches_meet(marks[at], marks[at + step], n[at] + n[at + step], similarity)
                at, like = at[meets], like[meets]
                if not best:
                    first = (bands[at] == bands[at + step]).argmax(axis=1)
                    at = at[bands[at, first] == key[at]]
                if best:
                    for x, y in ((at, at + step), (at + step, at)):
                        more = like > likest[x]
                        likest[x[more]], partner[x[more]] = like[more], y[more]
                elif len(at):
                    yield pairs(node[at], node[at + step])
            found = np.flatnonzero(likest >= 0)
            if len(found):
                yield pairs(np.minimum(node[found], node[partner[found]]), np.maximum(node[found], node[partner[found]]))

    def pairs(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rest.mapInArrow(rows, "a long, b long").distinct()


def similar_links(keyed: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all classes whose sets have that similarity at least and share a band key.

    First each class of a bucket (an equal band key) is compared with the bucket's smallest; a large group of
    near copies is one component after that. Then each class is compared with the likeliest one of another component,
    which joins looser groups by as many pairs as they have members. Last come the pairs that are still apart.
    """
    placed = classes.select("node", "n", "fp", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").drop("z")
    met = saved(placed.join(shared, "key"), "simhash-met")
    wanted = classes.join(met.select("node").distinct(), "node", "left_semi").select("_k1", "_k2")
    sets = saved(shingle_sets(keyed.join(wanted, ["_k1", "_k2"], "left_semi"), shingle).dropDuplicates(["node"]), "simhash-sets")
    stars = saved(met.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "simhash-stars")
    sure = saved(_alike(stars, sets, similarity), "simhash-links")
    likeliest = saved(_asked(met, connected_components(sure), sets, similarity, True).join(stars, ["a", "b"], "left_anti"), "simhash-likeliest")
    sure = saved(sure.union(_alike(likeliest, sets, similarity)), "simhash-links")
    others = _asked(met, connected_components(sure), sets, similarity, False).join(stars.union(likeliest), ["a", "b"], "left_anti")
    return sure.union(_alike(others, sets, similarity))


def keep_similar_one(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows of docs without all but one of each group: rows whose sets of shingles have that Jaccard
    similarity at least are linked. Of a group the row with the smallest doc_id stays, null last, ties by a
    hash of the row; rows without words are one group."""
    keyed = _keyed(docs)
    own = saved(set_marks(keyed, shingle), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")
    classes = saved(own.groupBy("node").agg(F.min(order).alias("first"), *[F.any_value(c).alias(c) for c in ("n", "fp", "bands")]).select("*", "first._k1", "first._k2"), "simhash-classes")
    roots = connected_components(similar_links(keyed, classes, shingle, similarity)).withColumnsRenamed({"node": "own"})
    kept = classes.join(roots, classes["node"] == roots["own"], "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("x")).select("x._k1", "x._k2")
    out = keyed.join(kept, ["_k1", "_k2"], "left_semi")
    counts = own.agg(F.count("*").alias("n"), F.count_distinct("_k1", "_k2").alias("rows")).first()
    return (out if counts["n"] == counts["rows"] else out.dropDuplicates(["_k1", "_k2"])).select("row.*")
