"""Each operator against a brute-force version and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tidewell.llm import html_extract, license_scan, mixing, packing, quality, sharding, simhash, suffix_dedup, topk, url_filter

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, size STRING, block INT, kept STRING, h STRING, fp INT, node INT, i INT, row STRING, rank INT, part INT, shard INT, length INT"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = "the shared passage runs on for well over fifty bytes in every document that quotes it, word for word. "


def texts():
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("aeioustrnl"), rng.integers(2, 8))) for _ in range(n))
    out = [prose(int(rng.integers(1, 120))) for _ in range(60)]
    base = prose(200)
    out += [base, base, base + " tail", "Head " + base, base.replace("a", "A", 3), None, "", " \n\t", None, "word " * 400, "x" * 5000, prose(9000)]
    out += [prose(30) + " " + SHARED + prose(25) for _ in range(8)] + ["Zwölf Boxkämpfer jagen é　 " + prose(60), "under the MIT license\n" * 3, "a\x00b c"]
    return out


def frame(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    full = [(i, t, ["en", "de", None][k % 3], ["s1", "s1", "s1", "s2", None][k % 5], 0, "x", 1, "k", "h", 2, 3, 4, "r", 5, 6, 7, 8) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return frame(spark, rows + rows[:5])  # five rows come twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1


def brute_repeats(rows):
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for j in range(len(t) - 49):
            first[t[j : j + 50]] = min(i, first.get(t[j : j + 50], i))
    for i, t in data:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 9), rng.integers(0, 40)).tolist() + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])


@pytest.mark.parametrize("block,hot", [(1 << 21, 20_000), (9_000, 20_000), (9_000, 1)])
def test_repeats(docs, monkeypatch, block, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    want = brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(rows_of(suffix_dedup.deduplicate(docs))) == sorted(want)
    assert sum(w[2] for w in want) > 1000


def test_repeats_null_ids_and_empty(spark, empty):
    got = rows_of(suffix_dedup.deduplicate(frame(spark, [(None, SHARED), (7, SHARED), (9, SHARED[:49])])))
    assert {(r[0], r[2]) for r in got} == {(None, len(SHARED)), (7, 0), (9, 0)}
    assert rows_of(suffix_dedup.deduplicate(empty)) == []


def test_repeats_leave_other_columns(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    for i, n, gone, _, sha in brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()]):
        text = kept[i]["text"]
        if n and (text or "").isascii():
            assert hashlib.sha256(text.encode()).hexdigest() == sha
        assert kept[i]["size"] == "x" and (text is None or kept[i]["n_chars"] == len(text))


def test_what_the_arrays_find(monkeypatch):
    """Equal stretches are merged before the arrays; what stretches that differ share is found by the arrays alone."""
    ids = np.array([5, 3, 9, 3, 7])
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, (5, suffix_dedup.WIDE)).astype(np.uint8)
    text[1:4] = text[0]
    text[2, -1] ^= 1  # shares all windows but the last with the first
    left, n = np.full(5, 30), np.full(5, suffix_dedup.SPAN)
    bits = lambda masks: ((masks[:, None] >> np.arange(suffix_dedup.SPAN, dtype=np.uint32)) & 1).tolist()
    assert bits(suffix_dedup.seen_earlier(text, left, n, ids)) == [[1] * 31, [0] * 31, [1] * 30 + [0], [0] * 31, [0] * 31]
    monkeypatch.setattr(suffix_dedup, "_first_documents", lambda *x: None)
    assert bits(suffix_dedup.seen_earlier(text, left, n, ids)) == [[1] * 31, [0] * 31, [0] * 31, [0] * 31, [0] * 31]


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    rows = np.random.default_rng(1).integers(0, 3, (400, 8)).astype(np.uint8)
    rows[:, 2:] = 0
    extra = np.arange(400) % 2
    want = np.unique(np.concatenate([rows, extra[:, None]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    for hashes in (suffix_dedup.row_hashes, lambda r, e: (np.zeros(len(r), np.uint64),) * 2):
        monkeypatch.setattr(suffix_dedup, "row_hashes", hashes)
        order, begin, which = suffix_dedup.row_classes(rows, extra)
        assert len(set(zip(which.tolist(), want.tolist()))) == len(set(want.tolist())) == len(begin)
        assert (np.diff(which[order]) >= 0).all() and (which[order[begin]] == np.arange(len(begin))).all()


# 2


def brute_quality(text):
    words = WORDS.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if n[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality(docs, empty):
    for r, d in zip(rows_of(quality.assess(docs).orderBy("doc_id")), docs.orderBy("doc_id").collect()):
        assert r[1:7] == brute_quality(d["text"])
        assert not (r[6] and r[7])
    assert rows_of(quality.assess(empty)) == []


class Ratio:
    """A compressor whose ratio is `whole` for the whole text and `part` for less."""

    def __init__(self, size, whole, part):
        self.size, self.whole, self.part = size, whole, part

    def compress(self, data):
        return b"x" * round(len(data) * (self.whole if len(data) == self.size else self.part))


def distinct_words(n, size):
    """A text of `size` bytes and n words, none repeated."""
    words = [f"w{k:04d}" for k in range(n)]
    return " ".join(words)[: size - 1] + "e" * (size - len(" ".join(words)[: size - 1]))


@pytest.mark.parametrize("k", range(1, len(quality.BANDS)))
def test_both_sides_of_every_band(k):
    most, low, high = quality.BANDS[k]
    size = min(most, 40_000)
    text = distinct_words(50, size) if size < 400 else distinct_words(60, size)
    kept = lambda whole, part: quality.judge(text, Ratio(len(text), whole, part))[6]
    middle = sum(quality.CHUNK_BAND) / 2
    assert len(text) == size and quality.base_counts(text)[0] >= 50
    assert kept(low + 0.01, middle) and kept(high - 0.01, middle)
    assert not kept(low - 0.01, middle) and not kept(high + 0.01, middle)
    if size > quality.CHUNK_BYTES:  # chunks have a band of their own
        whole = (low + high) / 2
        assert kept(whole, quality.CHUNK_BAND[0] + 0.01) and kept(whole, quality.CHUNK_BAND[1] - 0.01)
        assert not kept(whole, quality.CHUNK_BAND[0] - 0.01) and not kept(whole, quality.CHUNK_BAND[1] + 0.01)


def noise(n):
    """n words of random base64."""
    return " ".join(base64.b64encode(np.random.default_rng(k).bytes(45)).decode() for k in range(n))


def test_share_of_chunks_and_tails():
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    rng = np.random.default_rng(6)
    prose = " ".join("".join(rng.choice(list("aeioustrnlmpc"), rng.integers(3, 9))) for _ in range(6000))[: 8 * quality.CHUNK_BYTES]
    flat = ("all the same again " * 400)[: quality.CHUNK_BYTES]
    assert quality.ratios(prose.encode(), c)[1:] == (8, 0, 0)
    assert quality.ratios((flat + prose[: -len(flat)]).encode(), c)[1:] == (8, 1, 4096)
    assert quality.ratios((prose + "tail " * 100).encode(), c)[1:] == (9, 1, 500)
    for text in (prose, prose[:5000], prose[:700]):
        ratio, n, bad, _ = quality.ratios(text.encode(), c)
        fresh = lambda x: len(zstandard.compress(x.encode(), quality.LEVEL)) / len(x)
        assert ratio == pytest.approx(fresh(text)) and n == -(-len(text) // 4096) and bad == 0


def test_compression_bands(spark):
    rng = np.random.default_rng(5)
    prose = " ".join("".join(rng.choice(list("aeioustrnl"), rng.integers(2, 9))) for _ in range(400))
    spam = "\n".join(f"buy number {k % 17} now" for k in range(300))
    codes = " ".join(np.random.default_rng(k).bytes(30).hex() for k in range(60))
    rows = [(1, prose), (2, spam), (3, noise(80)), (4, noise(70) + "\n" + prose)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.assess(frame(spark, rows)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, False), 4: (False, False)}
    assert [r["doc_id"] for r in quality.keep_good(frame(spark, [*rows, (5, codes)])).collect()] == [1, 5]


# 3


def test_license_base(docs, empty):
    want = {}
    for d in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d["text"] or "").translate(LOW))
        found = [(k, label) for p, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in found]
        want[d["doc_id"]] = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))
    for r in rows_of(license_scan.scan_licenses(docs)):
        assert r[1:6] == want[r[0]]
        assert set(filter(None, r[5].split(","))) <= set(filter(None, r[6].split(","))) and 0 <= r[7] <= 1
    assert rows_of(license_scan.scan_licenses(empty)) == []


@pytest.mark.parametrize(
    "template,text,accepted",
    [
        ("a [[b]] c", "a c", True), ("a [[b]] c", "a b c", True), ("a [[b]] c", "a x c", False), ("a {{2}} c", "a x y c", True), ("a {{2}} c", "a c", True),
        ("a {{2}} c", "a x y z c", False), ("a [[b {{1}}]] c", "a b q c", True), ("a [[b [[d]]]] c", "a b d c", True), ("[[x]] a b", "a b", True), ("a b", "a", False),
    ],
)
def test_automaton(template, text, accepted):
    a, words = license_scan.compile_template(template), [w.encode() for w in text.split()]
    assert (a.ends(words, 0) is not None) == accepted


def test_templates_match(spark):
    mit = MIT + " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS
    got = license_scan.scan_licenses(frame(spark, [(1, mit), (2, mit.replace("hereby", "not")), (3, "Licensed under the Apache License, Version 2.0 (CC BY-NC 4.0)")])).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "", "apache-2,cc-by-nc"]


# 4


def brute_top_k(vectors, k=5):
    def weights(v):
        return [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * int(x) for x in v]

    good = [(n, i, weights(v)) for n, (i, v) in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want, shown = [], lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for n, q, w in good:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, c)), i is None, i or 0) for m, i, c in good if m != n)[:k]
            want += [(q, r + 1, None if none else i, shown(-s)) for r, (s, none, i) in enumerate(scored)]
    return want


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("scale", [1, 1e4, 1e6, 1e13])
def test_top_k(spark, monkeypatch, scale):
    rng = np.random.default_rng(2)
    vectors = [(k, [float(x) * scale if rng.random() < 0.6 else 0.0 for x in rng.normal(size=6).round(2)]) for k in range(120)]
    vectors += [(200, vectors[3][1]), (250, None), (300, [1.0, None]), (350, [float("nan")] * 6), (None, [1.0 * scale] * 6), (400, []), (3, vectors[3][1])]
    vectors += [(0, vectors[7][1]), (7, vectors[8][1]), (7, vectors[8][1]), (50, vectors[50][1]), (450, [1e305, -1e305])]
    if scale == 1:
        vectors = vectors[:-1]
    monkeypatch.setattr(topk, "BLOCK", 17)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id LONG, embedding ARRAY<DOUBLE>, rank INT, score INT").repartition(5)
    assert ordered(rows_of(topk.top_k(df))) == ordered(brute_top_k(vectors))
    assert rows_of(topk.top_k(df.limit(0))) == []


def test_top_k_beyond_a_product_of_doubles(spark):
    """The reviewer's case: a pair whose score is 39321600000000, and ties that only exact sums part."""
    vectors = [(0, [20000.0, 0.0]), (1, [30000.0, 0.0]), (2, [20000.0, 0.0]), (3, [2.0**40, 1.0]), (4, [2.0**40, 0.0]), (50, [2.0**40, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = rows_of(topk.top_k(df))
    assert ordered(got) == ordered(brute_top_k(vectors))
    assert (0, 4, 1, 39321600000000) in got


def test_top_k_of_large_blocks(spark):
    """Blocks that are large enough for the partial maxima, with many ties."""
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (6000, 4)) / 256)]
    df = spark.createDataFrame(vectors, "vec_id LONG, embedding ARRAY<FLOAT>").coalesce(1)
    m = np.floor(256 * np.array([v for _, v in vectors])).astype(np.int64)
    want = []
    for q in range(0, 6000, 50):
        s = m @ m[q]
        at = [i for i in np.lexsort((np.arange(6000), -s))[:6] if i != q][:5]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(at)]
    assert ordered(rows_of(topk.top_k(df))) == ordered(want)


# 5


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<nav>a</nav>", ""),
        ("<body><nav>Menu</nav><article><h1>T&amp;t</h1><p>One <b>b</b>old,\n two.<p>Three<br>four.<script>x<p></script></article><footer>f", "T&t One bold, two. Three four."),
        ("<header>Site</header><div><h2>Tea</h2><p>A cup, hot &lt;and&gt; good.</p><div class='ad'>Buy, now!</div><p>Second one, longer than that.</p></div><div id=comments><p>I like it, a lot, really.</p></div>", "Tea A cup, hot <and> good. Second one, longer than that."),
        ("<article><header><h1>Head</h1></header><p>Body, of it.</p><form>f</form><aside>s</aside><!-- <p>no</p> --></article>", "Head Body, of it."),
        ("<article><p>One, two.</p><p>a <b " + "x   " * 20000 + "</article>", "One, two. a <b " + ("x " * 20000).strip()),
        ("<article><p title='a > b' class=c>In, it.</p><img alt='x>y'/></article>", "In, it."),
        ("<article><p>" + "word, " * 30000 + "</p></article>", ("word, " * 30000).strip()),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page or "") == text


def test_extract_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x, y.</p></article>", "t", 9), (2, None, None, None, None)], "page_id LONG, url STRING, html STRING, text STRING, n_chars INT")
    assert rows_of(html_extract.extract(df).orderBy("page_id")) == [(1, "u", "x, y.", 5), (2, None, "", 0)]
    assert rows_of(html_extract.extract(df.limit(0))) == []


def plain_pages(n=40):
    """(html, main text) of pages without article or main, whose classes tell nothing."""
    out = []
    for seed in range(n):
        rng = np.random.default_rng(seed)
        words = lambda k: " ".join("".join(rng.choice(list("aeioustrnl"), rng.integers(2, 8))) for _ in range(k))
        sentence = lambda: words(int(rng.integers(6, 18))).capitalize() + ", " + words(int(rng.integers(3, 9))) + ". "
        paragraphs = ["".join(sentence() for _ in range(int(rng.integers(3, 7)))).strip() for _ in range(int(rng.integers(3, 9)))]
        items = [words(3) for _ in range(3)]
        links = lambda k: "".join(f"<li><a href='/{i}'>{words(int(rng.integers(1, 4)))}</a></li>" for i in range(k))
        parts = [f"<p>{p}</p>" for p in paragraphs]
        parts.insert(1, "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
        parts.insert(2, f"<div class='k7'>{words(5)}</div>")
        title = words(4)
        html = f"<html><body><div class='k1'><ul>{links(9)}</ul></div><div class='k2'>{words(6)}</div><div class='k3'><h2>{title}</h2>{''.join(parts)}</div><div class='k4'><span>{words(3)}</span><ul>{links(12)}</ul></div><div class='k5'>{words(7)}</div></body></html>"
        out.append((html, " ".join([title, paragraphs[0], *items, *paragraphs[1:]])))
    return out


def test_ratios_alone_find_the_text(monkeypatch):
    pages = plain_pages()
    assert [html_extract.main_text(h) for h, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(html_extract, "path_ratios", lambda texts: [9.0] * len(texts))
    assert sum(html_extract.main_text(h) != t for h, t in pages) == len(pages)


def brute_ratios(html):
    """(text, ratio) of each text by the standard library's parser and a loop over all texts for each."""
    texts, stack = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append(tag + "".join(mark + re.sub(r"\d+", "0", dict(attrs)[k]) for k, mark in (("class", "."), ("id", "#")) if dict(attrs).get(k)))

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            if data.strip():
                texts.append((tuple(stack), data.strip()))

    Reader().feed(html)
    fused = []
    for path, _ in texts:
        same = [t for p, t in texts if p == path]
        share = sum(map(len, same)) / sum(len(t) for _, t in texts)
        fused.append(np.log(1 + sum(map(len, same)) / len(same)) + np.log(1 + sum(sum(c in ".,;:!?" for c in t) for t in same) / len(same)) + np.log(share))
    near = lambda i: fused[max(0, min(len(fused) - 1, i))]
    return [(t, 0.15 * near(i - 1) + 0.7 * near(i) + 0.15 * near(i + 1)) for i, (_, t) in enumerate(texts)]


def test_ratios_against_brute_force():
    for html, _ in plain_pages():
        said = [(node.path, piece) for node, _, piece in html_extract.read(html).texts if piece.strip()]
        got = [(piece.strip(), r) for (_, piece), r in zip(said, html_extract.path_ratios(said))]
        want = brute_ratios(html)
        assert [t for t, _ in got] == [t for t, _ in want]
        assert np.allclose([r for _, r in got], [r for _, r in want])


class Article(HTMLParser):
    """The text of article elements, blocks joined by a space: what the given pages' main text is."""

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if self.depth and tag in ("p", "br", "h1", "li", "ul"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "li", "ul"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def article_of(html):
    reader = Article()
    reader.feed(html)
    return " ".join("".join(reader.parts).split())


def given_pages():
    return [x or "" for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()]


def test_given_pages_by_an_independent_reader():
    assert [html_extract.main_text(h) for h in given_pages()] == list(map(article_of, given_pages()))


def test_ratios_decide_on_given_pages(monkeypatch):
    """With one ratio for all paths most pages get another text; the tag article has no part in it."""
    pages = given_pages()
    want = list(map(article_of, pages))
    plain = [h.replace("<article", "<div").replace("</article", "</div") for h in pages]
    assert sum(html_extract.main_text(h) != t for h, t in zip(plain, want)) <= len(pages) // 100
    monkeypatch.setattr(html_extract, "path_ratios", lambda texts: [9.0] * len(texts))
    for own in (pages, plain):
        assert sum(html_extract.main_text(h) != t for h, t in zip(own, want)) > len(pages) // 2


@pytest.mark.parametrize(
    "inside,kept",
    [
        ("<section id='related-work'><h2>Related work</h2><p>Others have tried this, too.</p></section>", "Related work Others have tried this, too."), ("<h2 id='legal'>The law</h2><p>It is plain, here.</p>", "The law It is plain, here."),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, always.</p>", "So x=2 holds, always."), ("<p class='promo share'>Not an advert, in here.</p>", "Not an advert, in here."), ("<p>Seen <svg><text>in the chart</text></svg>, at last.</p>", "Seen in the chart, at last."),
        ("<noscript><p>Also without scripts, this.</p></noscript>", "Also without scripts, this."), ("<section class='comments'><p>A reader says, well, this and that.</p></section>", ""), ("<div id='comment-list'><p>A reader says, well, this.</p></div>", ""), ("<aside><p>Aside, this.</p></aside>", ""),
    ],
)
def test_what_stands_in_an_article(inside, kept):
    text = [" ".join(f"Sentence {k}, of the long text, goes on." for k in range(9)) for _ in range(3)]
    page = f"<nav><a>Menu</a></nav><div class='ad'>Buy this, now.</div><article><h1>A title</h1><p>{text[0]}</p>{inside}<p>{text[1]}</p></article><footer>f</footer>"
    assert html_extract.main_text(page) == " ".join(x for x in ("A title", text[0], kept, text[1]) if x)


@pytest.mark.parametrize("page", ["<div>" * 60000 + "x, y.", "<div class=ad>" * 60000 + "x, y." + "</section>" * 60000, "<p>a<table>" + "<p>b" * 40000, "<b>" * 60000 + "</i>" * 60000 + "x, y."])
def test_deep_pages_take_linear_time(page):
    start = time.time()
    html_extract.main_text(page)
    assert time.time() - start < 20


def test_extract_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<main><p>Tea, hot.</p></main><footer>f</footer>")] * 3, "page_id LONG, url STRING, html STRING")
    assert rows_of(html_extract.extract(df)) == [(1, "u", "Tea, hot.", 9)] * 3


# 6


def brute_url(url, rules=url_filter.RULES):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[1] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://example.com/en", "http://a.b.c.net/es/fr/", "x://net/fr/1", "http://xnet/es/",
            "http://example.net/es/1://b.com/", "http://a..com/q", "http://www.example.com/fr/2", "http://com./", "a://b\n.com/en/", "http://Ünet.com/é"]
    df = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls + urls[:6])], "page_id LONG, url STRING, host STRING, verdict STRING")
    got = rows_of(url_filter.filter_urls(df, url_filter.rule_frame(spark, url_filter.RULES)).orderBy("page_id"))
    assert got == [(k, *brute_url(u)) for k, u in enumerate(urls + urls[:6])]
    assert rows_of(url_filter.filter_urls(df.limit(0), url_filter.rule_frame(spark, url_filter.RULES))) == []
    assert {r[4] for r in rows_of(url_filter.filter_urls(df, url_filter.rule_frame(spark, [])))} == {"allow"}


def test_urls_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([(1, "http://a.com/ab/c"), (2, "http://a.com/x")], "page_id LONG, url STRING")
    got = rows_of(url_filter.filter_urls(df, url_filter.rule_frame(spark, [("com", "/a", "block"), ("a.com", "/", "allow")])).orderBy("page_id"))
    assert [r[3:] for r in got] == [("a.com/", "allow"), ("a.com/", "allow")]


def test_urls_of_any_length_and_ties(spark):
    """Long urls cost no more than their own hash; of rules of one length, and of one name, the later verdict wins; a rule may end inside a segment."""
    rules = [("b.com", "/x", "allow"), ("com", "/x/y", "block"), ("com", "/x/y", "allow"), ("a.b.com", "", "block"), ("org", "/" + "s/" * 300, "block")]
    urls = ["http://a.b.com/x/y/z", "http://b.com/x/y", "http://b.com/xy", "http://c.b.com/x/y", "http://a.b.com", "http://..com/x/yy", "x:///e/", "http://org/" + "s/" * 50_000, "http://" + "o." * 30_000 + "org/" + "s/" * 300, "http://q.org/" + "s/" * 299]
    df = spark.createDataFrame(list(enumerate(urls * 2)), "page_id INT, url STRING")
    start = time.time()
    got = url_filter.filter_urls(df, url_filter.rule_frame(spark, rules)).collect()
    assert time.time() - start < 20
    want = [(i, *brute_url(u, rules)) for i, u in enumerate(urls * 2)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# 7


def test_sharding(docs, empty):
    got = sharding.shard(docs)
    rows = got.collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows_of(sharding.shard(empty)) == []


def test_shards_are_even(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "x" * int(n)) for k, n in enumerate(rng.integers(10, 400, 3000))] + [(k, "same text") for k in range(5000, 6500)]
    sizes = [r["b"] for r in sharding.shard(frame(spark, rows)).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 24


def test_widths_are_of_the_metadata(spark):
    """Two sources of equal weight lie half the line apart, languages of one value nowhere; the hash of a name has no say."""
    rows = [(k, "w" * 100, "en", "a" if k % 2 else "b", 0) for k in range(400)]
    p = sharding.points(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")).collect()
    place = lambda d: sorted({r[d] >> 32 for r in p})
    assert place("d_lang") == [0] and place("d_source") == [0, sharding.PLACES // 2] and len(place("d_size")) == 1
    got = sharding.shard(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"), 2).collect()
    assert len({(r["shard"], rows[r["doc_id"]][3]) for r in got}) == 2  # cut between the sources


def test_values_beyond_the_heaviest(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAVIEST", 3)
    rows = [(k, "w" * (1 + k % 90), "en", "hot" if k % 3 == 0 else f"s{k % 60}", 0) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    got = sharding.shard(docs, target_bytes=5000).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(got) == 1500 and sorted(sums) == list(range(round(sum(sums.values()) / 5000)))
    assert max(sums.values()) - min(sums.values()) < 300


def test_equal_texts_share_a_shard(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"text {rng.integers(0, 300)} " * 5, "en", f"s{k % 2}" if k % 10 == 0 else "s", 0) for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")).collect()
    homes = defaultdict(set)
    for r in got:
        homes[rows[r["doc_id"]][1:4]].add(r["shard"])
    assert sum(len(x) > 1 for x in homes.values()) <= sharding.SHARDS  # a cut may part one group of equal points


# 8


def test_words_encode_as_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    w, fast = packing.WordTokenizer(path, 2), packing.WordTokenizer(path, 2, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    some = [t or "" for t in texts()] + ["a  b", "a\n\nb", " lead", "trail ", "it's 'so' don't", "tab\tx", "a\x1cb c", "<|endoftext|> x", "\n", "x \n y", "　a b"]
    some += ["½, ½. 3, x². e̊, a'.", "... a ,b c,, d%%%.", "n'. 's, 's", "don't we'll I'm 12th №5 日本 語、 ok"]
    assert [x[:-4] for x in w.encode(some)] == w._encode(some)
    assert fast.encode(some) == w.encode(some)


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 65), 30, replace=False), rng.integers(1, 500, 30))}
    got, n = Counter(), 0
    for pattern, times in packing.plan(histogram, 64):
        assert sum(pattern) <= 64 and times > 0
        n += times
        for length in pattern:
            got[length] += times
    assert got == {k: v for k, v in histogram.items() if k < 64}  # a whole sequence needs no plan
    alone = sum(t for _, t in packing.best_fit(np.array([histogram.get(k, 0) for k in range(64)] + [0]), 64))
    assert n <= 1.02 * alone + 2


def test_fit_against_dense_least_squares():
    """The fit's squared error is that of the least squares solution, but for a five hundredth of the histogram's squares."""
    rng = np.random.default_rng(0)
    goal = np.zeros(49, np.int64)
    goal[1:48] = rng.integers(0, 60, 47)
    ways = packing.patterns(48)
    x = packing.fit(goal, ways)
    m = np.zeros((49, len(ways)))
    for k in range(3):
        np.add.at(m, (ways[:, k], np.arange(len(ways))), 1.0)
    m[0] = 0
    full = np.zeros(len(ways))
    full[list(x)] = list(x.values())
    error = ((goal - m @ full) ** 2).sum()
    best, step = np.zeros(len(ways)), 1 / np.linalg.norm(m, 2) ** 2
    for _ in range(20_000):  # projected gradient, slow and sure
        best = np.maximum(0, best + step * (m.T @ (goal - m @ best)))
    assert (full >= 0).all()
    assert error - ((goal - m @ best) ** 2).sum() <= 0.002 * (goal**2).sum()


def test_tokens_of_a_whole_table():
    """The ranks' ids are tokenizers' ids in every text of a table."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    w, fast = packing.WordTokenizer(path, 2), packing.WordTokenizer(path, 2, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    some = [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert [x[:-4] for x in fast.encode(some)] == w._encode(some)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    w = packing.WordTokenizer(path, 2)
    rows = packing.pack(docs, path, sequence=128).collect()
    ids = {r["doc_id"]: w.encode([r["text"] or ""])[0] for r in docs.collect()}
    by, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"] and len(part) == 4 * r["length"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    copies = Counter(r["doc_id"] for r in docs.collect())
    for i, parts in seen.items():
        n = len(ids[i]) // 4
        lengths = [n % 128 or 128] + [128] * ((n - 1) // 128)
        assert sorted(parts) == sorted([(k, sum(lengths[:k]), x) for k, x in enumerate(lengths)] * copies[i])
    assert rows_of(packing.pack(empty, path)) == []


# 9


@pytest.mark.parametrize("sizes,want", [([100, 100, 100], [187.5, 75, 37.5]), ([10, 100, 100], [30, 120, 60]), ([0, 0], [0, 0]), ([7], [7]), ([0, 9, 1], [0, 7, 3])])
def test_targets(spark, sizes, want):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i LONG, source_size LONG")
    assert [r["target"] for r in mixing.with_targets(rows).orderBy("i").collect()] == pytest.approx(want)


def brute_targets(sizes):
    weights, capped = [(5, 2, 1)[i % 3] for i in range(len(sizes))], set()
    while len(capped) < len(sizes):
        share = (sum(sizes) - sum(3 * sizes[i] for i in capped)) / sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i in range(len(sizes)) if i not in capped and share * weights[i] > 3 * sizes[i]}
        if not over:
            break
        capped |= over
    return [3 * n if i in capped else share * weights[i] for i, n in enumerate(sizes)]


def test_tree_keeps_quotas():
    quotas, wanted = np.array([50, 7, 0, 300]), np.diff(np.arange(17) * 357 // 16)
    tree = mixing.splitting_tree(quotas, wanted, [1])
    assert tree.sum(axis=0).tolist() == quotas.tolist() and tree.sum(axis=1).tolist() == wanted.tolist() and tree.min() >= 0
    means = np.mean([mixing.splitting_tree(quotas, wanted, [s]) for s in range(300)], axis=0)
    assert np.allclose(means, wanted[:, None] * quotas / 357, atol=0.7)  # every shard draws each source in proportion
    less = mixing.splitting_tree(quotas, wanted // 2, [1])
    assert less.sum(axis=1).tolist() == (wanted // 2).tolist() and (less.sum(axis=0) <= quotas).all()


@pytest.mark.parametrize("groups", [4096, 7])
def test_mixing_of_many_sources(spark, monkeypatch, groups):
    """A source for nearly every document, one source with a third of all, and none: shards stay disjoint and even."""
    monkeypatch.setattr(mixing, "GROUP_SOURCES", groups)
    monkeypatch.setattr(mixing, "BROADCAST_PLAN", 10 if groups == 7 else 200_000)
    rng = np.random.default_rng(1)
    rows = [(k, "word " * int(rng.integers(1, 30)), "en", None if k % 50 == 0 else "hot" if k % 3 == 0 else f"s{k % 700}", 0) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    got = mixing.Mix(docs).taken().collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(names, brute_targets([sizes[s] for s in names])))
    by = defaultdict(list)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * len(r["shards"]) and len(r["shards"]) == r["passes"] <= 3
        by[r["source"]].append(r)
    for some in by.values():
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= max(r["size"] for r in some) / 2 + 1 + 0.001 * some[0]["target"]
    drawn = Counter(s for r in got for s in r["shards"])
    assert len(drawn) == mixing.SHARDS and max(drawn.values()) < 1.5 * min(drawn.values())
    passes = {}  # a source's block in one pass goes to one shard alone
    for r in got:
        for k, s in enumerate(r["shards"]):
            assert passes.setdefault((r["source"], r["block"], k), s) == s


def test_mixing(docs, empty):
    m = mixing.Mix(docs)
    rows = m.taken().collect()
    size = lambda t: len(WORDS.findall(t or ""))
    all_ = docs.collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((r["doc_id"], size(r["text"])) for r in all_)
    by = defaultdict(list)
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    largest = max(r["size"] for r in rows)
    for source, some in by.items():
        assert some[0]["source_size"] == sum(size(r["text"]) for r in all_ if r["source"] == source)
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= largest
    copies = m.copies(docs)
    assert copies.columns[:-2] == docs.columns
    n = Counter(r["doc_id"] for r in copies.collect())
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["passes"]
    assert n == +want
    assert sorted(map(repr, mixing.Mix(docs).taken().collect())) == sorted(map(repr, rows))
    assert rows_of(mixing.Mix(empty).taken()) == []


# 10


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def brute_components(fps):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, empty):
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    root = brute_components(fps)
    got = rows_of(simhash.near_duplicates(docs))
    assert sorted(got) == sorted((r["doc_id"], f"{fps[r['doc_id']]:016x}", root[r["doc_id"]]) for r in docs.collect())
    assert len(set(root.values())) < len(root)
    assert rows_of(simhash.near_duplicates(empty)) == []


@pytest.mark.parametrize("dense", [1024, 3])
def test_links_between_close_fingerprints(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(6)
    fps = set()
    for _ in range(30):
        x = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(12):
            fps.add(x)
            x ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.5:
                x ^= 1 << int(rng.integers(0, 64))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.connected_components(simhash.candidate_links(spark.createDataFrame([(f,) for f in signed], "fp LONG")))
    parts = defaultdict(set)
    for r in got.collect():
        parts[r["root"]].add(r["node"] & (1 << 64) - 1)
    want = defaultdict(set)
    for i, r in brute_components({f: f for f in fps}).items():
        want[r].add(i)
    assert sorted(map(sorted, parts.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def pattern_of(template):
    """The template as a regular expression over words between single spaces."""
    out = template
    for n in sorted({m[1] for m in re.finditer(r"\{\{(\d+)\}\}", template)}):
        out = out.replace("{{" + n + "}}", f"<any{n}>")
    parts = []
    for token in re.findall(r"\[\[|\]\]|<any\d+>|[^\s\[\]<>]+", out):
        parts.append("(?:" if token == "[[" else ")?" if token == "]]" else f"(?: [^ ]+){{0,{token[4:-1]}}}" if token.startswith("<any") else " " + re.escape(token) + "(?= )")
    return re.compile("".join(parts))


def example(template, rng):
    """A text that the template accepts: optional regions in or out, any words for the replaceable ones."""
    text = re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if rng.random() < 0.5 else "", template)
    return re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join("name" for _ in range(int(rng.integers(0, int(m[1]) + 1)))), text).split()


def test_templates_against_regular_expressions():
    """Every template's own text, whole and with one mandatory word gone or changed, between other words: labels are those whose expression matches."""
    patterns = [(label, pattern_of(t)) for label, t in license_scan.TEMPLATES]
    scanner, rng, hits = license_scan.Scanner(), np.random.default_rng(8), Counter()
    for label, template in license_scan.TEMPLATES:
        for change in ("none", "drop", "swap", "none"):
            words = example(template, rng)
            at = int(rng.integers(0, len(words)))
            words = words[:at] + words[at + 1 :] if change == "drop" else [*words[:at], "other", *words[at + 1 :]] if change == "swap" else words
            text = "Some. text BEFORE, it: " + " ".join(words).capitalize() + "; and after"
            flat = " " + " ".join(re.findall(r"[0-9a-z]+", text.lower())) + " "
            want = {x for x, p in patterns if p.search(flat)} | {x for phrase, x in license_scan.PHRASES if f" {phrase} " in flat}
            got = scanner.scan(text)
            assert set(filter(None, got[5].split(","))) == want, (label, change, text)
            assert (got[6] > 0) == bool(want) and got[6] <= 1
            hits[change] += label in want
    n = len(license_scan.TEMPLATES)
    assert n >= 50 and hits["none"] == 2 * n and hits["drop"] < n / 2 and hits["swap"] < n / 2


#: Licenses whose templates are their whole texts.
WHOLE = "mit mit-0 x11 isc 0bsd bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause zlib bsl-1 ncsa postgresql hpnd ntp curl fair wtfpl beerware".split()


@pytest.mark.parametrize("label", [*WHOLE, "unlicense"])
def test_whole_texts_to_the_last_word(label):
    """A text whose last sentence is cut off or changed isn't the license."""
    template = next(t for x, t in license_scan.TEMPLATES if x == label)
    bare = re.sub(r"\[\[.*?\]\]", "", template)
    words = re.sub(r"\{\{\d+\}\}", "name", bare).split()
    scan = lambda words: license_scan.Scanner(templates=[(label, template)]).scan(" ".join(words))[5]
    assert scan(words) == label and scan([*words, "and", "more"]) == label
    assert scan(words[:-1]) == "" and scan([*words[:-1], "unless", "they", "feel", "like", "it"]) == ""
    for at in (len(words) - 3, len(words) // 2):
        if words[at] != "name":
            assert scan([*words[:at], "changed", *words[at + 1 :]]) == ""


def test_clipped_texts_have_no_label():
    grant = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    assert license_scan.Scanner().scan(grant + " you must pay one million dollars and never share it")[5] == ""
    assert license_scan.Scanner().scan(MIT + ". " + AS_IS.partition(" BE LIABLE")[0] + " be liable unless they feel like it")[5] == ""


def test_a_template_needs_a_mandatory_word():
    with pytest.raises(ValueError, match="no mandatory word"):
        license_scan.compile_template("[[may be]] {{3}}")


def test_places_take_linear_time():
    start = time.time()
    got = license_scan.Scanner().scan("cc by nc " * 100_000)
    assert got[1:4] == (100_000, 0, 299_997) and time.time() - start < 10


def test_license_repeated_rows(spark):
    assert [r["labels"] for r in license_scan.scan_licenses(frame(spark, [(1, "CC BY NC")] * 3)).collect()] == ["cc-by-nc"] * 3


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted"
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "label,text",
    [
        ("mit", MIT + " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS),
        ("mit-0", MIT + ". " + AS_IS),
        ("", MIT),
        ("isc", ISC.format("and/or") + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END),
        ("isc", ISC.format("and") + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END),
        ("0bsd", ISC.format("and/or") + ". " + ISC_END),
        ("bsd-2-clause", BSD + BSD_END),
        ("bsd-3-clause", BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_END),
        ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
        ("gpl-2", "This program is free software; " + GNU.format("General Public License", 2)),
        ("gpl-3", "This program is free software: " + GNU.format("General Public License", 3)),
        ("lgpl", "This library is free software; " + GNU.format("Lesser General Public License", "2.1")),
        ("lgpl", "This library is free software; " + GNU.format("Library General Public License", 2)),
        ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"),
        ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
        ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License."),
        ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("cc-by-sa", "licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License."),
        ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License."),
        ("cc-by", "licensed under the Creative Commons Attribution 3.0 Unported License."),
        ("unlicense", "This is free and unencumbered software released into the public domain."),
        ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed"),
    ],
)
def test_canonical_notices(label, text):
    assert license_scan.Scanner().scan(text)[5] == label


@pytest.mark.parametrize("frame", ["<div class='layout has-sidebar'>{}</div>", "<div id='nav-wrapper'>{}</div>", "<form action=x>{}</form>", "<form><div class='widget'>{}</div></form>", "{}"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_frames_keep_the_article(frame, tag):
    body = " ".join(f"Sentence {k}, of the long text, goes on." for k in range(30))
    page = "<nav>Menu</nav>" + frame.format(f"<div class='sidebar'>Buy, now!</div><{tag}><p>{body}</p></{tag}><div class=related><article>Card.</article></div>") + "<footer>f</footer>"
    assert html_extract.main_text(page) == body


def test_a_teaser_article_hides_no_text():
    body = " ".join(f"Sentence {k}, of the long text, goes on." for k in range(30))
    assert body in html_extract.main_text(f"<body><div><p>{body}</p></div><article><p>A teaser, short.</p></article></body>")
